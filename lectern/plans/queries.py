"""The registered queries: each applies an operator to its stand-in inputs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import canon
from lectern.functions import numerals, references
from lectern.functions.text import cleaned, decoded
from lectern.operators import corpus, detect, ingest, lookup, metrics, phrases, resolver, scan, sessions
from lectern.plans import speech
from lectern.plans import stand_ins as S
from lectern.shared import shared_folder
from lectern.sources import files, transcripts
from lectern.streaming import answers, console, segments, session


def _long(*columns: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in columns]


def parse_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.parsed(S.typed(spark, sf_dir)).select("o_orderkey", "raw", "abbrev", *_long("ch", "v1", "v2"))


def parse_chverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tails(spark, sf_dir).withColumn("r", references.chapter_verse(F.col("tail"))).select("o_orderkey", "tail", "r.*").select("o_orderkey", "tail", *_long("ch", "v1", "v2"))


def resolve_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.names(spark, sf_dir).withColumn("alias", references.book_key(F.col("name")))
    return rows.join(F.broadcast(canon.aliases(spark).drop("n")), "alias", "left").select("o_orderkey", "name", "abbrev")


def corpus_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [corpus.long_form(corpus.to_chapters(S.side_of(spark, sf_dir, s))).withColumn("side", F.lit(s)) for s in ("ko", "en")]
    return sides[0].unionByName(sides[1])


def parallel_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.verses(spark, sf_dir)


def chapter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ko, en = (corpus.to_chapters(S.side_of(spark, sf_dir, s)) for s in ("ko", "en"))
    side = lambda i: F.coalesce(F.aggregate("c", F.lit(0), lambda n, x: n + F.size(F.get(x, F.lit(i)))), F.lit(0))
    total = lambda x, name: F.sum(x).cast("int").alias(name)
    return corpus.merged(ko, en).groupBy("ord", "a", "en", "ko").agg(total(F.size("c"), "chapters"), total(side(0), "ko_verses"), total(side(1), "en_verses"))


def lookup_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = lookup.parsed(S.typed(spark, sf_dir)).drop("raw")
    return lookup.verses_of(refs, S.verses(spark, sf_dir)).select("o_orderkey", "abbrev", *_long("ch"), "num", "ko", "en")


def lookup_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = lookup.parsed(S.typed(spark, sf_dir)).select("o_orderkey", "abbrev", "ch", "v1", "v2")
    return lookup.shown(refs, S.verses(spark, sf_dir), "o_orderkey")


def lookup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_status(S.typed(spark, sf_dir), S.verses(spark, sf_dir), "o_orderkey")


META = ([("both", ["ko", "en"], {"ko": "K", "en": "E"}, True)], "title string, langs array<string>, names map<string,string>, demo boolean")


def lookup_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.headers(S.typed(spark, sf_dir), S.verses(spark, sf_dir), spark.createDataFrame(*META), "o_orderkey")


def render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rendered(S.verses(spark, sf_dir))


def en_only_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rendered(S.verses(spark, sf_dir), ["en"])


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("[  "), F.replace(F.col("text"), F.lit(" "), F.lit(" \t")), F.lit("]  ¶"))
    return S.table(spark, sf_dir, "benchmark").select("item_id", cleaned(dirty).alias("clean"))


def vpl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parsed_lines(S.source_lines(spark, sf_dir))


def verse_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.out_of_order(ingest.parsed_lines(S.source_lines(spark, sf_dir)))


def missing_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.missing_books(S.lines(spark, sf_dir))


def chapter_gap_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = []
    for s in ("ko", "en"):
        kept = S.side_of(spark, sf_dir, s).where("ch % 3 <> 0")  # the gaps to be filled
        lists = kept.groupBy("abbrev", "ch").agg(F.array_sort(F.collect_list(F.struct("v", "text")))["text"].alias("verses"))
        sides.append(corpus.padded(lists).select(F.lit(s).alias("side"), "abbrev", "ch", F.size("verses").alias("n")))
    return sides[0].unionByName(sides[1])


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.counts(S.verses(spark, sf_dir))


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.last_wins(S.table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars"), "source", "doc_id")


def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return files.with_fallback(docs.where("lang = 'none'"), docs)


def js_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ko, en = (corpus.to_chapters(S.side_of(spark, sf_dir, s)) for s in ("ko", "en"))
    meta = spark.createDataFrame([("both", ["ko", "en"], {"ko": "K", "en": "E"})], "title string, langs array<string>, names map<string,string>")
    files.write_script(corpus.merged(ko, en), meta, path := shared_folder(spark, "script"))
    return corpus.from_records(files.read_script(spark, path)[0])


def json_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    ko, en = (corpus.to_chapters(S.side_of(spark, sf_dir, s)) for s in ("ko", "en"))
    corpus.merged(ko, en).drop("ord").write.json(path := shared_folder(spark, "combined"))
    return corpus.counts(corpus.from_records(files.build(spark, combined=path, lines=True)[0]))


def build_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {}
    for s in ("ko", "en"):
        corpus.to_chapters(S.side_of(spark, sf_dir, s)).write.json(path := shared_folder(spark, s))
        paths[s] = path
    records, meta = files.build(spark, **paths, lines=True)
    files.write_script(records, meta, path := shared_folder(spark, "built"))
    return corpus.from_records(files.read_script(spark, path)[0])


def corpus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of corpora with both sides, one, or names for one only: a nation's name is a title."""
    k = F.col("n_nationkey")
    langs = F.when(k % 3 == 0, F.array(F.lit("ko"), F.lit("en"))).when(k % 3 == 1, F.array(F.lit("ko"))).otherwise(F.array(F.lit("en")))
    names = F.when(k % 2 == 0, F.create_map(F.lit("ko"), F.concat(F.lit("K "), "n_name"), F.lit("en"), F.lit("E"))).otherwise(F.create_map(F.lit("en"), F.col("n_name")))
    return corpus.view(S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), langs.alias("langs"), names.alias("names"), F.when(k % 5 == 0, True).alias("demo")))


def ko_only_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rendered(S.verses(spark, sf_dir), ["ko"])


def scan_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = S.signatures(spark, sf_dir).select(F.base64(F.encode("signature", "utf-8")).alias("coded"))
    return scan.by_signature(S.files(spark, sf_dir), coded.select(decoded(F.col("coded")).alias("signature")))


def scan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.by_name(S.files(spark, sf_dir))


def scan_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.by_signature(S.files(spark, sf_dir), S.signatures(spark, sf_dir))


def scan_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.by_size(S.files(spark, sf_dir), S.OVERSIZE)


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.violations(S.files(spark, sf_dir), S.signatures(spark, sf_dir), S.OVERSIZE)


def scan_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = S.files(spark, sf_dir)
    return scan.verdict(texts, scan.violations(texts, S.signatures(spark, sf_dir), S.OVERSIZE))


def _numerals(spark: SparkSession, sf_dir: str, said, value) -> DataFrame:
    """Each order's number in words, and what the words are read as."""
    words = F.array(*[F.lit(said(n)) for n in range(1, 201)])
    n = (F.col("o_orderkey") % 200 + 1).cast("int")
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(words, n).alias("word"))
    return rows.select("o_orderkey", "word", value(F.col("word")).alias("value"))


def numerals_ko(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numerals(spark, sf_dir, numerals.korean, numerals.korean_value)


def numerals_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numerals(spark, sf_dir, numerals.english, numerals.english_value)


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.said(spark, sf_dir).select("o_orderkey", detect.normalised(F.col("text")).alias("text"))


FOUND = ["o_orderkey", "item", "abbrev", "ch", "v1", "ch2", "v2", "matched", "start", "end"]


def detect_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detected(speech.sentences(spark, sf_dir, speech.DIGITS), "o_orderkey").select(*FOUND)


def detect_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = speech.sentences(spark, sf_dir, speech.WORDS)
    found = detect.detected(texts, "o_orderkey").select(*FOUND).join(texts, "o_orderkey")
    return found.select(*FOUND, F.substring("text", F.col("start"), F.col("end") - F.col("start") + 1).alias("shown"))


def confidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detected(speech.sentences(spark, sf_dir, speech.DIGITS), "o_orderkey")
    return sessions.ranked(found, "o_orderkey").select("o_orderkey", "start", "item", "confidence", "rank")


def detect_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["{ko} {c}장 {v}절 이하", "{ko} {c}장 첫 절", "{ko} {c}장 첫째 절", "{ko} {c}장에 마지막 절", "{ko} {c}장"]
    texts = S._orders(spark, sf_dir).select("o_orderkey", S._form(5, *map(S._text, forms)).alias("text"))
    last = S.lines(spark, sf_dir).groupBy("abbrev", "ch").agg(F.max("v").alias("last_v"))
    return detect.special(texts, "o_orderkey", last)


def context_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    out = sessions.with_context(S.events(spark, sf_dir), "user_id", "ts", "event_id", shown, F.lit(False))
    return out.select("event_id", "user_id", "context")


def relative_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = corpus.neighbours(S.lines(spark, sf_dir))
    kinds = F.element_at(F.array(*map(F.lit, ("verse", "next", "previous", "next_chapter", "same_chapter"))), (F.col("v") + F.col("ch")) % 5 + 1)
    mentions = catalog.select("abbrev", "ch", "v", kinds.alias("kind"), (F.col("v") % 4 + 1).alias("n"))
    return sessions.relative(mentions, catalog)


def _phrases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = S.phrases(spark, sf_dir)
    context = texts.where("abbrev is not null").select("o_orderkey", "abbrev", "ch", "v")
    return phrases.resolved(texts.select("o_orderkey", detect.normalised(F.col("text")).alias("text")), "o_orderkey", context, corpus.neighbours(S.lines(spark, sf_dir)))


def context_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir)[0].select("o_orderkey", "kind", "abbrev", "to_ch", "to_v", "rolled_over", "confidence")


def context_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir)[1].select("o_orderkey", "kind", "n", "reason")


def resolver_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = speech.sentences(spark, sf_dir, speech.DIGITS).withColumnRenamed("o_orderkey", "key")
    found = detect.detected(texts, "key").select("key", "abbrev", "ch", F.col("v1").alias("v"))
    return resolver.asked(texts, found).select("key")


def suppress_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.since_last(S.events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", S.REPEAT_SECONDS)
    return out.select("event_id", "user_id", "event_type", "suppressed")


def suppress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.throttled(S.events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", S.REPEAT_SECONDS)


def interim_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.events(spark, sf_dir).select("user_id", (F.col("event_id") % 7).alias("ref"), "event_id", (F.col("event_type") == "purchase").alias("final"))
    return sessions.one_candidate(rows, ["user_id", "ref"], "event_id", "final")


def top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.events(spark, sf_dir).withColumn("ref", F.col("event_id") % 7)
    found = sessions.latest(e.where("event_type <> 'purchase'"), "user_id", "ts", "event_id")
    shown = sessions.marked(found, e.where("event_type = 'purchase'"), ["user_id", "ref"], "ts")
    return shown.select("user_id", "event_id", "event_type", "place", "displayed")


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = S.lines(spark, sf_dir).select("abbrev", "ch", "v")
    rows = S._orders(spark, sf_dir).select("o_orderkey", "abbrev", F.col("c").cast("int").alias("ch"), F.col("v").cast("int").alias("v"))
    part = lambda i, j: rows.where(F.col("o_orderkey") % 6 >= i).where(F.col("o_orderkey") % 6 <= j).withColumn("o_orderkey", F.col("o_orderkey") % 100)
    return sessions.united(part(0, 3), part(2, 4), part(3, 5), catalog, ["o_orderkey"])


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(S.events(spark, sf_dir), "event_type", "value")


def latency_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.events(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_type").alias("hop"), F.col("value").alias("ms"))
    files.write_latency(lines, path := shared_folder(spark, "latency"))
    return metrics.latency(files.read_latency(spark, path), "hop", "ms")


def clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = S.events(spark, sf_dir), F.col("value")
    samples = e.select(F.col("user_id"), F.lit(0.0).alias("t0"), v.alias("t1"), (v + 2).alias("t2"), (v / 2).alias("t3"))
    return metrics.clock_offset(samples, "user_id")


#: Seconds between two sentences of the evaluation, and sessions they are dealt to.
APART, SERVICES = 60, 5


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching of what the sentences hold with what is found in them, as they were said and as a machine wrote them down (mode)."""
    k = F.col("o_orderkey")
    session = F.struct("mode", (k % SERVICES).alias("service")).alias("session")  # no pair has two modes
    ref = F.concat_ws(" ", "abbrev", "ch", "v1").alias("ref")
    time = lambda late: F.timestamp_seconds(1704067200 + k * APART + late).alias("ts")
    truth = speech.labels(spark, sf_dir, speech.DIGITS).withColumn("mode", F.explode(F.array(F.lit("said"), F.lit("machine"))))
    texts = speech.transcripts(spark, sf_dir, speech.DIGITS).select(F.struct("o_orderkey", "modes").alias("k"), "text")
    found = detect.detected(texts, "k").select("k.o_orderkey", F.explode("k.modes").alias("mode"), "abbrev", "ch", "v1", "start", "item")
    labels = truth.select(session, ref, time(F.lit(0)), F.concat_ws("-", k, "nth", "item").alias("id"))
    rows = metrics.one_to_one(labels, found.select(session, ref, time(k % 8), F.concat_ws("-", k, "start", "item").alias("id")))
    return rows.withColumn("mode", F.col("session.mode"))


def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scored(_evaluated(spark, sf_dir), ["mode"])


def eval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How high the true references rank among a sentence's candidates by confidence."""
    texts = speech.sentences(spark, sf_dir, speech.DIGITS, misheard=True)
    found = sessions.ranked(detect.detected(texts, "o_orderkey"), "o_orderkey")
    best = found.groupBy("o_orderkey", "abbrev", "ch", F.coalesce("v1", F.lit(0)).alias("v")).agg(F.min("rank").alias("rank"))
    truth = speech.labels(spark, sf_dir, speech.DIGITS).select("o_orderkey", "abbrev", "ch", F.coalesce("v1", F.lit(0)).alias("v"))
    return metrics.top_k(truth.join(best, ["o_orderkey", "abbrev", "ch", "v"], "left"), "rank")


def fp_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By mode, and how much worse the machine's transcript is than what was said."""
    return metrics.modes_compared(_evaluated(spark, sf_dir), "mode", "said", F.col("other").isNull() & (F.col("side") == "candidate"), "ts")


def match_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.events(spark, sf_dir)
    labels = e.where("event_type = 'purchase'").select(F.col("user_id").alias("session"), (F.col("event_id") % 3).alias("ref"), F.col("ts").alias("label_ts")).distinct()
    found = e.where("event_type = 'view'").select(F.col("user_id").alias("session"), (F.col("event_id") % 3).alias("ref"), "ts")
    return metrics.matched_in_time(labels, found, 3600.0)


def fixture_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda i: S.table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == i).select("source", "lang")
    return metrics.drift(half(0), half(1))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # The pattern lets the stream read a table of one file as well as one of many.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    return session.drained(spark, session.sessions(S.session_events(stream), S.REPEAT_SECONDS))


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    return session.drained(spark, session.messages(S.console_events(stream), S.REPEAT_SECONDS))


def resolver_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers as two streams, joined in time; the last watermark comes from rows of a far later time."""
    asked, said = S.questions(S.events(spark, sf_dir))
    folder, out = shared_folder(spark, "questions"), shared_folder(spark, "answers")
    far = lambda df, t: df.limit(1).withColumns({"session": F.lit(-1).cast("long"), t: F.lit("2100-01-01").cast("timestamp")})
    for step in range(2):
        for name, df, t in (("asked", asked, "t_asked"), ("said", said, "t_answer")):
            (far(df, t) if step else df).write.mode("append").parquet(f"{folder}/{name}")
        q, a = (spark.readStream.schema(df.schema).parquet(f"{folder}/{name}") for name, df in (("asked", asked), ("said", said)))
        rows = session.drained(spark, answers.awaited(q, a, latest=60, late=10**6), out)
    return rows.where("session >= 0").select("session", "seq", "outcome", "abbrev", "ch", "v")


def latency_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hops of messages from the stamps of two clocks, with each client's offset at that time."""
    return metrics.latency(metrics.hops(*S.stamped(S.events(spark, sf_dir))), "hop", "ms")


def stream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From transcript lines to candidates of the corpus: the source, the order of segments, detection and the join with the verses in one stream."""
    folder, out, verses = (shared_folder(spark, n) for n in ("transcripts", "candidates", "catalog"))
    catalog = console.stored(console.catalog(S.verses(spark, sf_dir)), verses)
    S.transcripts(speech.sentences(spark, sf_dir, speech.DIGITS)).write.json(folder)
    ordered = segments.in_order(transcripts.read_transcripts(spark, folder), late=10**7)
    found = console.candidates(ordered, catalog)
    for second in range(2):  # the clock of another session goes on, which gives up the gaps before
        clock = spark.range(1).select(F.lit(-1).alias("session"), F.lit(second).alias("seq"), F.lit("").alias("text"), F.lit(True).alias("is_final"), F.lit("ko").alias("lang"), F.lit("2034-01-01T00:00:00Z").alias("t_client"))
        clock.write.mode("append").json(folder)
        rows = session.drained(spark, found, out, session.PROVIDER)
    return rows.select("session", "seq", "item", "final", "abbrev", "ch", "v", "start", "end", "ko", "en")


_ALL = (
    parse_ref, parse_chverse, resolve_alias, corpus_long, parallel_align, chapter_merge, lookup_range, lookup_shown, lookup_status, lookup_header, render_rows, en_only_view,
    clean_text, vpl_parse, verse_order_check, missing_books, chapter_gap_pad, corpus_counts, last_wins, source_fallback, js_roundtrip, json_combined,
    build_separate, corpus_view, ko_only_view, scan_decoded, context_phrases, context_misses, resolver_gate, latency_jsonl,
    scan_names, scan_signatures, scan_size, scan_report, scan_verdict, numerals_ko, numerals_en, normalize_text, detect_refs, detect_offsets, detect_special, confidence_rank,
    context_asof, relative_resolve, suppress_gap, suppress_throttle, interim_final, top5, candidate_union, latency_summary, clock_offset, eval_prf,
    eval_topk, fp_per_hour, match_in_time, fixture_drift, stream_session, stream_messages, stream_candidates, resolver_answers, latency_stamps,
)
QUERIES = {f.__name__: f for f in _ALL}
