"""Inputs of the registered queries, derived from the driver's tables, as no corpus text comes with this repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import canon
from lectern.operators import corpus

#: Events that count as repeats within this time; the driver's events are hours apart.
REPEAT_SECONDS = 6 * 3600
#: Texts over so many bytes count as oversize here.
OVERSIZE = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """abbrev, side, ch, v, text: a source is a book, its English and French documents the chapters of one side, all others of the other one, lines the verses."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    side = F.when(F.col("lang").isin("en", "fr"), "en").otherwise("ko")
    book = F.pmod(F.coalesce(F.substring("source", 4, 9).try_cast("int"), F.lit(0)), F.lit(66)) + 1
    rows = docs.select(book.alias("ord"), side.alias("side"), "doc_id", "text")
    # Chapters are numbered without their texts, so that a large source's sort moves numbers only.
    ch = F.row_number().over(Window.partitionBy("ord", "side").orderBy("doc_id"))
    numbers = rows.select("ord", "side", "doc_id").select("ord", "side", "doc_id", ch.alias("ch"))
    rows = rows.join(numbers, ["ord", "side", "doc_id"]).join(F.broadcast(canon.books(spark).select("ord", "abbrev")), "ord")
    each = rows.select("abbrev", "side", "ch", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return each.select("abbrev", "side", "ch", (F.col("p") + 1).alias("v"), "text")


def side_of(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return lines(spark, sf_dir).where(F.col("side") == side).drop("side")


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """abbrev, ch, v, ko, en."""
    return corpus.aligned(side_of(spark, sf_dir, "ko"), side_of(spark, sf_dir, "en"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's key with an alias, a book and small numbers that follow from the key."""
    k = F.col("o_orderkey")
    names = canon.aliases(spark).join(canon.books(spark), "abbrev").select("n", "alias", "abbrev", "en", "ko")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 369).cast("int").alias("n"), (k % 37 + 1).cast("string").alias("c"), (k % 5 + 1).cast("string").alias("v"), (k % 5 + k % 4).cast("string").alias("w"), (k % 199 + 1).cast("int").alias("m"))
    return rows.join(F.broadcast(names), "n")


def _form(of: int, *forms: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(F.col("o_orderkey") % of == i, form).otherwise(out)
    return out


def _text(template: str) -> Column:
    """A template with the columns' names in braces."""
    import re

    return F.concat(*[F.col(x[1:-1]) if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x])


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, raw: typed references of all forms, wrong ones among them."""
    rows = _orders(spark, sf_dir).withColumn("big", F.upper("alias"))
    forms = ["{alias} {c}:{v}", "{alias} {c}:{v}-{w}", "{big}. {c} {v}", "  {alias} {c} ： {v} ～ {w} ", "{alias} {c}", "{alias} {c} {v} - {w}", "{alias} {c}:{v} - {w}", "{en} {c}:{v}", "{alias}{c}"]
    blank = F.when(F.col("o_orderkey") % 18 == 8, F.lit("  ")).otherwise(_text(forms[8]))
    return rows.select("o_orderkey", _form(9, *map(_text, forms[:8]), blank).alias("raw"))


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, tail: what may stand after a book's name."""
    forms = ["{c}:{v}", "{c} {v}", "{c}:{v}-{w}", "{c} {v} {w}", "{c}", "{c} {v} - {w}", "x {c}", "{c}:{v}-", "{c}:{v},{w}"]
    return _orders(spark, sf_dir).select("o_orderkey", _form(9, *map(_text, forms)).alias("tail"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, name: aliases in several spellings."""
    rows = _orders(spark, sf_dir).withColumn("big", F.upper("alias"))
    return rows.select("o_orderkey", _form(5, *map(_text, ["{alias}", "{big}", "{alias}.", "{en}", "x{alias}"])).alias("name"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, text, abbrev, ch, v: relative references, and what was displayed before them; null for a quarter."""
    forms = ["{v}절 말씀", "그 다음 절도 보시면", "앞 절", "다음 장", "{c}장으로 넘어가서", "같은 장 뒷부분 {v}절", "다시 {v}절로", "{v}절기와 {c}장짜리 편지", "{ko} {c}장 {v}절", "and verse {v}", "the following verse", "back to verse {w}"]
    there = lambda x: F.when(F.col("o_orderkey") % 4 != 0, F.col(x))
    rows = _orders(spark, sf_dir).select("o_orderkey", _form(12, *map(_text, forms)).alias("text"), there("abbrev").alias("abbrev"), there("c").cast("int").alias("ch"), there("v").cast("int").alias("v"))
    return rows


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, text: sentences with Sino-Korean numbers and spaced marks."""
    tens = F.when(F.col("m") % 100 >= 10, F.concat(_digit(F.floor(F.col("m") / 10) % 10, True), F.lit("십"))).otherwise("")
    word = F.concat(F.when(F.col("m") >= 100, "백").otherwise(""), tens, _digit(F.col("m") % 10, False))
    rows = _orders(spark, sf_dir).withColumn("word", word)
    forms = ["{ko} {word} 장 {v} 절", "{ko} {c} 편 {word} 절 말씀", "{ko} {c} : {v} ~ {w}", "{ko} {c}장 {v}절 부터 {w}절 까지", "{word} {ko} colon {c}"]
    return rows.select("o_orderkey", _form(5, *map(_text, forms)).alias("text"))


def _digit(n: Column, one_unsaid: bool) -> Column:
    return F.when((n == 0) | (n == 1 if one_unsaid else F.lit(False)), "").otherwise(F.substring(F.lit("일이삼사오육칠팔구"), n.cast("int"), F.lit(1)))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, value: the English side as a line source, with junk lines and unknown codes, some verses out of order."""
    rows = side_of(spark, sf_dir, "en").join(F.broadcast(canon.books(spark)), "abbrev")
    no = (F.col("ord").cast("long") * 1_000_000_000 + F.col("ch").cast("long") * 100_000 + F.col("v")).alias("line_no")
    v = F.when((F.col("ch") % 5 == 0) & (F.col("v") % 7 == 3), F.col("v") + 1).otherwise(F.col("v"))
    code = F.when((F.col("ch") % 11 == 0), "TOB").otherwise(F.col("code"))
    text = F.concat(code, F.lit(" "), F.col("ch"), F.lit(":"), v, F.lit(" ["), F.col("text"), F.lit("]  ¶"))
    return rows.select(no, F.when(F.col("v") % 13 == 0, F.concat(F.lit("# "), text)).otherwise(text).alias("value"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, length of documents as files, some under names that are refused or exempt; one without text can't be read."""
    d = F.col("doc_id")
    path = F.when(d % 7 == 0, F.concat(F.lit("data/sample/"), d)).when(d % 11 == 0, F.concat(F.lit("x/nkjv_"), d)).when(d % 13 == 0, F.concat(d, F.lit(".bak"))).otherwise(F.concat(F.lit("texts/"), d, F.lit(".txt")))
    docs = table(spark, sf_dir, "documents")
    return docs.select(path.alias("path"), "text", F.octet_length("text").cast("long").alias("length"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("text").alias("signature"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts"), "user_id", "event_type", "value")


def session_events(events: DataFrame) -> DataFrame:
    """Events as a session's: views and signups are mentions, clicks and purchases displays, errors clears."""
    kind = F.when(F.col("event_type") == "error", "clear").when(F.col("event_type").isin("click", "purchase"), "display").otherwise("mention")
    return events.select(F.col("user_id").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("event_id") % 7).alias("ref"))


def console_events(events: DataFrame) -> DataFrame:
    """Events as a console's: views are interim mentions and signups final ones, clicks select, purchases display a reference or the next verse, errors clear."""
    kinds = {"view": "mention", "signup": "mention", "click": "select", "purchase": "display_ref", "error": "clear"}
    kind = F.coalesce(*[F.when(F.col("event_type") == e, k) for e, k in kinds.items()], F.lit("mention"))
    kind = F.when((kind == "display_ref") & (F.col("event_id") % 2 == 0), "next").otherwise(kind)
    ref = F.when(kind == "select", F.col("event_id") % 3 + 1).when(~kind.isin("clear", "next"), F.col("event_id") % 7)
    return events.select(F.col("user_id").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), ref.alias("ref"), (F.col("event_type") == "signup").alias("final"))


#: Sessions of the transcripts; segments of these remainders never come, and those come twice.
SESSIONS, LOST, TWICE = 7, (11, 5), (13, 3)


def transcripts(texts: DataFrame) -> DataFrame:
    """Transcript segments of (o_orderkey, text) as they arrive: numbered by session, some lost, some twice, in no order."""
    k = F.col("o_orderkey")
    seq = F.floor(k / SESSIONS)
    rows = texts.where(k % LOST[0] != LOST[1]).select(
        (k % SESSIONS).alias("session"), seq.alias("seq"), "text", (k % 2 == 0).alias("is_final"), F.lit("ko").alias("lang"),
        F.date_format(F.timestamp_seconds(seq + 1704067200), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t_client"), F.explode(F.array_repeat(F.lit(0), F.when(k % TWICE[0] == TWICE[1], 2).otherwise(1).cast("int"))).alias("n"),
    )
    return rows.drop("n").repartition(F.xxhash64("seq", "session"))


def questions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, answers) of a resolver: views are questions; three quarters of them are answered after 0 to 80 seconds, some twice."""
    k = F.col("event_id")
    views = events.where("event_type = 'view'").select(F.col("user_id").alias("session"), k.alias("seq"), F.col("ts").cast("timestamp").alias("t_asked"))
    wait = (F.col("seq") % 9 * 10_000_000 + F.col("seq") % 2 * 1_000_000)
    times = F.array_repeat(F.lit(0), F.when(F.col("seq") % 4 == 0, 0).when(F.col("seq") % 5 == 0, 2).otherwise(1).cast("int"))
    rows = views.select("*", F.posexplode(times).alias("nth", "x"))
    at = F.timestamp_micros(F.unix_micros("t_asked") + wait).alias("t_answer")
    book = F.element_at(F.array(F.lit("gn"), F.lit("ex"), F.lit("xx")), (F.col("seq") % 3 + 1).cast("int")).alias("abbrev")
    return views, rows.select("session", "seq", at, book, (F.col("seq") % 4 + 1).cast("int").alias("ch"), (F.col("nth") + 1).alias("v"))


def stamped(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pings, messages) of clients whose clocks are off: each user's clicks are pings, all else messages with the stamps of two clocks, in microseconds."""
    k, at = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    off = F.col("user_id") % 11 * 1_000_000 - 5_000_000 + F.floor(at / 86_400_000_000) % 3 * 1000  # the client's clock drifts from day to day
    rows = events.select("event_id", "event_type", F.col("user_id").alias("session"), at.alias("t"), off.alias("off"))
    pings = rows.where("event_type = 'click'").select("session", "t", (F.col("t") + F.col("off")).alias("t0"), (F.col("t") + 20_000 + k % 7 * 1000).alias("t1"), (F.col("t") + 30_000).alias("t2"), (F.col("t") + F.col("off") + 50_000).alias("t3"), "event_id")
    messages = rows.where("event_type <> 'click'").select("event_id", "session", (F.col("t") + F.col("off")).alias("t_client"), (F.col("t") + 40_000 + k % 5 * 10_000).alias("t_recv"), (F.col("t") + 90_000 + k % 3 * 1000).alias("t_sent"), (F.col("t") + F.col("off") + 150_000).alias("t_render"))
    return pings, messages
