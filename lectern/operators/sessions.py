"""Session context, relative references, repeat suppression and ranking, as joins and windows over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.shared import checkpointed


#: Slices of time that sessions are split into, with about equal numbers of rows of all sessions together.
SLICES = 64


def sliced(rows: DataFrame, at: str, slices: int = SLICES) -> DataFrame:
    """rows with __slice: a number that grows with the time at (a long). No slice has many more rows than its share, whatever session they are of."""
    bounds = sorted(set(rows.approxQuantile(at, [i / slices for i in range(1, slices)], 0.25 / slices))) if slices > 1 else []
    return rows.withColumn("__slice", sum((F.when(F.col(at) >= b, 1).otherwise(0) for b in bounds), F.lit(0)))


def scanned(rows: DataFrame, key: str, order: list[str], mark: str, name: str, forward: bool = True, own: bool = False) -> DataFrame:
    """rows (with __slice) with the last mark that isn't null before each row of its key, in the given order, as the column name.

    A segmented scan: each slice of a key is a window of its own; the last marks of slices, one row each, are scanned by key
    and handed to the slices after them. forward: else the first mark after each row. own: a row's own mark counts too.
    """
    up, edge = (F.last, F.max_by) if forward else (F.first, F.min_by)
    place = F.when(F.col(mark).isNotNull(), F.struct(*order))  # rows without a mark are passed over
    every = rows.groupBy(key, "__slice").agg(edge(F.struct(F.col(mark).alias("m")), place).alias("__end"))
    by = Window.partitionBy(key).orderBy("__slice")
    by = by.rowsBetween(Window.unboundedPreceding, -1) if forward else by.rowsBetween(1, Window.unboundedFollowing)
    carried = every.select(F.col(key).alias("__k"), F.col("__slice").alias("__s"), up("__end", ignorenulls=True).over(by).alias("__carried"))
    within = Window.partitionBy(key, "__slice").orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, 0 if own else -1) if forward else within.rowsBetween(0 if own else 1, Window.unboundedFollowing)
    near = up(F.when(F.col(mark).isNotNull(), F.struct(F.col(mark).alias("m"))), ignorenulls=True).over(within)
    found = rows.withColumn("__near", near).join(carried, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__slice") == F.col("__s")))
    return found.withColumn(name, F.coalesce("__near", "__carried")["m"]).drop("__near", "__k", "__s", "__carried")


def with_context(events: DataFrame, session: str, ts: str, order: str, displayed: Column, clears: Column, slices: int = SLICES) -> DataFrame:
    """events with context: what the session displayed last before each event, null after a clear or before the first display.

    An as-of join of the events with their own displays, as a scan over slices of time, so a session of very many events is read by several tasks. A
    clear is a display of nothing: it is carried as a struct that holds a null, so that it isn't skipped.
    """
    mark = F.when(displayed.isNotNull() | clears, F.struct(F.when(~clears, displayed).alias("ref")))
    rows = sliced(events.withColumns({"__mark": mark, "__at": F.unix_micros(F.col(ts).cast("timestamp"))}), "__at", slices)
    found = scanned(rows, session, ["__at", order], "__mark", "__last")
    return found.select(*events.columns, F.col("__last")["ref"].alias("context"))


def looked_up(mentions: DataFrame, catalog: DataFrame) -> DataFrame:
    """mentions with to_ch, to_v, rolled_over and found: whether the catalog has what is meant.

    mentions: abbrev, ch, v (the context), kind and n (a verse or chapter, or null). Kinds: verse, same_chapter and return (verse n of the
    context's chapter), next, previous, next_chapter, chapter (n). catalog: corpus.neighbours. The next verse after a chapter's last is the
    next chapter's first; a chapter is shown from its first verse.
    """
    own, kind = mentions.columns, F.col("kind")
    near = catalog.select(F.col("abbrev").alias("__b"), F.col("ch").alias("__c"), F.col("v").alias("__v"), "next_ch", "next_v", "previous_v")
    df = mentions.join(near, (F.col("abbrev") == F.col("__b")) & (F.col("ch") == F.col("__c")) & (F.col("v") == F.col("__v")), "left")
    to_ch = F.when(kind == "next", F.col("next_ch")).when(kind == "next_chapter", F.col("ch") + 1).when(kind == "chapter", F.col("n")).otherwise(F.col("ch"))
    to_v = F.when(kind == "next", F.col("next_v")).when(kind == "previous", F.col("previous_v")).when(kind.isin("next_chapter", "chapter"), 1).otherwise(F.col("n"))
    over = F.coalesce((kind == "next") & (F.col("next_ch") != F.col("ch")), F.lit(False))
    df = df.select(*own, F.when(F.col("__b").isNotNull(), to_ch).alias("to_ch"), F.when(F.col("__b").isNotNull(), to_v).alias("to_v"), over.alias("rolled_over"))
    there = catalog.select(F.col("abbrev").alias("__b"), F.col("ch").alias("__c"), F.col("v").alias("__v")).distinct().withColumn("__there", F.lit(True))
    hit = (F.col("abbrev") == F.col("__b")) & (F.col("to_ch") == F.col("__c")) & (F.col("to_v") == F.col("__v"))
    return df.join(there, hit, "left").select(*own, "to_ch", "to_v", "rolled_over", F.col("__there").isNotNull().alias("found"))


def relative(mentions: DataFrame, catalog: DataFrame) -> DataFrame:
    """The columns of mentions with to_ch, to_v, rolled_over: a mention without context, or of a verse that isn't there, has no row."""
    return looked_up(mentions, catalog).where("found").drop("found")


def since_last(events: DataFrame, keys: list[str], ts: str, order: str, seconds: int) -> DataFrame:
    """events with suppressed: whether the same keys were mentioned less than seconds before."""
    gap = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, order))
    return events.withColumn("suppressed", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(gap.cast("timestamp")) < seconds * 1_000_000, F.lit(False)))


def with_last(rows: DataFrame, key: str, order: list[str], value: str, n: int, slices: int = SLICES) -> DataFrame:
    """rows with __last: an array of the values of the last n rows of its key up to each row; order begins with a time (a long).

    The last n of each slice of time are handed on to the slice after it, so a key is read by several tasks. A slice with fewer rows hands on its predecessors' too.
    """
    rows = sliced(rows, order[0], slices)
    place = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    tail = lambda a: F.slice(F.array_sort(a), F.greatest(F.lit(1), F.size(a) - n + 1), n)
    within = Window.partitionBy(key, "__slice").orderBy(*order)
    near = rows.withColumn("__near", F.collect_list(place).over(within.rowsBetween(-(n - 1), 0)))
    ends = near.groupBy(key, "__slice").agg(F.max_by("__near", F.struct(*order)).alias("__end"))
    # A slice's own tail has n rows, or all it has; n slices back there are n rows of the key, if there are so many.
    before = F.flatten(F.collect_list("__end").over(Window.partitionBy(key).orderBy("__slice").rowsBetween(-n, -1)))
    carried = ends.select(F.col(key).alias("__k"), F.col("__slice").alias("__s"), tail(before).alias("__carried"))
    found = near.join(carried, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__slice") == F.col("__s")))
    last = tail(F.concat("__carried", "__near"))
    return found.select(*[c for c in rows.columns if c != "__slice"], F.transform(last, lambda x: x["v"]).alias("__last"))


#: Events of a chain of repeats without a pause that one task reads; those of longer ones find their emissions by doubling pointers.
CHAIN = 100_000


def throttled(events: DataFrame, keys: list[str], ts: str, order: str, seconds: int, slices: int = SLICES, chain: int = CHAIN) -> DataFrame:
    """keys, order and emitted: whether no event of the same keys was emitted less than seconds before.

    An event that no other precedes within the time is always emitted, so events fall apart into chains there. Chains are dealt out and read in
    order; a task holds one time, not a group. In chains of more than chain events each event points to the one that would be emitted after it, and what
    is reached from the first one is found in as many rounds as the logarithm of the emissions, so neither a key nor a chain is one task.
    """
    wait = seconds * 1_000_000
    rows = events.select(*keys, order, F.struct(*keys).alias("__key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")).withColumn("__id", F.monotonically_increasing_id())
    rows = scanned(sliced(rows, "__at", slices), "__key", ["__at", order], "__at", "__before")
    starts = F.coalesce(F.col("__at") - F.col("__before") >= wait, F.lit(True))
    rows = rows.withColumn("__start", F.when(starts, F.struct(F.col("__at").alias("at"), F.col(order).alias("order"))))
    rows = checkpointed(scanned(rows, "__key", ["__at", order], "__start", "__chain", own=True).drop("__before"))
    long = rows.groupBy("__key", "__chain").agg(F.count("*").alias("__n")).where(F.col("__n") > chain).select(F.col("__key").alias("__k"), F.col("__chain").alias("__c"))
    in_long = F.col("__key").eqNullSafe(F.col("__k")) & F.col("__chain").eqNullSafe(F.col("__c"))
    short = _read_in_order(rows.join(long, in_long, "left_anti"), keys, order, wait)
    if not long.limit(1).count():
        return short
    rest = rows.join(long, in_long, "left_semi")
    emitted = _reached(rest, order, wait).withColumn("emitted", F.lit(True))
    return short.unionByName(rest.join(emitted, "__id", "left").select(*keys, order, F.coalesce("emitted", F.lit(False)).alias("emitted")))


def _read_in_order(rows: DataFrame, keys: list[str], order: str, wait: int) -> DataFrame:
    """keys, order, emitted of rows, whose chains are read one after the other."""
    dealt = rows.repartition("__key", "__chain").sortWithinPartitions("__key", "__chain", "__at", order)
    dealt = dealt.select(*keys, order, "__at", F.xxhash64("__key", "__chain").alias("__hash"))

    def run(batches: Iterator) -> Iterator:
        key = last = None
        for pdf in batches:
            emitted = []
            for k, t in zip(pdf["__hash"], pdf["__at"]):
                emitted.append(k != key or t - last >= wait)
                if emitted[-1]:
                    key, last = k, t
            yield pdf.drop(columns=["__hash", "__at"]).assign(emitted=emitted)

    kinds = dict(rows.dtypes)
    return dealt.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, order]) + ", emitted boolean")


def _reached(rows: DataFrame, order: str, wait: int) -> DataFrame:
    """__id of the rows (__id, __key, __chain, __at, order) that are emitted: those reached from their chain's first."""
    chains = rows.select("__id", F.struct("__key", "__chain").alias("__group"), "__at", order, F.struct("__at", order).alias("__place"))
    # A probe lies where its event may be followed; of what has one time, probes come first.
    probes = chains.select("__group", (F.col("__at") + wait).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(dict(rows.dtypes)[order]).alias(order), F.col("__id").alias("__from"), F.lit(None).cast("long").alias("__to"))
    both = probes.unionByName(chains.select("__group", "__at", F.lit(1).alias("__kind"), order, F.lit(None).cast("long").alias("__from"), F.col("__id").alias("__to")))
    found = scanned(sliced(both, "__at", SLICES), "__group", ["__at", "__kind", order, "__from", "__to"], "__to", "__next", forward=False)
    jumps = checkpointed(found.where(F.col("__from").isNotNull() & F.col("__next").isNotNull()).select(F.col("__from").alias("__id"), "__next"))
    reached = checkpointed(chains.groupBy("__group").agg(F.min_by("__id", "__place").alias("__id")).select("__id"))
    n, before = reached.count(), 0
    while n > before:
        reached = checkpointed(reached.union(reached.join(jumps, "__id").select(F.col("__next").alias("__id"))).distinct())
        onward = jumps.select(F.col("__id").alias("__next"), F.col("__next").alias("__then"))
        jumps = checkpointed(jumps.join(onward, "__next").select("__id", F.col("__then").alias("__next")))
        before, n = n, reached.count()
    return reached


def one_candidate(segments: DataFrame, keys: list[str], seq: str, final: str) -> DataFrame:
    """One row for each candidate of interim and final segments: keys, id (from its first segment), seq of its latest, confirmed."""
    best = segments.groupBy(*keys).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.bool_or(final).alias("confirmed"))
    return best.withColumn("id", F.sha2(F.concat_ws("|", *keys, "first_seq"), 256))


def latest(candidates: DataFrame, session: str, ts: str, order: str, k: int = 5) -> DataFrame:
    """The last k candidates of each session with their place, newest first. The limit is pushed below the shuffle."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(ts), F.desc(order)))
    return candidates.withColumn("place", place).where(F.col("place") <= k)


def marked(candidates: DataFrame, displays: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """candidates with displayed: whether displays (keys, ts) has their reference at their time or later. Displays are combined before the shuffle."""
    last = displays.groupBy(*keys).agg(F.max(ts).alias("__shown"))
    return candidates.join(last, keys, "left").withColumn("displayed", F.coalesce(F.col("__shown") >= F.col(ts), F.lit(False))).drop("__shown")


def ranked(candidates: DataFrame, segment: str) -> DataFrame:
    """candidates with rank: their place by confidence among those of their segment, equal ones in the order in which they are said."""
    order = Window.partitionBy(segment).orderBy(F.desc("confidence"), "start", "item")
    return candidates.withColumn("rank", F.row_number().over(order))


def united(rules: DataFrame, context: DataFrame, others: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """All candidates that the catalog has (abbrev, ch, v), one for each keys and reference; rules go before context before others."""
    every = rules.withColumn("rank", F.lit(0)).unionByName(context.withColumn("rank", F.lit(1))).unionByName(others.withColumn("rank", F.lit(2)))
    best = every.groupBy(*keys, "abbrev", "ch", "v").agg(F.min("rank").alias("rank"))
    named = best.withColumn("source", F.element_at(F.array(*map(F.lit, ("rule", "context", "llm"))), F.col("rank") + 1)).drop("rank")
    return named.join(catalog.select("abbrev", "ch", "v").distinct(), ["abbrev", "ch", "v"], "left_semi").select(*keys, "abbrev", "ch", "v", "source")
