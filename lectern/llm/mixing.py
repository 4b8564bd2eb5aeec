"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source has the same expected number of copies, its source's target over its size. The whole part
is certain; the fractional parts are inclusion probabilities that a flight moves through the null space of two
constraints, the source's expected words and expected documents, until no more than two are fractional. Sources are
flown in blocks, and what the blocks leave over is flown again, in as many levels as it takes to come down to one
block, whose last one or two documents are landed, with a few small ones to make up what that takes too much or too little.
Targets are settled by sums over the sources' table, so there may be any number of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, cut, parts, unused

#: Documents of a block, and the smallest of it that fly in the next level only, so that the last landing has small ones to choose from.
BLOCK, HELD = 4_096, 32
#: Tables of up to so many sources are broadcast.
FEW_SOURCES = 100_000
WEIGHTS = (3.0, 1.0, 2.0)


def targeted(sources: DataFrame, share: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (source, size, n) with source_no and target, the words that each gives: share of all words by weight, at most most times its own.

    source_no counts from 0 in code point order, null last, and gives the weights in turn. What a source can't give is shared again
    among the rest by weight, until none is above its most. Only sums come to the driver, once for each round of sharing.
    """
    spark, low = sources.sparkSession, F.lit((1 << 33) - 1)
    ordered = sources.repartitionByRange(parts(sources), F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    ordered = cut(ordered.withColumn("__place", F.monotonically_increasing_id()))
    counts, before, bases = sorted(ordered.groupBy(F.shiftright("__place", 33).alias("p")).count().collect()), 0, []
    for p, n in counts:
        bases.append((p, before))
        before += n
    base = F.broadcast(spark.createDataFrame(bases, "__part long, __base long"))
    numbered = ordered.join(base, F.shiftright("__place", 33) == F.col("__part"))
    number = F.col("__base") + F.col("__place").bitwiseAND(low)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    numbered = cut(numbered.select("source", "size", "n", number.alias("source_no"), weight.alias("__weight")))
    cap = most * F.col("size")
    whole = numbered.agg(F.sum("size")).first()[0] or 0
    left, per, over, done = min(share, most) * whole, 0.0, F.col("size") <= 0, None
    while True:
        sums = numbered.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.sum(F.when(~over, F.col("__weight"))), F.count_if(~over)).first()
        if sums[2] in (0, done):
            break
        per, done = (left - sums[0]) / sums[1], sums[2]
        over = (F.col("size") <= 0) | (F.lit(per) * F.col("__weight") > cap)
    return numbered.withColumn("target", F.when(over, cap).otherwise(F.lit(per) * F.col("__weight"))).drop("__weight")


def flown(sizes: list[float], chances: list[float], rng, land: bool) -> list[float]:
    """Probabilities after the flight: 0 or 1 but for two at most, which land makes 0 or 1 too.

    The sums of the probabilities and of probability times size stay what they were until the landing.
    """
    p, near = list(chances), 1e-9
    draws = iter(rng.random(2 * len(p) + 4).tolist())
    live: list[int] = []

    def move(u: list[float]) -> None:
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(live, u) if x), default=0.0)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(live, u) if x), default=0.0)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(live, u):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] < near or p[i] > 1 - near:
                p[i] = float(round(p[i]))
        live[:] = [i for i in live if 0 < p[i] < 1]

    for i in range(len(p)):
        if 0 < p[i] < 1:
            live.append(i)
        if len(live) == 3:
            a, b, c = (sizes[k] for k in live)
            scale = max(abs(c - b), abs(a - c), abs(b - a))
            move([(c - b) / scale, (a - c) / scale, (b - a) / scale] if scale else [1.0, -1.0, 0.0])
    if len(live) == 2 and sizes[live[0]] == sizes[live[1]]:
        move([1.0, -1.0])
    if land:
        if len(live) == 2:
            move([1.0, -1.0])
        for i in live:
            p[i] = float(next(draws) < p[i])
        # What the landing takes too much or too little is made up by whole documents, the largest that fit first.
        lack = sum((c - x) * s for c, x, s in zip(chances, p, sizes))
        for i in sorted(range(len(p)), key=lambda i: -sizes[i]):
            if 0 < chances[i] < 1 and 0 < sizes[i] <= abs(lack) and p[i] == float(lack < 0):
                p[i] = 1 - p[i]
                lack += sizes[i] if p[i] == 0 else -sizes[i]
    return p


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words of text, 0 for a null one."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def _drawn(rows: DataFrame, share: float, most: float, weights: tuple, seed: int) -> DataFrame:
    """rows (row, doc_id, source, size, mark) with source_size, target and copies; row is a number of its own for each row."""
    sources = targeted(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), share, most, weights)
    expected = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    sure = F.floor(expected)
    known = sources.select(F.col("source").alias("__source"), "source_no", F.col("size").alias("source_size"), "target", sure.cast("int").alias("sure"), (expected - sure).alias("chance"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    few = known.count() <= FEW_SOURCES
    open_ = rows.join(F.broadcast(known) if few else known, rows["source"].eqNullSafe(F.col("__source"))).drop("__source")
    schema, done, level = open_.schema, [], 0

    def fly(key, pdf):
        import numpy as np

        number, block, count = key
        pdf = pdf.iloc[np.lexsort((pdf["row"], pdf["doc_id"].fillna(-1), pdf["order"], -pdf["size"]))]
        rng = np.random.default_rng([seed, level, int(number), int(block)])
        sizes, chances = pdf["size"].tolist(), pdf["chance"].tolist()
        n = len(sizes) if count == 1 else max(0, len(sizes) - HELD)
        return pdf.assign(chance=flown(sizes[:n], chances[:n], rng, count == 1) + chances[n:])[schema.names]

    while True:
        # Rows with an id are dealt out by it and by the text, so that draws don't depend on the layout; only without one the row counts.
        order = F.xxhash64("doc_id", "mark", F.when(F.col("doc_id").isNull(), F.col("row")), F.lit(seed + level))
        flight = open_.withColumn("order", order).withColumn("block", F.pmod(F.shiftright("order", 7), F.col("blocks")))
        flight = cut(flight.groupBy("source_no", "block", "blocks").applyInPandas(fly, schema))
        done.append(flight.where("chance in (0, 1)"))
        open_ = flight.where("chance not in (0, 1)").withColumn("blocks", F.ceil((2 + HELD) * F.col("blocks") / BLOCK))
        level += 1
        if (flight.agg(F.max("blocks")).first()[0] or 1) <= 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.withColumn("copies", (F.col("sure") + F.col("chance")).cast("int"))


def _marked(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size, mark (a hash of the text) of the rows of docs, which have row."""
    rows = sized(docs.select("row", docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text")))
    return rows.select("row", "doc_id", "source", "size", F.xxhash64("text").alias("mark"))


def mixture(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 0) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, copies, taken (copies times size).

    docs: doc_id, text, source. Sources in code point order, null last, get the weights in turn, over and over. Rows that
    repeat a doc_id are drawn each for itself, as are rows without one. A document without words counts as a document and takes 0
    words. Draws depend on seed and on the block, whose order is by size, hash and doc_id: reruns agree.
    """
    rows = cut(_marked(docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())))
    return _drawn(rows, share, most, weights, seed).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 0) -> DataFrame:
    """docs (all columns) with each row as often as the mixture takes it: not at all, once or more.

    Rows are told apart by their place in a written table, so those that repeat or lack a doc_id are taken each as it is drawn.
    """
    place, n = unused(docs, "__row"), unused(docs, "__copies")
    placed = cut(docs.withColumn(place, F.monotonically_increasing_id()))
    rows = cut(_marked(placed.select(F.col(place).alias("row"), "doc_id", "source", "text")))
    copies = _drawn(rows, share, most, weights, seed).where("copies > 0").select(F.col("row").alias(place), F.col("copies").alias(n))
    often = placed.join(copies, place)
    return often.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*[often[c] for c in docs.columns])
