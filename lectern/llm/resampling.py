"""Importance resampling towards a target's text by hashed features: each task counts in DuckDB, Spark merges and scores.

A task gives its documents in slices of bounded size to a DuckDB of its own, whose SQL takes words apart, forms runs of consecutive words
by a window, hashes each distinct run once by a registered CRC function and counts runs by document and bucket. These counts are
written to Parquet in the shared folder. Spark sums them over documents and target texts to a gain for each bucket, of which
there is a fixed number, then over each document to its weight. Gumbel noise from a hash of the doc_id makes the highest scores a draw without
replacement. The draw is ranked by a range sort and the counts of its ranges, so no task sorts or holds all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, new_folder, parts, text_of

#: Longest runs of words, buckets, percent of the documents that are drawn, words that a drawn document has at least, and the noise's seed.
RUN, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, 2024
#: Characters of the texts that a task counts at once, about; longer texts are counted one by one.
SLICE = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, after A-Z became lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COUNTS = "row long, doc_id long, bucket int, n long"


def counting_sql(run: int, buckets: int) -> str:
    """DuckDB SQL over slice(row, text): bucket and n of each document's runs, and a row with bucket -1 and the number of its words."""
    longer = [" || ' ' || ".join(["word", *[f"lead(word, {j}) OVER (PARTITION BY row ORDER BY place)" for j in range(1, i)]]) for i in range(1, run + 1)]
    runs = " UNION ALL ".join(f"SELECT row, {x} AS feature FROM words" for x in longer)
    return f"""WITH taken AS MATERIALIZED (SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS found FROM slice),
    words AS (SELECT row, unnest(found) AS word, generate_subscripts(found, 1) AS place FROM taken),
    counted AS MATERIALIZED (SELECT row, feature, count(*) AS n FROM ({runs}) WHERE feature IS NOT NULL GROUP BY row, feature),
    hashed AS (SELECT feature, zlib_crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted))
    SELECT row, CAST(bucket AS INT) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN hashed USING (feature) GROUP BY row, bucket
    UNION ALL SELECT row, -1, CAST(len(found) AS BIGINT) FROM taken ORDER BY row, bucket"""


def counter():
    """A DuckDB of one thread, which holds its tables in memory, with CRC-32 of UTF-8 as zlib_crc32."""
    import zlib

    import duckdb
    import pyarrow as pa

    def crc(column):
        return pa.array([zlib.crc32(x.encode()) for x in column.to_pylist()], pa.int64())

    db = duckdb.connect(config={"threads": 1})
    db.create_function("zlib_crc32", crc, ["VARCHAR"], "BIGINT", type="arrow")
    return db


def slices(lengths, most: int = SLICE):
    """(begin, end) of slices of about most characters, each of one text at least."""
    begin = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield begin, len(lengths)


def counts(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, bucket and n: how often runs of up to run words of each document (doc_id, text) fall in a bucket.

    Each document has one row with bucket -1 and n its words, and so has one whose text is null or without words. row numbers the rows
    of docs, so that those that repeat a doc_id stay apart.
    """
    sql = counting_sql(run, buckets)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        db = counter()
        for batch in batches:
            lengths = pc.utf8_length(batch.column("text")).to_pylist()
            for a, b in slices(lengths):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                db.register("slice", part.select(["row", "text"]))
                found = db.sql(sql).to_arrow_table()
                db.unregister("slice")
                # Only the row of the words carries the doc_id; both are in ascending order of row.
                marks = pc.equal(found.column("bucket"), -1)
                at = pc.if_else(marks, pc.subtract(pc.cumulative_sum(pc.cast(marks, pa.int64())), 1), None)
                found = found.append_column("doc_id", part.column("doc_id").combine_chunks().take(at.combine_chunks()))
                yield from found.select(["row", "doc_id", "bucket", "n"]).combine_chunks().to_batches()
        db.close()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text_of().cast("string").alias("text"))
    return rows.mapInArrow(count, COUNTS)


def spilled(found: DataFrame) -> DataFrame:
    """The counts, written to the shared folder and read from there."""
    folder = new_folder(found.sparkSession, "counts")
    found.write.parquet(folder)
    return found.sparkSession.read.schema(COUNTS).parquet(folder)


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of every bucket, from the counts of documents and target: 1,000 logarithms of the smoothed shares' ratio, rounded down."""
    both = [df.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias(name)) for df, name in ((own, "s"), (target, "t"))]
    held = cut(own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both[0], "bucket", "left").join(both[1], "bucket", "left").na.fill(0))
    all_s, all_t = held.agg(F.sum("s").cast("double"), F.sum("t").cast("double")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(all_s + buckets) / ((F.col("s") + 1).cast("double") * F.lit(all_t + buckets))
    return held.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def ranked(rows: DataFrame, least_first: list, most: int) -> DataFrame:
    """rows with rank, from 1 in the order of least_first for the first most rows and null for the others.

    Ranges are sorted each in a task, and counted; a range's first rank is the number of rows in those before it. A row number of its own
    splits rows that are equal otherwise.
    """
    rows = cut(rows.withColumn("__tie", F.monotonically_increasing_id()))
    order = [*least_first, F.col("__tie")]
    placed = rows.repartitionByRange(parts(rows), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(placed.withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))  # as many rows as there are shuffle partitions
    first = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__first"))
    rank = F.col("__first") + F.col("__at") + 1
    found = placed.join(F.broadcast(first), "__range").withColumn("rank", F.when(rank <= most, rank))
    return found.drop("__tie", "__at", "__range", "__first")


def resampled(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if it is not drawn) of every row of docs (doc_id, text), drawn towards target (text).

    A null or empty text has no features and the weight 0. Of rows with at least least words percent of a hundred are drawn, rounded down. Ties
    of score go to the lesser doc_id; rows without one come last among them, and their noise is that of an empty id.
    Rows that repeat a doc_id are ranked each for itself, with the same noise. Other columns are ignored. An empty target leaves
    smoothed counts alone; empty docs give no rows.
    """
    own = spilled(counts(docs, run, buckets))
    aim = spilled(counts(target.select(F.lit(None).cast("long").alias("doc_id"), target["text"]), run, buckets))
    gain = F.broadcast(gains(own, aim, buckets))  # as many rows as there are buckets
    features = F.col("bucket") >= 0
    weighed = own.join(gain, "bucket", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.coalesce(F.sum(F.when(features, F.col("n"))), F.lit(0)).alias("n_features"),
        F.coalesce(F.sum(F.when(features, F.col("n") * F.col("gain"))), F.lit(0)).alias("weight"),
        F.sum(F.when(~features, F.col("n"))).alias("words"),
    )
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), "words"))
    able = F.col("words") >= least
    most = scored.where(able).count() * percent // 100
    drawn = ranked(scored.where(able).drop("words"), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], most)
    return drawn.unionByName(scored.where(~able).drop("words").withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs (all columns) whose doc_id is drawn by resampled(); a repeated doc_id brings all its rows, one that is null none."""
    ids = resampled(docs, target, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == F.col("__drawn"), "left_semi")
