"""Scanning text collections for forbidden names, signature phrases and oversize items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names that are refused, the size limit in bytes and the folder it doesn't hold for.
FORBIDDEN = r"(^|/)(nkjv[^/]*|NKJV[^/]*|ko_ko[^/]*|bible_data[^/]*|b_25\.html|[^/]*\.bak)\z"
MOST_BYTES, EXEMPT = 1_048_576, "data/sample/"


def by_name(files: DataFrame, pattern: str = FORBIDDEN) -> DataFrame:
    """path, kind, detail of the files whose name is refused; content isn't read."""
    return files.where(F.col("path").rlike(pattern)).select("path", F.lit("name").alias("kind"), F.lit("").alias("detail"))


#: Lengths of the blocks that texts are cut into, and the most grams of signatures that are broadcast (some 150 bytes each in memory).
BLOCKS, MOST_GRAMS = (64, 32, 16, 8, 4, 2, 1), 300_000


def grams_of(signatures: DataFrame) -> DataFrame:
    """id, q, place, of, gram: all runs of q characters (of: how many) of the distinct signatures that aren't empty, where q is the longest block with 2q - 1 characters in the signature."""
    q = F.coalesce(*[F.when(F.char_length("signature") >= 2 * n - 1, n) for n in BLOCKS])
    runs = F.coalesce(*[F.when(F.col("q") == n, F.regexp_extract_all("signature", F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))) for n in BLOCKS])
    each = signatures.select("signature").where("signature <> ''").distinct().select(F.sha2("signature", 256).alias("id"), q.alias("q"), "signature")
    each = each.select("id", "q", runs.alias("runs"))
    return each.select("id", "q", F.size("runs").alias("of"), F.posexplode("runs").alias("place", "gram"))


def blocks_of(files: DataFrame, lengths: list[int]) -> DataFrame:
    """path, gram: the distinct blocks of each text, end to end from its start, of those lengths."""
    cut = F.concat(*[F.regexp_extract_all("text", F.lit(f"(?s).{{{n}}}"), F.lit(0)) for n in lengths])
    return files.select("path", F.explode(F.array_distinct(cut)).alias("gram"))


def anchors_of(grams: DataFrame, seen: DataFrame, lengths: list[int]) -> DataFrame:
    """id, gram: of each signature those q runs in a row that the fewest texts hold as blocks; seen: gram, n (texts)."""
    counted = grams.join(seen, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = Window.partitionBy("id").orderBy("place")
    together = F.coalesce(*[F.when(F.col("q") == n, F.sum("n").over(row.rowsBetween(0, n - 1))) for n in lengths])
    windows = counted.select("id", "q", "of", "place", together.alias("n")).where("place <= of - q")
    best = windows.groupBy("id").agg(F.min(F.struct("n", "place"))["place"].alias("from"))
    return grams.join(best, "id").where("place between from and from + q - 1").select("id", "gram").distinct()


def by_signature(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """path, kind, detail for each file (path, text) and signature (signature) that it contains; null and empty signatures are in no file, nor is any in a null text.

    Texts are cut into blocks of q characters. A signature of 2q - 1 characters or more covers a whole block wherever it stands, so
    one of any q runs in a row of its own is a block of each text that contains it: q equal keys find all its texts, whatever its language and
    number of words. Of its runs those that the fewest texts hold are taken, so a frequent word or phrase is no key unless the signature is
    nothing else. Only what meets is compared. Grams of signatures are counted first, in a job of their own, and broadcast up to MOST_GRAMS, so that
    the blocks of texts aren't shuffled; beyond that both sides are joined by Spark's choice.
    """
    grams = grams_of(signatures)
    sizes = {r["q"]: r["count"] for r in grams.groupBy("q").count().collect()}
    if not sizes:
        return files.where(F.lit(False)).select("path", F.lit("signature").alias("kind"), F.lit("").alias("detail"))
    bounded = F.broadcast if sum(sizes.values()) <= MOST_GRAMS else lambda df: df
    blocks = blocks_of(files, sorted(sizes))
    seen = blocks.join(bounded(grams.select("gram").distinct()), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    met = blocks.join(bounded(anchors_of(grams, seen, sorted(sizes))), "gram").select("path", "id").distinct()
    whole = signatures.select("signature").where("signature <> ''").distinct().withColumn("id", F.sha2("signature", 256))
    hits = files.select("path", "text").join(met.join(whole, "id").drop("id"), "path").where(F.contains("text", "signature"))
    return hits.select("path", F.lit("signature").alias("kind"), F.col("signature").alias("detail"))


def by_size(files: DataFrame, most: int = MOST_BYTES, exempt: str = EXEMPT) -> DataFrame:
    """path, kind, detail (bytes) of the files (path, length) over the limit outside the exempt folder; a null length is reported as unreadable."""
    over = F.col("length").isNull() | (F.col("length") > most)
    detail = F.coalesce(F.col("length").cast("string"), F.lit("unreadable"))
    return files.where(over & ~F.col("path").startswith(exempt)).select("path", F.lit("size").alias("kind"), detail.alias("detail"))


def violations(files: DataFrame, signatures: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """path, kind, detail of all that is wrong with files (path, text, length); a refused name is all that is said of its file."""
    rest = files.where(~F.col("path").rlike(FORBIDDEN))
    return by_name(files).unionByName(by_signature(rest, signatures)).unionByName(by_size(rest, most))


def verdict(files: DataFrame, found: DataFrame) -> DataFrame:
    """One row: checked, violations, blocked."""
    return files.agg(F.count("*").alias("checked")).crossJoin(F.broadcast(found.agg(F.count("*").alias("violations")))).withColumn("blocked", F.col("violations") > 0)
