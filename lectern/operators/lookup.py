"""Parsing typed references and resolving them against aligned verses.

Books and aliases are dimensions of fixed size (66 and 369 rows) and are broadcast; verses are joined by their key, so Spark
may broadcast or shuffle them as their size asks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import canon
from lectern.functions import references as R
from lectern.operators import corpus


def parsed(refs: DataFrame, raw: str = "raw", aliases: DataFrame | None = None) -> DataFrame:
    """refs with abbrev, ch, v1, v2; all null where raw isn't a reference. Null raw: null.

    A name has up to four tokens, and at least one must follow it. The prefixes that leave a chapter and verse are found in one
    expression, each is looked up by a join with the aliases (broadcast if they are the canon's, of fixed size), and the longest that names a book wins.
    """
    known = F.broadcast(canon.aliases(refs.sparkSession)) if aliases is None else aliases
    df = refs.withColumn("__found", R.once(R.tokens(F.col(raw)), R.prefixes))
    at = lambda i: F.get("__found", F.lit(i))
    for i in range(R.PREFIXES):
        side = known.select(F.col("alias").alias(f"__key{i}"), F.col("abbrev").alias(f"__book{i}"))
        df = df.join(side, at(i)["key"] == F.col(f"__key{i}"), "left")
    first = F.coalesce(*[F.when(F.col(f"__book{i}").isNotNull(), F.struct(F.col(f"__book{i}").alias("abbrev"), at(i)["ref"].alias("ref"))) for i in range(R.PREFIXES)])
    return df.select(*refs.columns, first.alias("__ref")).select(*refs.columns, "__ref.abbrev", "__ref.ref.*")


def verses_of(refs: DataFrame, verses: DataFrame) -> DataFrame:
    """A row for each verse of each parsed reference: the columns of refs, num, ko, en.

    verses: abbrev, ch, v, ko, en. Without a first verse (or with verse 0) the range starts at the chapter's first; without a
    last one (or with 0) it ends at the first verse given, or the chapter's last. Ranges beyond the chapter
    are clipped, inverted ones are empty.
    """
    start = F.coalesce(F.nullif("v1", F.lit(0)), F.lit(1))
    end = F.coalesce(F.nullif("v2", F.lit(0)), F.nullif("v1", F.lit(0)), F.lit(2**31 - 1))
    wanted = refs.where("abbrev is not null and ch > 0").withColumns({"__from": start, "__to": end})
    side = verses.select(F.col("abbrev").alias("__book"), F.col("ch").cast("decimal(38,0)").alias("__ch"), F.col("v").alias("num"), "ko", "en")
    hit = (F.col("abbrev") == F.col("__book")) & (F.col("ch") == F.col("__ch")) & F.col("num").between(F.col("__from"), F.col("__to"))
    return wanted.join(side, hit).select(*refs.columns, "num", "ko", "en")


def shown(refs: DataFrame, verses: DataFrame, key: str) -> DataFrame:
    """key, nums, ko, en of each reference that is found: its verses in their order, numbers with commas and texts with line breaks between.

    A row holds one chapter's verses at most.
    """
    rows = verses_of(refs, verses).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("num", "ko", "en"))).alias("__v"))
    joined = lambda c, by: F.array_join(F.transform("__v", lambda x: x[c].cast("string")), by).alias(c)
    return rows.select(key, joined("num", ",").alias("nums"), joined("ko", "\n"), joined("en", "\n"))


def with_status(refs: DataFrame, verses: DataFrame, key: str, raw: str = "raw", loaded: bool = True) -> DataFrame:
    """key, raw, status and label of each reference: noop, loading, bad_format, not_found or ok, in this precedence.

    The label of a found one has the book's English name and the range as typed, of a missing one abbreviation, chapter and first verse.
    Whether a range holds a verse follows from the chapter's last verse, so no verse text is read.
    """
    spark = refs.sparkSession
    lengths = verses.groupBy(F.col("abbrev").alias("__book"), F.col("ch").cast("decimal(38,0)").alias("__ch")).agg(F.max("v").alias("__last"))
    names = canon.books(spark).select(F.col("abbrev").alias("__abbrev"), F.col("en").alias("__en"))
    df = parsed(refs, raw).join(lengths, (F.col("abbrev") == F.col("__book")) & (F.col("ch") == F.col("__ch")), "left")
    df = df.join(F.broadcast(names), F.col("abbrev") == F.col("__abbrev"), "left")
    start = F.coalesce(F.nullif("v1", F.lit(0)), F.lit(1))
    end = F.coalesce(F.nullif("v2", F.lit(0)), F.nullif("v1", F.lit(0)), F.col("__last"))
    there = F.col("__last").isNotNull() & F.coalesce(start <= F.least(end, F.col("__last")), F.lit(False))
    status = (
        F.when(F.coalesce(R.trimmed(F.col(raw)), F.lit("")) == "", "noop")
        .when(F.lit(not loaded), "loading")
        .when(F.col("abbrev").isNull(), "bad_format")
        .when(there, "ok")
        .otherwise("not_found")
    )
    text = F.when(F.col("status") == "ok", R.label(F.col("__en"), F.col("ch"), F.col("v1"), F.col("v2")))
    text = text.when(F.col("status") == "not_found", R.label(F.col("abbrev"), F.col("ch"), F.col("v1"), F.col("v2"), end=False))
    return df.withColumn("status", status).select(key, raw, "status", text.alias("label"))


def headers(refs: DataFrame, verses: DataFrame, meta: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, label, names ("Korean · English") and the labels of the two columns, of each reference that is found."""
    names = canon.books(refs.sparkSession).select(F.col("abbrev").alias("__abbrev"), F.concat_ws(" · ", "ko", "en").alias("names"))
    shown = corpus.view(meta).first()  # a meta has one row
    status = with_status(refs, verses, key, raw).where("status = 'ok'")
    df = parsed(status, raw).join(F.broadcast(names), F.col("abbrev") == F.col("__abbrev"))
    return df.select(key, "label", "names", F.lit(shown["ko_label"]).alias("ko_label"), F.lit(shown["en_label"]).alias("en_label"))
