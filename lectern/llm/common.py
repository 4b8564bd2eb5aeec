"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lectern-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


#: Spark's setting by which a query that was planned under it removes its shuffle files as soon as it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read on from there, so that lost executors cost no recomputation.

    The shuffles behind it aren't read again. Their files go at once, where else they stay until the driver happens to collect its garbage, so
    that the steps of an operator don't add up on disk. Only the query planned here runs under that setting: df itself may be run again.
    """
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts that a task gives to its Python worker at once, at most.
BATCH = 2_500


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, whose session from now on gives Python workers batches of BATCH rows at most, as buffers of whole texts grow with the rows.

    A smaller number that the user has set stays. The numbers of rows and batches change no result.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))
    return docs


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it: the optimiser copies what is named twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores behind it as make it none of df's columns (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sampled(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About rows rows of df, 2 * rows at most, the same ones in every run: those whose by columns hash low.

    Tasks pass on only what is in the sample, so the driver gets no more when there are more tasks. Tables of up to rows rows are whole.
    """
    n, steps = df.count(), 1 << 30
    if n <= rows:
        return df
    low = F.pmod(F.xxhash64(*by), F.lit(steps))
    return df.where(low < int(steps * rows / n)).orderBy(low, *by).limit(2 * rows)


#: Rows with one key that a task joins, about.
HOT = 200_000


def joined(rows: DataFrame, side: DataFrame, key: str, how: str = "left", hot: int = HOT) -> DataFrame:
    """rows with the columns of side (one row a key), keys of more than hot rows dealt over several tasks.

    rows must have no nulls in key. The hot keys are broadcast, of which there are no more than rows / hot.
    """
    often = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select(key, F.ceil(F.col("__n") / hot).cast("int").alias("__parts")))
    parts_ = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(often, key, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts_).cast("int")).drop("__parts")
    each = side.join(often, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts_ - 1))).drop("__parts")
    return dealt.join(each, [key, "__part"], how).drop("__part")
