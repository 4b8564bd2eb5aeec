"""Corpus files: the script form with a book, or a part of a long one, a line, JSON sources, line sources plain or zipped."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import canon
from lectern.operators import corpus

# The lines around the books of a corpus script.
HEAD, META, BOOKS, END = "window.BIBLE_DATA = {", '"meta":', '"books":[', "]};"
RECORD = "a string, en string, ko string, c array<array<array<string>>>"
#: The number of the first chapter of a part of a long book, where a record or a source's row is one.
AT = ", at int"
SOURCE = "abbrev string, chapters array<array<string>>"
META_SCHEMA = "title string, langs array<string>, names map<string,string>, demo boolean, source string"


def write_script(records: DataFrame, meta: DataFrame, path: str) -> None:
    """Writes corpus records (ord, a, en, ko, c, at or not) and a one-row meta as a corpus script under path: a folder of text files.

    Line 1 is the wrapper, line 2 the meta, line 3 opens the books, then comes a book a line, all but the last with a comma. A part that continues a
    long book has a line of its own with the number of its first chapter. Lines are sorted by range, so many tasks write; the files in
    the order of their names are the script. A small corpus is one file.
    """
    at = F.coalesce("at", F.lit(1)) if "at" in records.columns else F.lit(1)
    rows = records.withColumns({"__n": F.col("ord") + 2, "at": at})
    last = rows.agg(F.max(F.struct("__n", "at")).alias("__last"))
    body = F.to_json(F.struct("a", "en", "ko", "c", F.when(F.col("at") > 1, F.col("at")).alias("at")))
    lines = rows.crossJoin(F.broadcast(last)).select("__n", "at", F.concat(body, F.when(F.struct("__n", "at") < F.col("__last"), ",").otherwise("")).alias("value"))
    top = [F.lit(HEAD), F.concat(F.lit(META), F.to_json(F.struct("*")), F.lit(",")), F.lit(BOOKS), F.lit(END)]
    around = meta.select(F.explode(F.array(*[F.struct(F.lit(i if i < 3 else 1 << 30).alias("__n"), F.lit(0).alias("at"), v.alias("value")) for i, v in enumerate(top)])).alias("l")).select("l.*")
    around.unionByName(lines).orderBy("__n", "at").select("value").write.text(path)


def read_script(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, meta) of a corpus script with a book, or a part of one, a line; its files are read line by line in parallel."""
    lines = spark.read.text(path)
    body = F.regexp_replace("value", r",\z", "")
    books = lines.where(F.col("value").startswith('{"a":')).select(F.from_json(body, RECORD + AT).alias("b")).select("b.*")
    whole = F.coalesce("a", F.raise_error(F.lit("a malformed book in a corpus script")).cast("string"))
    books = books.select(whole.alias("a"), "en", "ko", "c", F.coalesce("at", F.lit(1)).alias("at"))
    meta = lines.where(F.col("value").startswith(META)).select(F.from_json(F.substring(body, len(META) + 1, 2**31 - 1), META_SCHEMA).alias("m")).select("m.*")
    return books, meta


def read_any_script(spark: SparkSession, path: str) -> DataFrame:
    """The records of a corpus script of any layout in one file: the text after the first = up to the last ; is one JSON value."""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?s)^[^=]*=\s*(.*?);?\s*\z", 1)
    books = "books array<struct<a: string, en: string, ko: string, c: array<array<array<string>>>, at: int>>"
    return whole.select(F.inline(F.from_json(body, books).getField("books")))


def read_combined(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records (a, en, ko, c, at) of a combined JSON array, or of one object a line, which can be read in parallel; at: see corpus.parts."""
    return spark.read.schema(RECORD + AT).json(path, multiLine=not lines, mode="FAILFAST").withColumn("at", F.coalesce("at", F.lit(1)))


def read_source(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(abbrev, chapters, at) of a single-language JSON array, or of one object a line; at: see corpus.parts."""
    return spark.read.schema(SOURCE + AT).json(path, multiLine=not lines, mode="FAILFAST").withColumn("at", F.coalesce("at", F.lit(1)))


def with_fallback(primary: DataFrame, sample: DataFrame) -> DataFrame:
    """primary, or sample if primary has no row."""
    any_ = primary.limit(1).select(F.lit(1).alias("__any"))
    return primary.unionByName(sample.join(F.broadcast(any_), F.lit(True), "left_anti"))


def first_readable(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists on its file system; raises if none does."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(", ".join(paths))


def read_lines(spark: SparkSession, path: str, member: str = "_vpl.txt") -> DataFrame:
    """path, line_no, value of line sources: UTF-8 texts, or zip files of which the first member with that ending counts.

    A mark at the start of a text is dropped. A zip file without such a member raises an error that names it. Lines are decoded
    one after the other, so a task holds a file's bytes but no list of its lines.
    """

    def lines(batches: Iterator) -> Iterator:
        import io
        import itertools
        import zipfile

        import pandas as pd

        def text_of(name: str, stored: bytes):
            if not stored.startswith(b"PK"):
                return io.BytesIO(stored)
            archive = zipfile.ZipFile(io.BytesIO(stored))
            fitting = [entry for entry in archive.infolist() if entry.filename.endswith(member)]
            if not fitting:
                raise ValueError(f"{name}: no member that ends in {member}")
            return archive.open(fitting[0])

        for pdf in batches:
            for name, stored in zip(pdf["path"], pdf["content"]):
                with io.TextIOWrapper(text_of(name, stored), encoding="utf-8-sig") as text:
                    numbered = enumerate((part for line in text for part in line.splitlines()), 1)
                    while some := list(itertools.islice(numbered, 10_000)):
                        yield pd.DataFrame({"path": name, "line_no": [n for n, _ in some], "value": [v for _, v in some]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "path string, line_no int, value string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, length of files to scan; the content is read only if text is used."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"), "length")


# The names that a two-sided corpus has unless others are given.
NAMES = {"ko": "개역한글", "en": "NKJV"}
CASE = "input string, lang string, context string, expected string"
LATENCY = "session long, hop string, ms double"


def build(spark: SparkSession, combined: str | None = None, ko: str | None = None, en: str | None = None, ko_name: str = NAMES["ko"], en_name: str = NAMES["en"], lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, meta) of a corpus from one combined JSON file, which goes first, or from a file for each side; raises ValueError if neither is given.

    records: ord, a, en, ko, c, at; those of a combined file outside the canon come last. lines: files of one object a line. meta always names both languages.
    """
    if combined:
        known = canon.books(spark).select(F.col("abbrev").alias("a"), "ord")
        found = corpus.parts(read_combined(spark, combined, lines), "c").join(F.broadcast(known), "a", "left")
        records = found.select(F.coalesce("ord", F.lit(len(canon.BOOKS) + 1)).alias("ord"), "a", "en", "ko", "c", "at")
    elif ko and en:
        last = lambda path: corpus.last_wins(read_source(spark, path, lines).withColumn("__row", F.monotonically_increasing_id()), ["abbrev", "at"], "__row").drop("__row")
        records = corpus.merged(last(ko), last(en))
    else:
        raise ValueError("give a combined file, or one for each side")
    meta = spark.createDataFrame([(f"{ko_name} + {en_name}", ["ko", "en"], {"ko": ko_name, "en": en_name})], "title string, langs array<string>, names map<string,string>")
    return records, meta


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Parser cases (CASE), one JSON object a line; a malformed line raises."""
    return spark.read.schema(CASE).json(path, mode="FAILFAST")


def write_latency(rows: DataFrame, path: str) -> None:
    """Latency lines (LATENCY), one JSON object a hop."""
    rows.select("session", "hop", "ms").write.mode("append").json(path)


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LATENCY).json(path, mode="FAILFAST")
