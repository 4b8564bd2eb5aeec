"""Reading line-oriented sources into verses, with the checks that stop a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern import canon
from lectern.functions.references import once
from lectern.functions.text import LINE, cleaned, without_mark


def parsed_lines(lines: DataFrame) -> DataFrame:
    """line_no, code, abbrev, ch, v, text of the lines (line_no, value) that have the form of a verse and a canon code.

    All other lines are dropped silently. The code join is a broadcast of the canon.
    """
    value = F.when(F.col("line_no") == 1, without_mark(F.col("value"))).otherwise(F.col("value"))
    # One pass of the pattern leaves a line of its form in four parts; a line with the mark in it is asked again.
    cut = lambda v: F.split(F.regexp_replace(v, LINE, "$1\x01$2\x01$3\x01$4"), "\x01", 4)
    fits = lambda v, p: (F.size(p) == 4) & (~F.contains(v, F.lit("\x01")) | v.rlike(LINE))
    rows = lines.select("line_no", once(value, lambda v: once(cut(v), lambda p: F.when(fits(v, p), p))).alias("p")).where("p is not null")
    rows = rows.select("line_no", F.col("p")[0].alias("code"), F.col("p")[1].cast("int").alias("ch"), F.col("p")[2].cast("int").alias("v"), F.col("p")[3].alias("text"))
    known = canon.books(lines.sparkSession).select("code", "abbrev")
    return rows.join(F.broadcast(known), "code").select("line_no", "code", "abbrev", "ch", "v", cleaned(F.col("text")).alias("text"))


def out_of_order(verses: DataFrame) -> DataFrame:
    """code, ch, line_no, v, expected of the verses whose number isn't one more than the verses before them in their chapter.

    Chapters may be interleaved. Partitions of the window are chapters.
    """
    seen = F.row_number().over(Window.partitionBy("code", "ch").orderBy("line_no"))
    return verses.withColumn("expected", seen).where("v <> expected or ch < 1").select("code", "ch", "line_no", "v", "expected")


def missing_books(verses: DataFrame) -> DataFrame:
    """ord, abbrev, en of the canon's books without any verse."""
    there = verses.select("abbrev").distinct()
    return canon.books(verses.sparkSession).join(there, "abbrev", "left_anti").select("ord", "abbrev", "en")


def ingested(lines: DataFrame, whole_canon: bool = True) -> DataFrame:
    """The verses (abbrev, ch, v, text) of a source's lines; raises on a verse out of order or a missing book."""
    verses = parsed_lines(lines)
    if wrong := out_of_order(verses).orderBy("line_no").first():
        raise ValueError(f"unexpected verse order at {wrong['code']} {wrong['ch']}:{wrong['v']}")
    if whole_canon and (missing := missing_books(verses).orderBy("ord").first()):
        raise ValueError(f"missing book {missing['en']}")
    return verses.select("abbrev", "ch", "v", "text")
