"""The parallel corpus as tables: long form, positional alignment, merge of two sources, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import canon
from lectern.functions.text import shown


#: The most chapters of a book in one row; no book of the canon has more, so its books are a row each, and longer ones are cut into parts of so many.
PART = 150


def _from(rows: DataFrame) -> Column:
    """The number of a row's first chapter: its column at, 1 where that is null or missing."""
    return F.coalesce("at", F.lit(1)) if "at" in rows.columns else F.lit(1)


def parts(source: DataFrame, chapters: str = "chapters") -> DataFrame:
    """A source or records with rows of PART chapters at most: at is the number of a row's first chapter. Books without chapters keep a row; rows that are parts stay."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(chapters), F.lit(1)), F.lit(PART))
    each = source.select(*[c for c in source.columns if c not in ("at", chapters)], _from(source).alias("__at"), F.col(chapters).alias("__all"), F.explode(F.coalesce(starts, F.array(F.lit(1)))).alias("__n"))
    cut = F.when(F.size("__all") <= PART, F.col("__all")).otherwise(F.slice("__all", F.col("__n"), F.lit(PART)))
    rows = each.withColumns({"at": F.col("__at") + F.col("__n") - 1, chapters: cut})
    return rows.select(*[c for c in source.columns if c != "at"], "at")


def long_form(books: DataFrame, chapters: str = "chapters") -> DataFrame:
    """abbrev, ch, v, text of a single-language source (abbrev, chapters: array of arrays of verses, at: number of the row's first chapter, 1 if missing); positions count from 1."""
    each = books.select("abbrev", _from(books).alias("at"), F.posexplode(chapters).alias("c", "verses"))
    return each.select("abbrev", (F.col("c") + F.col("at")).alias("ch"), F.posexplode("verses").alias("p", "text")).select("abbrev", "ch", (F.col("p") + 1).alias("v"), "text")


def aligned(ko: DataFrame, en: DataFrame) -> DataFrame:
    """abbrev, ch, v, ko, en: verses of two sides (abbrev, ch, v, text) by position, '' where a side has none."""
    left, right = ko.withColumnRenamed("text", "ko"), en.withColumnRenamed("text", "en")
    both = left.join(right, ["abbrev", "ch", "v"], "full")
    return both.select("abbrev", "ch", "v", F.coalesce("ko", F.lit("")).alias("ko"), F.coalesce("en", F.lit("")).alias("en"))


def last_wins(rows: DataFrame, key: str | list[str], position: str) -> DataFrame:
    """One row for each key (one column or several): that with the greatest position. Combined before the shuffle, so a hot key costs a row a task."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("__row"))
    return best.select(*keys, "__row.*").select(*rows.columns)


def merged(ko: DataFrame, en: DataFrame) -> DataFrame:
    """The corpus records (ord, a, en, ko, c, at) of the canon from two sources (abbrev, chapters, at or not), in canonical order.

    c: for each chapter its Korean and English verses, the shorter source padded with empty chapters; at: the number of its first chapter, as
    books of more than PART chapters have a record for each part, so no row grows with its book. Books outside the canon are
    dropped; missing ones keep one record with an empty c.
    """
    books = F.broadcast(canon.books(ko.sparkSession))
    none = F.array().cast("array<array<string>>")
    k, e = (parts(side).select("abbrev", "at", F.col("chapters").alias(name)) for side, name in ((ko, "__k"), (en, "__e")))
    # All parts but a side's last one are full, so those of equal place hold the same chapters.
    both = k.join(e, ["abbrev", "at"], "full")
    df = books.join(both, "abbrev", "left").withColumns({"__k": F.coalesce("__k", none), "__e": F.coalesce("__e", none)})
    verses = F.array().cast("array<string>")
    side = lambda s, i: F.coalesce(F.get(F.col(s), i), verses)
    n = F.greatest(F.size("__k"), F.size("__e"))
    c = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(side("__k", i), side("__e", i)))).otherwise(F.array().cast("array<array<array<string>>>"))
    return df.select("ord", F.col("abbrev").alias("a"), "en", "ko", c.alias("c"), F.coalesce("at", F.lit(1)).alias("at")).orderBy("ord", "at")


def from_records(records: DataFrame) -> DataFrame:
    """abbrev, ch, v, ko, en of corpus records (a, c, at or not)."""
    each = records.select(F.col("a").alias("abbrev"), _from(records).alias("at"), F.posexplode("c").alias("p", "sides"))
    zipped = F.arrays_zip(F.get("sides", F.lit(0)).alias("ko"), F.get("sides", F.lit(1)).alias("en"))
    each = each.select("abbrev", (F.col("p") + F.col("at")).alias("ch"), F.posexplode(zipped).alias("i", "verse"))
    return each.select("abbrev", "ch", (F.col("i") + 1).alias("v"), F.coalesce("verse.ko", F.lit("")).alias("ko"), F.coalesce("verse.en", F.lit("")).alias("en"))


def to_chapters(verses: DataFrame, text: str = "text") -> DataFrame:
    """(abbrev, chapters, at) of long-form verses; chapters that are missing before the last one are empty arrays.

    Verses are gathered by chapter, then chapters by parts of a book: no row grows beyond a chapter's verses or PART chapters.
    """
    lists = verses.groupBy("abbrev", "ch").agg(F.array_sort(F.collect_list(F.struct("v", F.col(text).alias("t")))).alias("l"))
    lists = padded(lists.select("abbrev", "ch", F.col("l.t").alias("verses")))
    first = (F.floor((F.col("ch") - 1) / PART) * PART + 1).cast("int").alias("at")
    books = lists.groupBy("abbrev", first).agg(F.array_sort(F.collect_list(F.struct("ch", "verses"))).alias("l"))
    return books.select("abbrev", F.col("l.verses").alias("chapters"), "at")


def padded(chapters: DataFrame) -> DataFrame:
    """(abbrev, ch, verses) with an empty row for every gap below a book's last chapter."""
    last = chapters.groupBy("abbrev").agg(F.max("ch").cast("int").alias("last"))
    some = last.select("abbrev", "last", F.explode(F.sequence(F.lit(1), "last", F.lit(PART))).alias("__at"))
    every = some.select("abbrev", F.explode(F.sequence("__at", F.least(F.col("__at") + PART - 1, "last"))).alias("ch"))
    return every.join(chapters, ["abbrev", "ch"], "left").select("abbrev", "ch", F.coalesce("verses", F.array().cast("array<string>")).alias("verses"))


def counts(verses: DataFrame) -> DataFrame:
    """One row: books, chapters, verses."""
    per = verses.groupBy("abbrev", "ch").agg(F.count("*").alias("n"))
    return per.agg(F.countDistinct("abbrev").alias("books"), F.count("*").alias("chapters"), F.coalesce(F.sum("n"), F.lit(0)).alias("verses"))


def rendered(verses: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """What is displayed of aligned verses: escaped texts with a dash for empty ones, and flags; only the sides in langs."""
    sides = [s for s in ("ko", "en") if langs is None or s in langs]
    empty = lambda s: (F.coalesce(F.col(s), F.lit("")) == "").alias(f"{s}_empty")
    return verses.select("abbrev", "ch", "v", *[shown(F.col(s)).alias(f"{s}_html") for s in sides], *[empty(s) for s in sides])


def column_labels(names: Column) -> list[Column]:
    """Headers of the two columns from a map of names, '' for a missing one."""
    return [F.coalesce(F.try_element_at(names, F.lit(s)), F.lit("")).alias(f"{s}_label") for s in ("ko", "en")]


def view(meta: DataFrame) -> DataFrame:
    """One row of what a corpus' meta (title, langs, names, demo) says of its display: title, demo badge, whether Korean, English or both are shown, labels."""
    has = lambda lang: F.array_contains("langs", lang)
    layout = F.when(has("ko") & has("en"), "ko+en").when(has("ko"), "ko").otherwise("en")
    return meta.select("title", F.coalesce("demo", F.lit(False)).alias("demo_badge"), layout.alias("layout"), *column_labels(F.col("names")))


def neighbours(verses: DataFrame) -> DataFrame:
    """abbrev, ch, v with the next verse (over the end of a chapter to the next one's first), the previous one in the chapter, and the
    chapter's last: next_ch, next_v, previous_v, last_v. Verses are compared within chapters, and chapters, a row each, within books."""
    at = verses.select("abbrev", "ch", "v").distinct()
    ends = at.groupBy("abbrev", "ch").agg(F.min("v").alias("__first"), F.max("v").alias("last_v"))
    following = F.lead(F.struct("ch", F.col("__first").alias("v"))).over(Window.partitionBy("abbrev").orderBy("ch"))
    ends = ends.select("abbrev", "ch", "last_v", following.alias("__then"))
    chapter = Window.partitionBy("abbrev", "ch").orderBy("v")
    rows = at.withColumns({"__next": F.lead("v").over(chapter), "previous_v": F.lag("v").over(chapter)}).join(ends, ["abbrev", "ch"])
    return rows.select(
        "abbrev", "ch", "v",
        F.when(F.col("__next").isNotNull(), F.col("ch")).otherwise(F.col("__then.ch")).alias("next_ch"), F.coalesce("__next", "__then.v").alias("next_v"), "previous_v", "last_v",
    )


def placed(verses: DataFrame) -> DataFrame:
    """abbrev, ch, v, place, last of verses (abbrev, ch, v): the place of each in its book, from 1, and the book's last place.

    Verses are numbered within their chapters; what comes before a chapter follows from the chapters' counts, so no book is one task.
    """
    each = verses.select("abbrev", "ch", "v").distinct()
    sizes = each.groupBy("abbrev", "ch").agg(F.count("*").alias("__n"))
    book = Window.partitionBy("abbrev")
    before = F.sum("__n").over(book.orderBy("ch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    sizes = sizes.select("abbrev", "ch", before.alias("__before"), F.sum("__n").over(book).alias("last"))
    number = F.row_number().over(Window.partitionBy("abbrev", "ch").orderBy("v"))
    return each.withColumn("__at", number).join(sizes, ["abbrev", "ch"]).select("abbrev", "ch", "v", (F.col("__before") + F.col("__at")).alias("place"), "last")
