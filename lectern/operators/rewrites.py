"""Rewriting texts with a map of positions, so that what is found in the rewritten text can be shown in the original.

A rewriting is a value of two fields: text, and maps, one for each step. A step's map lists what it changed: at and length in the text
after it, start and end in the text before it, in characters from 1. Between changes characters correspond one to one, so
a map is as long as there are changes. Steps compose by going through the maps backwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.references import once

#: Characters that texts don't have after begun(): around a match, and between its groups.
MARK, FIELD = "\x01", "\x02"
CHANGE = "array<struct<at: int, length: int, start: int, end: int>>"


def begun(text: Column) -> Column:
    """The rewriting of a text by no step; the two control characters that marking needs become spaces. Null stays null."""
    plain = F.translate(text, MARK + FIELD, "  ")
    return F.when(text.isNotNull(), F.struct(plain.alias("text"), F.array().cast(f"array<{CHANGE}>").alias("maps")))


def marked(text: Column, pattern: str, groups: str = "$0") -> Column:
    """The text cut at the pattern's matches: what lies between them and, at odd places, the groups of each; one pass of the pattern."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK + groups + MARK)), MARK)


def step(state: Column, pattern: str, new: Callable[[Column], Column], cheap: str | None = None) -> Column:
    """The rewriting state with every match of the pattern replaced by new(match), and its map. A null replacement leaves a match as it is.

    cheap: a pattern that every text with a match has, which spares others the search for it.
    """

    def rewritten(s: Column, cut: Column) -> Column:
        parts = F.transform(cut, lambda x, i: F.struct(x.alias("old"), F.when(i % 2 == 1, F.coalesce(new(x), x)).otherwise(x).alias("new")))
        return once(parts, lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["new"]), "").alias("text"), F.array_append(s["maps"], _changes(p)).alias("maps")))

    searched = lambda s: once(marked(s["text"], pattern), lambda cut: F.when(F.size(cut) > 1, rewritten(s, cut)).otherwise(s))
    return once(state, lambda s: F.when(s["text"].rlike(cheap), searched(s)).otherwise(s) if cheap else searched(s))


def _changes(parts: Column) -> Column:
    none = F.struct(F.lit(1).alias("at"), F.lit(1).alias("start"), F.array().cast(CHANGE).alias("out"))

    def add(s: Column, x: Column) -> Column:
        at, start = s["at"] + F.length(x["new"]), s["start"] + F.length(x["old"])
        change = F.struct(s["at"].alias("at"), F.length(x["new"]).alias("length"), s["start"].alias("start"), (start - 1).alias("end"))
        out = F.when(x["new"] == x["old"], s["out"]).otherwise(F.array_append(s["out"], change))
        return F.struct(at.alias("at"), start.alias("start"), out.alias("out"))

    return F.aggregate(parts, none, add, lambda s: s["out"])


def original(maps: Column, place: Column, last: bool = False) -> Column:
    """Where a character of the rewritten text is in the original; within a change that is the change's first character, or its last one."""

    def before(p: Column, changes: Column) -> Column:
        past = lambda c: p + c["end"] + 1 - c["at"] - c["length"]
        return F.aggregate(changes, p, lambda q, c: F.when(p >= c["at"] + c["length"], past(c)).when(p >= c["at"], c["end"] if last else c["start"]).otherwise(q))

    return F.aggregate(F.reverse(maps), place.cast("int"), before)


def found(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """array of struct(start, parts) of the pattern's matches in a text: where each begins, the match and then the groups named; '' for one that took no part."""
    fields = FIELD.join(["$0", *(f"${g}" if g else "" for g in groups)])
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start: int, parts: array<string>>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        hit = lambda f: F.struct((s["at"] + F.length(f[0])).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("start"), f.alias("parts"))).alias("out"))
        return F.when(F.contains(x, F.lit(FIELD)), once(F.split(x, FIELD), hit)).otherwise(F.struct((s["at"] + F.length(x)).alias("at"), s["out"].alias("out")))

    return F.aggregate(marked(text, pattern, fields), none, add, lambda s: s["out"])
