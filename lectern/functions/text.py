"""Column functions on text: cleaning, escaping, line parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.references import SPACE

# Fixed value: a line of a line-oriented source: code, chapter, verse, text.
LINE = r"^(\w{3}) (\d+):(\d+) (.*)\z"


def cleaned(text: Column) -> Column:
    """Without brackets and paragraph marks, white space as single spaces, trimmed."""
    one = F.regexp_replace(F.translate(text, "[]¶", ""), rf"(?:{SPACE}|\x{{0085}}|[\x{{001C}}-\x{{001F}}])+", " ")
    return F.trim(one)


def escaped(text: Column) -> Column:
    """Ampersand, less-than and greater-than as entities."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def shown(text: Column) -> Column:
    """What is displayed for a verse: escaped, a dash for an empty one."""
    return escaped(F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(text))


def without_mark(text: Column) -> Column:
    """Without a byte-order mark at the start."""
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def decoded(base64: Column) -> Column:
    return F.unbase64(base64).cast("string")
