"""Column functions of the reference grammar: normalisation, tokens, chapter and verse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense that typed input needs; also outside ASCII.
SPACE = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters one by one.
SPACES = "\t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
HANGUL = "[가-힣]"
#: The most tokens of a book's name.
PREFIXES = 4
_LARGEST = "9" * 38


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it: the optimiser copies what is named twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain(raw: Column) -> Column:
    """raw with a space for each character of white space, so that later patterns need no wide class."""
    return F.translate(raw, SPACES, " " * len(SPACES))


def trimmed(raw: Column) -> Column:
    return F.trim(plain(raw))


def unified(raw: Column) -> Column:
    """Trimmed, with one colon and one hyphen for their wide and spaced forms; a plain hyphen keeps its spaces."""
    return F.regexp_replace(F.regexp_replace(trimmed(raw), " *[：:] *", ":"), " *[–—~～] *", "-")


def tokens(raw: Column) -> Column:
    return F.split(unified(raw), " +")


def book_key(name: Column) -> Column:
    """What a book's name is looked up by: Hangul as it is, anything else in lower case without spaces, dots and hyphens."""
    return F.when(name.rlike(HANGUL), name).otherwise(F.regexp_replace(F.lower(name), rf"{SPACE}|[.\-]", ""))


def number(digits: Column) -> Column:
    """A run of digits as a whole number, null if empty; longer than 38 digits it is the largest there is."""
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(digits != "", once(short, lambda x: F.when(F.length(x) > 38, F.lit(_LARGEST)).otherwise(x).cast("decimal(38,0)")))


# Fixed value: what may follow a book's name: "3:16-18", "3 16 18", "3 16-18" or "3".
TAIL = r"^(\d+)(?::(\d+)(?:-(\d+))?|\s+(\d+)(?:\s*-\s*(\d+)|\s+(\d+))?)?\z"


def chapter_verse(text: Column) -> Column:
    """struct(ch, v1, v2) of "3:16-18", "3 16 18", "3 16-18" or "3"; null for any other text."""
    part = lambda p, i: number(F.get(p, F.lit(i)))
    of = lambda p: F.struct(part(p, 0).alias("ch"), part(p, 1).alias("v1"), part(p, 2).alias("v2"))
    return once(text, lambda t: F.when(t.rlike(TAIL), once(F.split(F.regexp_replace(t, TAIL, "$1,$2$4,$3$5$6"), ","), of)))


def prefixes(words: Column) -> Column:
    """array of struct(key, ref), longest first: for each start of words that leaves a chapter and verse, what it is looked up by, and these."""
    name = lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
    rest = lambda n: F.array_join(F.slice(words, n + 1, F.size(words)), " ")
    each = lambda n: F.struct(once(name(n), book_key).alias("key"), chapter_verse(rest(n)).alias("ref"))
    found = F.transform(F.sequence(F.least(F.lit(PREFIXES), F.size(words) - 1), F.lit(1)), each)
    return F.when(F.size(words) > 1, F.filter(found, lambda x: x["ref"].isNotNull()))


def label(name: Column, ch: Column, v1: Column, v2: Column, end: bool = True) -> Column:
    """"name ch[:v1[–v2]]"; a verse 0 or null isn't shown."""
    there = lambda v: F.coalesce(v != 0, F.lit(False))
    tail = F.when(there(v2), F.concat(F.lit("–"), v2.cast("string"))).otherwise("") if end else F.lit("")
    verse = F.when(there(v1), F.concat(F.lit(":"), v1.cast("string"), tail)).otherwise("")
    return F.concat(name, F.lit(" "), ch.cast("string"), verse)
