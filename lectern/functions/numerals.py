"""Number words of both languages up to 999, as phrases and as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
KO_DIGITS = "일이삼사오육칠팔구"
EN_UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()


def korean(n: int) -> str:
    """Sino-Korean words of 1 to 999; a unit of one isn't said before hundred and ten."""
    out = ""
    for value, unit in ((n // 100, "백"), (n // 10 % 10, "십")):
        out += ("" if value == 1 else KO_DIGITS[value - 1]) + unit if value else ""
    return out + (KO_DIGITS[n % 10 - 1] if n % 10 else "")


def english(n: int) -> str:
    """English words of 1 to 999."""
    hundreds = [EN_UNITS[n // 100 - 1], "hundred"] if n >= 100 else []
    rest = n % 100
    if rest >= 20:
        return " ".join([*hundreds, EN_TENS[rest // 10 - 2], *([EN_UNITS[rest % 10 - 1]] if rest % 10 else [])])
    return " ".join([*hundreds, *([EN_UNITS[rest - 1]] if rest else [])])


def korean_value(word: Column) -> Column:
    """The number that a Sino-Korean word says; null for any other text."""
    shape = rf"^(?:([{KO_DIGITS}])?(백))?(?:([{KO_DIGITS}])?(십))?([{KO_DIGITS}])?\z"
    digit = lambda i: F.instr(F.lit(KO_DIGITS), F.regexp_extract(word, shape, i))
    times = lambda i, unit: F.when(F.regexp_extract(word, shape, i + 1) == "", 0).when(F.regexp_extract(word, shape, i) == "", unit).otherwise(digit(i) * unit)
    last = F.when(F.regexp_extract(word, shape, 5) == "", 0).otherwise(digit(5))
    return F.when((word != "") & word.rlike(shape), times(1, 100) + times(3, 10) + last)


def english_value(phrase: Column) -> Column:
    """The number that an English phrase says, cardinal or ordinal; null for any other text."""
    said = F.split(F.lower(F.trim(phrase)), r"[\s-]+")
    value = {w: i + 1 for words in (EN_UNITS, EN_ORDINALS) for i, w in enumerate(words)} | {w: 10 * i + 20 for i, w in enumerate(EN_TENS)}
    value |= {w[:-1] + "ieth": value[w] for w in EN_TENS}
    known = F.create_map(*[F.lit(x) for pair in value.items() for x in pair])
    step = lambda s, w: F.when((w == "hundred") & (s > 0), s * 100).otherwise(s + F.try_element_at(known, w))
    return F.nullif(F.aggregate(said, F.lit(0), step), F.lit(0))
