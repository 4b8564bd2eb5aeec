"""Finding references inside longer spoken or written text, with their places in the original."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import canon
from lectern.functions import references as R
from lectern.functions.numerals import EN_ORDINALS, EN_TENS, EN_UNITS, KO_DIGITS, english_value, korean_value
from lectern.operators import rewrites

#: Words near a reference that make it likelier, and book names that are also people's. Fixed values.
TRIGGERS = "말씀|읽겠습니다|보시면|let's read|turn to|turn with me|it says in"
PEOPLE = ("요한", "마가", "누가", "john", "mark", "luke")
#: Names of people that are books in speech if a chapter follows.
SPOKEN_NAMES = {"요한": "jo", "마가": "mk", "누가": "lk"}


def _alternatives(hangul: bool) -> str:
    """Names for speech, under their first characters and longest first; numbered and two-part names may be said with a space."""
    names = [a for a, _ in canon.ALIASES] + list(SPOKEN_NAMES)
    whole = {name.lower() for _, _, name, _, _ in canon.BOOKS}  # short ones too, such as Job
    found = [a for a in names if bool(re.match("[가-힣]", a)) == hangul and (len(a) > 1 if hangul else len(a) > 3 or a[0] in "123" or a in whole)]
    under: dict[str, list[str]] = {}
    for name in sorted(found, key=lambda a: (-len(a), a)):
        if m := re.fullmatch(r"(.{2,})([일이삼])서", name):
            said = rf"{m[1]}\s?[{m[2]}{'일이삼'.index(m[2]) + 1}]\s?서"
        elif m := re.fullmatch(r"(.{2,})(전서|후서|상|하|복음|계시록)", name):
            said = rf"{m[1]}\s?{m[2]}" if hangul else name
        elif m := re.fullmatch(r"([123])(.+)", name):
            said = rf"{m[1]}(?:st|nd|rd)?\s?{m[2]}"
        else:
            said = name.replace("songof", r"song\s?of\s?")
        under.setdefault(said[0], []).append(said[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in under.items())


NAMES_KO, NAMES_EN = _alternatives(True), _alternatives(False)
#: What follows the 1, 2 or 3 of a numbered book.
_NUMBERED = "|".join(sorted({a[1:] for a, _ in canon.ALIASES if a[0] in "123" and len(a) > 3}, key=lambda a: (-len(a), a)))
#: A number that is a verse: no chapter, no book's number.
_VERSE_KO = r"(?<!\d)\d+(?!\d|\s?[장편:]|\s?절기)"
_VERSE_EN = rf"(?<!\d)(?:\d+:)?\d+(?!\d|\s?:|(?:st|nd|rd|th)?\s?(?:{_NUMBERED})\b)"
#: Groups: name, chapter, verse, chapter and verse of a range's end, further verses of a list.
KOREAN = (
    rf"({NAMES_KO})(?:을|를|에서|에|은|는)?\s?(\d+)\s?(?:장(?!짜리)|편|:)(?:에서|에|을|의)?"
    rf"(?:[\s,]{{0,2}}({_VERSE_KO})(?:\s?절)?(?:\s?(?:부터|에서|내지|-)\s?(?:(\d+)\s?(?:장|편|:)\s?)?({_VERSE_KO})(?:\s?절)?(?:까지)?)?"
    rf"((?:\s?(?:과|와|하고|,)\s?{_VERSE_KO}(?:\s?절)?|\s{_VERSE_KO}\s?절)*))?"
)
_TO = rf"(?:\s?(?:-|–|~|to|through)\s?(?:(?:chapter\s)?(\d+)(?:\s?:\s?|,?\sverse\s))?({_VERSE_EN}))?"
_LIST = rf"((?:,\s?{_VERSE_EN})+(?:,?\sand\s(?:verses?\s)?{_VERSE_EN})?|(?:(?:,?\sand\sverses?\s|(?<=\bverses\s\d{{1,3}})\sand\s){_VERSE_EN})*)"
ENGLISH = rf"(?i)\b({NAMES_EN})\.?,?\s(?:chapter\s)?(\d+)(?:(?:\s?:\s?|,?\s(?:verses?\s)?)({_VERSE_EN}){_TO}{_LIST})?"
#: The chapter first; nothing follows the range. A psalm is its own name.
ENGLISH_OF = rf"(?i)\b(?:the\s)?(\d+)(?:st|nd|rd|th)?\s(?:chapter\sof\s(?:the\sbook\sof\s)?({NAMES_EN})|(psalm))\b(?:,?\sverses?\s(\d+){_TO})?"
#: Each pattern with the groups that are name, chapter, verse, chapter and verse of the end, and list; further ones add to the name.
FORMS = ((KOREAN, (1, 2, 3, 4, 5, 6, 0)), (ENGLISH, (1, 2, 3, 4, 5, 6, 0)), (ENGLISH_OF, (2, 1, 4, 5, 6, 0, 3)))

_TENS = "|".join(EN_TENS) + "|" + "|".join(w[:-1] + "ieth" for w in EN_TENS)
_UNITS = "|".join(sorted([*EN_UNITS, *EN_ORDINALS], key=lambda w: -len(w)))
_BELOW = rf"(?:(?:{_TENS})(?:[\s-](?:{'|'.join([*EN_UNITS[:9], *EN_ORDINALS[:9]])})\b)?|{_UNITS})"
#: An English number: hundreds, tens and units, the last of which may be ordinal.
ENGLISH_NUMBER = rf"(?i)\b(?:(?:{'|'.join(EN_UNITS[:9])})\shundred(?:\s(?:and\s)?{_BELOW})?|{_BELOW})\b"
#: A Sino-Korean number before the word for chapter, psalm or verse, at the beginning of a word.
KOREAN_NUMBER = rf"(?<![가-힣&&[^장편절]])(?=[{KO_DIGITS}십백])(?:[{KO_DIGITS}]?백)?(?:[{KO_DIGITS}]?십)?[{KO_DIGITS}]?\s*(?=[장편절])"
_RANGE = r"(\d절?)\s?부터\s?((?:\d+[장편]\s?)?\d+절?)\s?까지"
#: Spoken forms as digits and marks, one after the other: numbers before 장, 편 and 절, one colon, one range mark, no space inside 3장.
STEPS = (
    (r"\s*[：:]\s*|\s+colon\s+", lambda x: F.lit(":"), "[：:]|colon"),
    (r"\s*[~～–—]\s*", lambda x: F.lit("-"), "[~～–—]"),
    (r"(?<=\d|\d절)\s?(?:내지|through|to)\s?(?=\d)", lambda x: F.lit("-"), r"(?:내지|through|to)\s?\d"),
    (KOREAN_NUMBER, lambda x: korean_value(F.rtrim(x)).cast("string"), rf"[{KO_DIGITS}십백]\s*[장편절]"),
    (r"(?<=\d)\s+(?=[장편절])", lambda x: F.lit(""), r"\s[장편절]"),
    (_RANGE, lambda x: F.regexp_replace(x, _RANGE, "$1-$2"), "부터"),
)
NUMBERS = ((ENGLISH_NUMBER, lambda x: english_value(F.regexp_replace(x, r"(?i)\sand\s", " ")).cast("string"), r"(?i)\b(?:on|tw|th|fo|fi|si|se|ei|ni|te|el)"),)


def _rewritten(text: Column, steps: tuple) -> Column:
    out = rewrites.begun(text)
    for pattern, new, cheap in steps:
        out = rewrites.step(out, pattern, new, cheap)
    return out


def normalised(text: Column) -> Column:
    """A text with Korean numbers, colons and ranges in one form."""
    return _rewritten(text, STEPS)["text"]


def english_numbers(text: Column) -> Column:
    """A text with English number words as digits: "one hundred nineteen" is 119, "three sixteen" 3 16."""
    return _rewritten(text, NUMBERS)["text"]


def heard(text: Column) -> Column:
    """The rewriting (text, maps) of a transcript into the form that detection reads: number words of both languages as digits, one colon, one range mark."""
    return _rewritten(text, NUMBERS + STEPS)


def name_key(name: Column) -> Column:
    """What a spoken name is looked up by: lower case, without spaces; numbers in the form that the aliases have."""
    out = F.regexp_replace(F.lower(name), r"\s", "")
    for i in range(3):
        out = F.regexp_replace(F.regexp_replace(out, f"^{i + 1}(?:st|nd|rd)", str(i + 1)), f"{i + 1}서\\z", "일이삼"[i] + "서")
    return out


def _known(df: DataFrame) -> DataFrame:
    """Names in speech; of fixed number."""
    spoken = df.sparkSession.createDataFrame(list(SPOKEN_NAMES.items()), "alias string, abbrev string")
    return F.broadcast(canon.aliases(df.sparkSession, speech=True).select("alias", "abbrev").unionByName(spoken).withColumnRenamed("alias", "__name"))


def detected(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, item, abbrev, ch, v1, ch2, v2, matched, start, end, confidence for every reference inside a transcript.

    Number words and marks are brought to one form first. matched, start and end are of the original text, in characters from 1, so a console can show
    them. A list of verses gives a row for each (item counts them), all with one match; ch2 is the chapter of a range's end where it
    isn't ch. Single-syllable abbreviations aren't names here, a book without a chapter is no reference, and a person's name is a book only
    before a chapter. Null texts have none.
    """
    own = lambda h, form, cheap: F.when(h["text"].rlike(cheap), rewrites.found(h["text"], *form))
    none = F.array().cast("array<struct<start: int, parts: array<string>>>")
    # Neither language's names are looked for in texts that have none of its letters.
    hits = lambda h: F.concat(F.coalesce(own(h, FORMS[0], "[가-힣]"), none), *[F.coalesce(own(h, f, "[A-Za-z]{3}"), none) for f in FORMS[1:]])
    last = lambda x: x["start"] + F.length(x["parts"][0]) - 1
    places = lambda h: F.transform(hits(h), lambda x: F.struct(x["parts"].alias("parts"), rewrites.original(h["maps"], x["start"]).alias("start"), rewrites.original(h["maps"], last(x), last=True).alias("end")))
    found = R.once(heard(F.col(text)), lambda h: F.when(h["text"].rlike("[0-9]"), places(h)))
    rows = texts.select(key, text, F.explode(found).alias("__hit")).select(key, text, "__hit.*")
    part = lambda i: F.get("parts", F.lit(i))
    number = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    rows = rows.select(key, text, name_key(F.concat(part(1), part(7))).alias("__name"), number(part(2)).alias("ch"), number(part(3)).alias("v1"), number(part(4)).alias("ch2"), number(part(5)).alias("v2"), part(6).alias("__more"), "start", "end")
    rows = rows.join(_known(texts), "__name")
    # A further verse may name its chapter; one that doesn't is of the reference's own.
    nothing = F.lit(None).cast("int")
    more = F.transform(F.regexp_extract_all("__more", F.lit(r"(?:\d+:)?\d+"), F.lit(0)), lambda x: F.struct(F.coalesce(number(F.regexp_extract(x, r"^(\d+):", 1)), F.col("ch")).alias("ch"), number(F.regexp_extract(x, r"(\d+)\z", 1)).alias("v1"), nothing.alias("ch2"), nothing.alias("v2")))
    items = F.concat(F.array(F.struct("ch", "v1", "ch2", "v2")), more)
    rows = rows.select(key, text, "__name", "abbrev", "start", "end", F.posexplode(items).alias("item", "__v"))
    matched = F.substring(F.col(text), F.col("start"), F.col("end") - F.col("start") + 1)
    score = confidence(F.col(text), F.col("__name"), F.col("__v.v1"))
    return rows.select(key, "item", "abbrev", "__v.*", matched.alias("matched"), "start", "end", score.alias("confidence"))


def confidence(text: Column, name: Column, v1: Column, rolled_over: Column | None = None) -> Column:
    """0.6, more beside a trigger, less without a verse, for a name that is also a person's, and over the end of a chapter."""
    score = F.lit(60) + F.when(text.rlike(f"(?i)(?:{TRIGGERS})"), 20).otherwise(0) - F.when(v1.isNull(), 20).otherwise(0) - F.when(name.isin(*PEOPLE), 20).otherwise(0)
    if rolled_over is not None:
        score -= F.when(rolled_over, 20).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)) / F.lit(100.0)


#: After a chapter: a verse and those after it, the first verse, or the last one.
SPECIAL = rf"({NAMES_KO})\s?(\d+)(?:장|편)에?\s(?:(\d+)절\s?이하|(첫째?\s?절)|(마지막\s?절))"


def special(texts: DataFrame, key: str, last_verses: DataFrame, text: str = "text") -> DataFrame:
    """key, abbrev, ch, v1, open_range for a detected chapter followed by "n절 이하", "첫 절" or "마지막 절"; the last one from the corpus."""
    part = lambda i: F.regexp_extract(text, SPECIAL, i)
    rows = texts.where(F.col(text).rlike(SPECIAL)).select(key, name_key(part(1)).alias("__name"), part(2).cast("int").alias("ch"), part(3).alias("n"), part(4).alias("first"), part(5).alias("last"))
    rows = rows.join(_known(texts), "__name").join(last_verses.select("abbrev", "ch", F.col("last_v").alias("__last")), ["abbrev", "ch"], "left")
    v1 = F.when(F.col("n") != "", F.col("n").cast("int")).when(F.col("first") != "", 1).otherwise(F.col("__last"))
    return rows.select(key, "abbrev", "ch", v1.alias("v1"), (F.col("n") != "").alias("open_range"))
