"""Relative references in speech: recognising them, and resolving them against what was displayed last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.detect import FORMS, confidence
from lectern.operators.sessions import looked_up

#: The kinds of relative reference, in the order of the patterns' groups; the last group marks what is none.
KINDS = ("next_chapter", "chapter", "same_chapter", "return", "next", "previous", "verse")
#: For Java and RE2, on normalised text.
KOREAN = r"(다음\s?장)|(\d+)장으로|같은\s?장(?:\s[가-힣]+)?\s(\d+)절|다시\s(\d+)절로|((?:그\s)?다음\s?절|이어서)|(앞\s?절|이전\s?절)|(\d+)절(기?)"
ENGLISH = r"(?i)\b(?:(next\schapter)|(?:go|turn|over)\sto\schapter\s(\d+)|same\schapter,?\sverse\s(\d+)|back\sto\sverse\s(\d+)|((?:next|following)\sverse)|(previous\sverse)|verse\s(\d+))\b()"


def mentioned(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, lang, nth, kind, n, matched of every relative reference in a normalised text.

    What belongs to a reference with a book is no relative one: such matches are taken out first. kind is one of KINDS; n is the verse or
    chapter said, or null. A number of something else, as in 2절기, is none.
    """
    rest = F.col(text)
    for pattern, _ in FORMS:
        rest = F.regexp_replace(rest, pattern, " ")
    rows, every = texts.select(key, rest.alias("__rest")), None
    for lang, pattern in (("ko", KOREAN), ("en", ENGLISH)):
        hits = rows.select(key, F.posexplode(F.regexp_extract_all("__rest", F.lit(pattern), F.lit(0))).alias("nth", "matched"))
        groups = F.split(F.regexp_replace("matched", pattern, "$1\t$2\t$3\t$4\t$5\t$6\t$7\t$8"), "\t")
        hits = hits.withColumn("__g", groups)
        kind = F.coalesce(*[F.when(F.get("__g", F.lit(i)) != "", F.struct(F.lit(k).alias("kind"), F.get("__g", F.lit(i)).alias("said"))) for i, k in enumerate(KINDS)])
        hits = hits.where(F.get("__g", F.lit(len(KINDS))) == "").select(key, F.lit(lang).alias("lang"), "nth", kind.alias("__k"), "matched")
        hits = hits.select(key, "lang", "nth", "__k.kind", F.nullif(F.regexp_extract("__k.said", r"^(\d+)\z", 1), F.lit("")).try_cast("int").alias("n"), "matched")
        every = hits if every is None else every.unionByName(hits)
    return every


def resolved(texts: DataFrame, key: str, context: DataFrame, catalog: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(candidates, misses) of the relative references in normalised texts.

    context: key, abbrev, ch, v of what was displayed last. Candidates: key, lang, nth, kind, abbrev, to_ch, to_v, rolled_over, matched, confidence (less
    over the end of a chapter). Misses: key, lang, nth, kind, n, matched, reason: no_context, or not_there for a verse or chapter that the catalog hasn't.
    """
    said = mentioned(texts, key, text).join(context.select(key, "abbrev", "ch", "v"), key, "left")
    found = looked_up(said.join(texts.select(key, F.col(text).alias("__text")), key), catalog)
    score = confidence(F.col("__text"), F.lit(""), F.col("to_v"), F.col("rolled_over"))
    hits = found.where("found").select(key, "lang", "nth", "kind", "abbrev", "to_ch", "to_v", "rolled_over", "matched", score.alias("confidence"))
    reason = F.when(F.col("abbrev").isNull(), "no_context").otherwise("not_there")
    return hits, found.where("not found").select(key, "lang", "nth", "kind", "n", "matched", reason.alias("reason"))
