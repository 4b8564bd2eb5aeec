"""Sentences for the detection queries, with what is in them written beside.

A sentence is a list of pieces; a Ref is a piece that is a reference, with its verses. Texts are made from the pieces in Spark and in SQL, and what
must be found follows in SQL from the pieces alone: no pattern of the library is used for it.
Numbers: c, v, w and m; in words kc, kv, km and ec, ev, em.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import numerals
from lectern.plans import stand_ins as S


@dataclass
class Ref:
    text: str
    #: chapter, verse, chapter of the end, verse of the end: columns, or None.
    items: list[tuple] = None
    abbrev: str = "abbrev"

    def __post_init__(self) -> None:
        self.items = [(*i, None, None, None)[:4] for i in self.items or [("c", "v")]]


#: Sentences whose numbers are digits.
DIGITS = [
    ["오늘 ", Ref("{ko} {c} 장 {v} 절"), " 말씀입니다"],
    [Ref("{ko} {c}장 {v}절부터 {w}절까지", [("c", "v", None, "w")]), " 읽겠습니다"],
    [Ref("{ko}{c}:{v}"), " 보시면"],
    ["그리고 ", Ref("{ko} {c}장에", [("c",)]), " 있습니다"],
    ["let's read ", Ref("{en} {c}:{v}")],
    ["see ", Ref("{en} chapter {c} verse {v}"), " today"],
    ["in ", Ref("{en} {c} verses {v} to {w}", [("c", "v", None, "w")])],
    ["we say nothing of it, {c}장짜리 편지 말씀"],
    [Ref("{ko} {c}장 {v}절과 {w}절", [("c", "v"), ("c", "w")]), ", 그리고 ", Ref("{ko} {c}장 {v}절 {w}절", [("c", "v"), ("c", "w")]), " 보시면"],
    [Ref("the {c}th chapter of the book of {en} verse {v}"), "; ", Ref("{en} {c}:{v}, {w} and {m}", [("c", "v"), ("c", "w"), ("c", "m")])],
    [Ref("{variant} {c}장 {v}절")],
    [Ref("{ordinal} {c} {v}"), " and ", Ref("the {m}th Psalm", [("m",)], "'ps'")],
    ["오늘은 ", Ref("{person} {c}장 {v}절", None, "who")],
    ["{person}이 말했다, {c}절기 그리고 {ko}"],
    [Ref("{ko} {c}장 {v}절에서 {m}장 {w}절까지", [("c", "v", "m", "w")]), "입니다"],
    ["then ", Ref("{en} {c}:{v}-{m}:{w}", [("c", "v", "m", "w")]), "."],
    [Ref("{en}, chapter {c}, verse {v}"), " and ", Ref("{en} {c}:{v}, {m}:{w}", [("c", "v"), ("m", "w")])],
    ["turn to the book, {en} said"],
    [Ref("{ko} {c}장 {v}절"), ", {m}장 {w}절; ", Ref("{en} {c} verses {v} and {w}", [("c", "v"), ("c", "w")])],
]
#: Sentences in which words, marks and spaces are rewritten before detection.
WORDS = [
    ["오늘은  ", Ref("{ko} {kc} 장 {kv} 절"), " 말씀"],
    ["{km} 장 뒤에 ", Ref("{ko} {km}장 {kv}절", [("m", "v")])],
    ["자 ： ", Ref("{ko} {c} ： {v}"), " 을"],
    ["~ ", Ref("{ko} {c}장 {v} 절 부터 {w} 절 까지", [("c", "v", None, "w")]), " 함께"],
    ["he said that ", Ref("{en} {ev} {em}", [("v", "m")]), " was read"],
    ["the {em} of them read ", Ref("{en} chapter {em} verse {ev}", [("m", "v")]), " – slowly"],
    ["{ec}, then ", Ref("{en}, chapter {ec}, verse {ev} through {w}", [("c", "v", None, "w")]), "."],
    ["turn to ", Ref("{en} {c} colon {v}"), " or ", Ref("{ko} {c}편 {kv} 절", [("c", "v")])],
]
TRIGGERED = ("말씀", "읽겠습니다", "보시면", "let's read", "turn to")
PEOPLE = [("요한", "jo"), ("마가", "mk"), ("누가", "lk")]


def _plain(piece) -> str:
    return piece.text if isinstance(piece, Ref) else piece


#: In a transcript by machine the chapters of these orders are misheard as the next one, and those sentences come twice.
MISHEARD, REPEATED = (9, 4), (9, 7)


def _words(rows: DataFrame, misheard: bool = False) -> DataFrame:
    """The orders with all that the sentences' pieces name."""
    if misheard:
        wrong = F.col("o_orderkey") % MISHEARD[0] == MISHEARD[1]
        rows = rows.withColumn("c", F.when(wrong, (F.col("c").cast("int") + 1).cast("string")).otherwise(F.col("c")))
    words = {p: F.array(*[F.lit(w(n)) for n in range(1, 200)]) for p, w in (("k", numerals.korean), ("e", numerals.english))}
    word = lambda p, n: F.element_at(words[p], F.col(n).cast("int"))
    person = F.element_at(F.array(*[F.lit(p) for p, _ in PEOPLE]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = rows.withColumns({f"{p}{n}": word(p, n) for p in "ke" for n in "cvm"} | {"person": person, "m": F.col("m").cast("string")})
    return rows.withColumn("variant", F.replace("ko", F.lit("일서"), F.lit(" 1서"))).withColumn("ordinal", F.replace("en", F.lit("1 "), F.lit("First ")))


def _text(which: list, misheard: bool = False) -> Column:
    text = S._form(len(which), *[S._text("".join(map(_plain, t))) for t in which])
    return F.when(F.col("o_orderkey") % REPEATED[0] == REPEATED[1], F.concat(text, F.lit(" … "), text)).otherwise(text) if misheard else text


def sentences(spark: SparkSession, sf_dir: str, which: list, misheard: bool = False) -> DataFrame:
    """o_orderkey, text: a sentence for each order. misheard: as a machine writes it down, some with another chapter and some twice."""
    return _words(S._orders(spark, sf_dir), misheard).select("o_orderkey", _text(which, misheard).alias("text"))


def transcripts(spark: SparkSession, sf_dir: str, which: list) -> DataFrame:
    """o_orderkey, text, modes: the sentences as they were said and as a machine writes them down, once with both modes where these are alike.

    The orders are dealt out first, as reading a sentence takes far longer than reading its order and a table of few splits would be few tasks.
    """
    rows = S._orders(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    rows = _words(rows).withColumn("said", _text(which))
    rows = _words(rows, misheard=True).select("o_orderkey", "said", _text(which, misheard=True).alias("machine"))
    one = lambda text, *modes: F.struct(F.col(text).alias("text"), F.array(*map(F.lit, modes)).alias("modes"))
    alike = F.col("said").eqNullSafe(F.col("machine"))
    return rows.select("o_orderkey", F.inline(F.when(alike, F.array(one("said", "said", "machine"))).otherwise(F.array(one("said", "said"), one("machine", "machine")))))


def labels(spark: SparkSession, sf_dir: str, which: list) -> DataFrame:
    """o_orderkey, nth, item, abbrev, ch, v1: the references that are in the sentences, as their pieces say."""
    who = F.element_at(F.array(*[F.lit(b) for _, b in PEOPLE]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    number = lambda c: F.lit(None).cast("int") if c is None else F.col(c).cast("int")
    book = lambda r: who if r.abbrev == "who" else F.lit("ps") if r.abbrev == "'ps'" else F.col("abbrev")
    said = [[(n, i, r, p) for n, r in enumerate(x for x in t if isinstance(x, Ref)) for i, p in enumerate(r.items)] for t in which]
    rows = F.array().cast("array<struct<nth: int, item: int, abbrev: string, ch: int, v1: int>>")
    for k, own in enumerate(said):
        found = [F.struct(F.lit(n).alias("nth"), F.lit(i).alias("item"), book(r).alias("abbrev"), number(p[0]).alias("ch"), number(p[1]).alias("v1")) for n, i, r, p in own]
        if found:
            rows = F.when(F.col("o_orderkey") % len(which) == k, F.array(*found)).otherwise(rows)
    return _words(S._orders(spark, sf_dir)).select("o_orderkey", F.inline(rows))


def _sql(template: str, words: dict[str, str]) -> str:
    """A template as SQL over the orders."""
    parts = [words.get(x[1:-1], x[1:-1]) if x[:1] == "{" else "'" + x.replace("'", "''") + "'" for x in re.split(r"(\{\w+\})", template) if x]
    return "(" + " || ".join(parts or ["''"]) + ")"


def as_sql(which: list, words: dict[str, str], orders: str = "o", found: str = "expected") -> str:
    """SQL of CTEs after one of the orders: spoken (o_orderkey, text) and expected (o_orderkey, text, item, abbrev, ch, v1, ch2, v2, matched, start, end, confidence)."""
    who = "['jo', 'mk', 'lk'][o_orderkey % 3 + 1]"
    words = words | {
        "person": "['요한', '마가', '누가'][o_orderkey % 3 + 1]", "variant": "replace(ko, '일서', ' 1서')", "ordinal": "replace(en, '1 ', 'First ')",
    }
    texts, rows, n = [], [], len(which)
    for k, sentence in enumerate(which):
        whole = "".join(map(_plain, sentence))
        texts.append(f"WHEN {k} THEN {_sql(whole, words)}")
        for i, piece in enumerate(sentence):
            if isinstance(piece, Ref):
                before, own = _sql("".join(map(_plain, sentence[:i])), words), _sql(piece.text, words)
                names = "true" if piece.abbrev == "who" else "en IN ('John', 'Mark', 'Luke')" if "{en}" in piece.text or "{ordinal}" in piece.text else "false"
                for item, places in enumerate(piece.items):
                    at = ", ".join("CAST(NULL AS INT)" if p is None else f"CAST({p} AS INT)" for p in places)
                    score = f"(60 + {20 * any(t in whole for t in TRIGGERED)} - {20 * (places[1] is None)} - CASE WHEN {names} THEN 20 ELSE 0 END) / 100.0::DOUBLE"
                    rows.append(
                        f"SELECT o_orderkey, {item} AS item, {who if piece.abbrev == 'who' else piece.abbrev} AS abbrev, {at}, {own} AS matched, CAST(length({before}) + 1 AS INT) AS start,"
                        f" CAST(length({before}) + length({own}) AS INT) AS \"end\", {score} AS confidence FROM {orders} WHERE o_orderkey % {n} = {k}"
                    )
    return (
        f"{'' if found == 'expected' else found + '_'}spoken AS (SELECT o_orderkey, CASE o_orderkey % {n} {' '.join(texts)} END AS text FROM {orders}), "
        f"{found}(o_orderkey, item, abbrev, ch, v1, ch2, v2, matched, start, \"end\", confidence) AS ({' UNION ALL '.join(rows)})"
    )
