"""SimHash fingerprints and the groups that near fingerprints form.

Candidates come from an inverted index over byte positions. Two fingerprints that differ in at most two bits differ
in at most two of their eight bytes, so at least six positional bytes are shared. A posting is keyed by four positions and
their bytes, as single bytes would put every 256th fingerprint of the corpus into one. The positions are taken together in fourteen ways:
those fours of the numbers 0 to 7 whose exclusive or is zero. Any three positions lie in one of these fours, so two fingerprints that share
six, seven or eight bytes meet in 3, 7 or 14 postings, those that share five or four in one at most, all others in none. So the
meetings of each pair are tallied, the pairs that reach the guaranteed three are kept and verified by their differing bits.
The rows of a long posting are dealt out once more by two of the other four positions and their bytes, of which a pair with six shared ones has
one at least in common; where it has several, the first counts. So a posting's pairs don't grow with its square.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lectern.llm.common import cut, joined
from lectern.llm.components import connected_components

BITS, BYTES, MOST_BITS = 64, 8, 2
#: The positions that make a key together, and the postings in which two fingerprints of six shared bytes meet.
FOURS = [x for x in combinations(range(BYTES), 4) if x[0] ^ x[1] ^ x[2] ^ x[3] == 0]
LEAST_MEETINGS = 3
#: Rows of a posting beyond which it is dealt out by two more positions.
POSTING = 64


def fingerprint_of(text: str | None, words: int) -> int:
    """The SimHash of a text's word shingles as a signed long."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    ones, n = np.zeros(BITS, np.int64), max(1, len(found) - words + 1)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(b" ".join(found[i : i + words]), 42) for i in range(at, min(n, at + (1 << 16)))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_udf(words: int):
    """fingerprint_of as a column."""

    @pandas_udf("long")
    def fingerprint(texts):
        import pandas as pd

        return pd.Series([fingerprint_of(t, words) for t in texts], dtype="int64")

    return fingerprint


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, fp) of every row. No words (a null, empty or blank text): zero; fewer than a shingle's: all of them."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), fingerprint_udf(words)(docs["text"]).alias("fp"))


def _mask(positions: tuple[int, ...]) -> int:
    """The bits of some byte positions, as a signed long."""
    n = sum(255 << 8 * i for i in positions)
    return n - 2**64 if n >= 2**63 else n


def _postings(nodes: DataFrame) -> DataFrame:
    """Each fingerprint under its fourteen keys: which four positions, and their bytes."""
    keys = [F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(_mask(four))).alias("bytes")) for i, four in enumerate(FOURS)]
    return nodes.select("fp", F.inline(F.array(*keys)))


def _first_shared(at: Column, x: Column) -> Column:
    """Of the pairs of positions outside the fours at, the number of the first that x leaves untouched."""
    out = F.lit(None).cast("int")
    for i, four in enumerate(FOURS):
        rest = F.lit(None).cast("int")
        for n, pair in reversed([*enumerate(combinations(sorted(set(range(BYTES)) - set(four)), 2))]):
            rest = F.when(x.bitwiseAND(F.lit(_mask(pair))) == 0, n).otherwise(rest)
        out = F.when(at == i, rest).otherwise(out)
    return out


def _finer(postings: DataFrame) -> DataFrame:
    """postings (fp, at, bytes) under six keys each: which two further positions, and their bytes."""
    out = F.array()
    for i, four in enumerate(FOURS):
        pairs = combinations(sorted(set(range(BYTES)) - set(four)), 2)
        keys = F.array(*[F.struct(F.lit(n).alias("sub"), F.col("fp").bitwiseAND(F.lit(_mask(pair))).alias("more")) for n, pair in enumerate(pairs)])
        out = keys if i == 0 else F.when(F.col("at") == i, keys).otherwise(out)
    return postings.select("fp", "at", "bytes", F.inline(out))


def _paired(postings: DataFrame, *key: str) -> DataFrame:
    """at and the ends (a < b) of every pair of a posting."""
    return postings.select(*key, F.col("fp").alias("a")).join(postings.select(*key, F.col("fp").alias("b")), [*key]).where("a < b")


def links(prints: DataFrame) -> DataFrame:
    """Every pair (src, dst; src < dst) of the distinct fingerprints (fp) that are within two bits of each other."""
    index = _postings(prints)
    length = index.groupBy("at", "bytes").agg(F.count("*").alias("length")).where("length > 1")
    listed = cut(index.join(length, ["at", "bytes"]))
    short, long_ = listed.where(F.col("length") <= POSTING), listed.where(F.col("length") > POSTING)
    x = F.col("a").bitwiseXOR(F.col("b"))
    finer = _paired(_finer(long_), "at", "bytes", "sub", "more").where(F.col("sub") == _first_shared(F.col("at"), x))
    meetings = _paired(short, "at", "bytes").select("a", "b").unionByName(finer.select("a", "b"))
    tally = meetings.groupBy("a", "b").agg(F.count("*").alias("meetings")).where(F.col("meetings") >= LEAST_MEETINGS)
    return tally.where(F.bit_count(x) <= MOST_BITS).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def grouped(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that links reach.

    Equal fingerprints are one node, so copies cost a row each and no pair. Rows that repeat a doc_id share its group
    (with different texts their groups are one). A row without doc_id links like any other and gets the least doc_id that it reaches, or null if
    there is none. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, words))
    named = marked.where("doc_id is not null")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    repeated = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    prints = cut(least)
    again = named.join(repeated, "doc_id").distinct()
    same = again.join(again.groupBy("doc_id").agg(F.min("fp").alias("src")), "doc_id").where("src <> fp").select("src", F.col("fp").alias("dst"))
    found = cut(connected_components(links(prints.select("fp")).union(same)))
    of = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = cut(of).groupBy("component").agg(F.min("least").alias("component_id"))
    known = of.join(ids, "component").select("fp", "component_id")
    return joined(marked, known, "fp").select("doc_id", "fp", "component_id")
