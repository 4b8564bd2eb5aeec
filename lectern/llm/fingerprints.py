"""One-permutation MinHash fingerprints of five-word shingles.

Every shingle is hashed once; the top bits name its bin, and a bin keeps its least value. Empty bins borrow from a
full one that a second, fixed hash of the bin and the attempt names, in as many attempts as it takes (optimal densification). Of each bin the low four bits
are stored, a hexadecimal digit. Two fingerprints of unrelated texts agree in a sixteenth of their digits by chance, which
the likeness takes off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lectern.llm.common import cut, parts, sampled, text_of

WORDS, BINS, LOW_BITS = 5, 512, 4
#: Attempts that are made one by one; which full bin an empty one meets first in later ones is looked up.
ATTEMPTS = 32
#: Rows that one bucket of neighbouring ids holds at most, about, and rows sampled for the buckets' bounds, for each bucket.
BUCKET_ROWS, BOUND_ROWS = 16_384, 64
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class OnePermutation:
    """Fingerprints as arrays of the bins' low bits; None for a text without words."""

    def __init__(self, words: int = WORDS, bins: int = BINS, bits: int = LOW_BITS) -> None:
        import numpy as np

        self.np, self.words, self.bins, self.bits = np, words, bins, bits
        self.shift = np.uint64(64 - (bins - 1).bit_length())
        self.borrow = self.lenders(0, ATTEMPTS)
        self._first = None
        self.factors = [np.uint64((0xD1342543DE82EF95 * (2 * i + 1)) % 2**64 | 1) for i in range(words)]

    def mixed(self, x):
        """Spreads each bit of a 64-bit number over all."""
        np = self.np
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))

    def of(self, text: str):
        import xxhash

        np, found = self.np, text.encode().split()
        if not found:
            return None
        h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
        n, shingles = max(1, len(found) - self.words + 1), np.uint64(len(found[: self.words]))
        shingles = np.full(n, shingles, np.uint64)
        for i in range(min(self.words, len(found))):
            shingles += h[i : i + n] * self.factors[i]
        shingles = self.mixed(shingles)
        least = np.full(self.bins, 2**64 - 1, np.uint64)
        at = (shingles >> self.shift).astype(np.int64)
        np.minimum.at(least, at, shingles)
        full = np.zeros(self.bins, bool)
        full[at] = True
        out = (least & np.uint64(2**self.bits - 1)).astype(np.uint8)
        return self.densified(out, full)

    def lenders(self, first: int, last: int):
        """The bins that each bin asks in the attempts first to last, which are the same for every text."""
        np = self.np
        attempt = np.arange(first + 1, last + 1, dtype=np.uint64)[:, None]
        return (self.mixed(np.arange(self.bins, dtype=np.uint64) + attempt * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    @property
    def first(self):
        """first[a, b]: the attempt in which bin a asks bin b for the first time, made once, with as many attempts as it takes."""
        np = self.np
        if self._first is None:
            out, at, own = np.full((self.bins, self.bins), 2**31 - 1, np.int32), 0, np.arange(self.bins)
            while out.max() == 2**31 - 1:
                for i, row in enumerate(self.lenders(at, at + 1024)):
                    out[own, row] = np.minimum(out[own, row], at + i)
                at += 1024
            self._first = out
        return self._first

    def densified(self, values, full):
        """values with those of empty bins lent by full ones: each asks on until it meets one."""
        np, empty = self.np, self.np.flatnonzero(~full)
        out = values.copy()
        if len(empty):
            asked = self.borrow[:, empty]
            met = full[asked]
            at = met.argmax(axis=0)
            found = met[at, np.arange(len(empty))]
            out[empty[found]] = values[asked[at[found], np.flatnonzero(found)]]
            empty = empty[~found]
        if len(empty):
            there = np.flatnonzero(full)
            out[empty] = values[there[self.first[np.ix_(empty, there)].argmin(axis=1)]]
        return out

    def digits(self, fingerprint) -> str:
        if fingerprint is None:
            return "0" * self.bins
        return self.np.frombuffer(b"0123456789abcdef", self.np.uint8)[fingerprint].tobytes().decode()

    def likeness(self, a, b) -> float:
        """The estimated share of common shingles; without words only the same is like."""
        if a is None or b is None:
            return float(a is b)
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def _keys(known, ids, hashes):
    """Sortable bytes in the order of (doc_id, hash), rows without doc_id first."""
    import numpy as np

    out = np.zeros((len(known), 17), np.uint8)
    out[:, 0] = np.where(known, 2, 1)
    sign = np.uint64(1 << 63)  # signed order as unsigned
    out[:, 1:9] = (np.asarray(ids, np.int64).view(np.uint64) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = (np.asarray(hashes, np.int64).view(np.uint64) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()  # of one length, so that zeros at the end don't matter


def with_successor(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(at, own, doc_id, text) in partitions that hold whole buckets of neighbouring rows, in descending order of doc_id and the text's hash.

    Each bucket ends with a copy (own false) of the row at the head of the next one, and the last with the first's, so
    that every row's successor is in its partition. Rows without doc_id are the last, in buckets by their texts' hashes. Texts are
    shuffled once; the driver sees some keys and a head of each bucket, all numbers.
    """
    import numpy as np

    spark, named = docs.sparkSession, docs["doc_id"].cast("long")
    rows = docs.select(named.alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    keys = cut(rows.select("doc_id", "h"))
    n = keys.count()
    buckets = max(1, min(n, max(3 * parts(docs), math.ceil(n / bucket_rows))))
    few = sampled(keys.withColumn("place", F.monotonically_increasing_id()), BOUND_ROWS * buckets, "place").select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h").toPandas()
    order = np.sort(_keys(few["known"].to_numpy(), few["id"].to_numpy("int64"), few["h"].to_numpy("int64")))
    bounds = np.unique(order[[i * len(order) // buckets for i in range(1, buckets)]]) if len(order) else order

    @pandas_udf("int")
    def bucket(known, ids, hashes):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, _keys(known.to_numpy(), ids.to_numpy("int64"), hashes.to_numpy("int64")), side="right"), dtype="int32")

    at = bucket(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "h").alias("at")
    head = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("head")
    heads = sorted(((r["at"], r["head"]["doc_id"], r["head"]["h"]) for r in keys.select(at, "doc_id", "h").groupBy("at").agg(head).collect()), reverse=True)
    lends = [(heads[i][1], heads[i][2], heads[i - 1][0]) for i in range(len(heads))]
    lent = spark.createDataFrame(lends, "head long, head_h long, to int")
    homes = F.when(F.col("to").isNull(), F.array(F.struct(F.col("at"), F.lit(True).alias("own")))).otherwise(
        F.array(F.struct(F.col("at"), F.lit(True).alias("own")), F.struct(F.col("to").alias("at"), F.lit(False).alias("own")))
    )
    dealt = rows.select("doc_id", "h", "text", at).join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    dealt = dealt.select(F.inline(homes), "doc_id", "h", "text")
    return dealt.repartition(buckets, "at").sortWithinPartitions("at", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("h")).drop("h")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, its edited text's, and how like they and its successor's are.

    docs: doc_id, text. The successor is the next row in descending doc_id, rows without doc_id last, rows that repeat or lack one by the
    hash of their text, descending; the last row's is the first, and a single row is its own. The edited text has the last third
    of the code points replaced by as many of the successor's first. Texts without words have the fingerprint of
    zeros and are like nothing but each other. Fewer than five words are one shingle. An empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        method, held = OnePermutation(), None

        def row(doc_id, text, print_, next_text, next_print):
            n = len(text)
            edited = text[: n - n // 3] + next_text[: n // 3]
            changed = method.of(edited)
            return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), method.digits(print_), method.digits(changed), method.likeness(print_, changed), method.likeness(print_, next_print))

        for pdf in batches:
            rows = []
            for own, doc_id, text in zip(pdf["own"].tolist(), pdf["doc_id"].tolist(), pdf["text"].tolist()):
                if not own and held is None:
                    continue  # a further row of the lent head
                print_ = method.of(text)
                if held is not None:
                    rows.append(row(*held, text, print_))
                held = (None if doc_id is None else int(doc_id), text, print_) if own else None
            columns = dict(zip(["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], list(zip(*rows)) or [()] * 7))
            yield pd.DataFrame(columns | {"doc_id": pd.array(columns["doc_id"], "Int64")})

    # doc_id goes as text: beside a null, a large whole number would lose digits on its way.
    return with_successor(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, SCHEMA)
