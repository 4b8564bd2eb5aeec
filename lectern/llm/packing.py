"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they are read; only their pieces' lengths and checksums go on, a few numbers each. Pieces are dealt
out at random and packed online by tasks of PIECES each, with a fixed number of open sequences. They come in windows, the
longest of a window first, so that small ones fill what large ones leave. A bitset has a bit for every free length that an open
sequence has; the best fit is its lowest bit at or above a piece's length. When no open one fits and all places are taken, the
fullest is closed. The number of packing tasks follows from the number of pieces and not from how the documents were split, so
what tasks leave open stays a small share at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, small_batches, text_of
from lectern.llm.tokens import encoder, in_chunks

#: Pieces that one task packs, about, and those of a window, which are placed longest first.
PIECES, WINDOW = 500_000, 8_192
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Open sequences by free length: a bitset of the lengths there are, and the sequences of each."""

    def __init__(self, size: int, limit: int) -> None:
        self.size, self.limit = size, limit
        self.bits, self.open, self.next = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to size ids."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.size, self.next
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document, end_id included."""

    def pieces(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pandas as pd

        encode, end, names = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes(), ["doc_id", "piece", "start", "length", "ids_crc32"]
        for pdf in batches:
            docs_, texts, rows = [None if x is None else int(x) for x in pdf["doc_id"]], pdf["text"].tolist(), []
            for a, b in in_chunks(texts):
                for doc, ids in zip(docs_[a:b], encode(texts[a:b])):
                    ids = memoryview(ids + end)
                    for piece, start in enumerate(range(0, len(ids) // 4, size)):
                        part = ids[4 * start : 4 * (start + size)]
                        rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
            columns = dict(zip(names, list(zip(*rows)) or [()] * 5))
            yield pd.DataFrame(columns | {"doc_id": pd.array(columns["doc_id"], "Int64")})

    # doc_id goes as text: beside a null, a large whole number would lose digits on its way.
    texts = small_batches(docs).select(docs["doc_id"].cast("long").cast("string").alias("doc_id"), text_of().alias("text"))
    return texts.mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, open_bins: int = 4096, pieces: int = PIECES) -> DataFrame:
    """A row for each piece of each document: where it starts in its document and where it lies in which sequence.

    docs: doc_id, text (other columns are ignored). A null or empty text is the end id alone, a piece of length 1.
    Only documents longer than size are cut, every size ids. Rows that repeat a doc_id, or have none, are packed
    like any other. sequence_id is the packing task's number and a count; a task takes its pieces in an order that follows from
    the written table, so a repeated task gives the same rows. An empty table gives no rows.
    """
    rows = cut(tokenised(docs, tokenizer, end_id, size))
    n = rows.count()
    tasks, windows = max(1, math.ceil(n / pieces)), max(1, math.ceil(n / WINDOW))

    def pack(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 36, OpenBins(size, open_bins)
        for pdf in batches:
            number, offset = zip(*map(bins.place, pdf["length"].tolist())) if len(pdf) else ((), ())
            yield pdf.drop(columns="order").assign(sequence_id=[base + n for n in number], offset=list(offset))

    # Dealt out by place in the written table, so that equal rows don't gather in a task.
    named = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(windows)).alias("order"))
    dealt = named.repartition(tasks, "order").sortWithinPartitions("order", F.desc("length"), "ids_crc32", "doc_id", "piece")
    found = dealt.mapInPandas(pack, SCHEMA.replace("doc_id long", "doc_id string"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
