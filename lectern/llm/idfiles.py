"""Token ids in files of fixed-width packed integers.

A shard holds whole documents in ascending doc_id order:

    magic FWB1, width in bits (u32), ids in a block (u32)
    blocks: the ids, width bits each, lowest bit first; every block is padded to whole bytes
    block offsets (u64 each): where each block begins
    documents: doc_id (i64), flags (i64, 1: doc_id is null), first id (u64) and, once more at the end, the number of ids
    footer: where the offsets begin (u64), blocks (u64), documents (u64), ids (u64), crc32 of offsets and documents (u32), magic

Widths are as small as the vocabulary allows, so any id's place follows from its number, and a block is unpacked by
one numpy call. Shards are closed after SHARD_IDS ids; a document is never split between two.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import new_folder, parts, text_of
from lectern.llm.storage import attempt_name, opened
from lectern.llm.tokens import encoder, in_chunks

MAGIC, BLOCK_IDS, SHARD_IDS = b"FWB1", 1 << 15, 1 << 26
HEAD, FOOT = struct.Struct("<4sII"), struct.Struct("<QQQQI4s")
MANIFEST = "task int, shard int, path string, documents long, ids long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold every id under vocabulary, at least one."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids, width: int) -> bytes:
    """ids (any whole numbers under 2 ** width) as one run of bits, padded to whole bytes."""
    import numpy as np

    if width in (8, 16, 32):  # the same bits, without taking them apart
        small = np.asarray(ids).astype(f"<u{width // 8}")
        if not np.array_equal(small, ids):
            raise ValueError(f"an id needs more than {width} bits")
        return small.tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    if bits[:, width:].any():
        raise ValueError(f"an id needs more than {width} bits")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int):
    """The first n ids of a run of bits."""
    import numpy as np

    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard to an open binary file; holds a block of ids and 24 bytes a document."""

    def __init__(self, out, width: int, block: int = BLOCK_IDS) -> None:
        self.out, self.width, self.block = out, width, block
        self.waiting, self.held, self.ids = [], 0, 0
        self.offsets: list[int] = []
        self.documents: list[tuple[int, int, int]] = []
        self.at = out.write(HEAD.pack(MAGIC, width, block)) and HEAD.size

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.documents.append((doc_id or 0, int(doc_id is None), self.ids))
        self.waiting.append(ids)
        self.held += len(ids) // 4
        self.ids += len(ids) // 4
        if self.held >= self.block:
            self._flush(self.held // self.block * self.block)

    def _flush(self, n: int) -> None:
        import numpy as np

        whole = np.frombuffer(b"".join(self.waiting), "<u4")
        for i in range(0, n, self.block):
            self.offsets.append(self.at)
            self.at += self.out.write(data := pack(whole[i : min(n, i + self.block)], self.width)) and len(data)
        self.waiting, self.held = [whole[n:].tobytes()], len(whole) - n

    def close(self) -> None:
        import numpy as np

        self._flush(self.held)
        table = np.array(self.documents, np.int64).reshape(-1, 3)
        tail = np.array(self.offsets, "<u8").tobytes() + table.astype("<i8").tobytes() + struct.pack("<Q", self.ids)
        self.out.write(tail)
        self.out.write(FOOT.pack(self.at, len(self.offsets), len(table), self.ids, zlib.crc32(tail), MAGIC))


class Shard:
    """A shard for reading, any document by its number; source: a seekable binary file."""

    def __init__(self, source) -> None:
        import numpy as np

        self.source = source
        end = source.seek(0, 2)
        source.seek(end - FOOT.size)
        at, blocks, documents, self.ids, crc, magic = FOOT.unpack(source.read(FOOT.size))
        source.seek(at)
        tail = source.read(end - FOOT.size - at)
        source.seek(0)
        first, self.width, self.block = HEAD.unpack(source.read(HEAD.size))
        if (magic, first, zlib.crc32(tail)) != (MAGIC, MAGIC, crc):
            raise ValueError("not a whole file of packed ids")
        self.offsets = np.frombuffer(tail, "<u8", blocks)
        table = np.frombuffer(tail, "<i8", 3 * documents, 8 * blocks).reshape(-1, 3)
        self.doc_ids, self.null = table[:, 0], table[:, 1] == 1
        self.starts = np.append(table[:, 2], self.ids)
        self._cached: tuple = (-1, None)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _block(self, number: int):
        if self._cached[0] != number:
            n = min(self.block, self.ids - number * self.block)
            self.source.seek(int(self.offsets[number]))
            self._cached = number, unpack(self.source.read((n * self.width + 7) // 8), self.width, n)
        return self._cached[1]

    def document(self, number: int):
        """The ids of the document at a place, as unsigned 32-bit integers."""
        import numpy as np

        a, b = int(self.starts[number]), int(self.starts[number + 1])
        found = [self._block(k)[max(0, a - k * self.block) : b - k * self.block] for k in range(a // self.block, -(-b // self.block))]
        return np.concatenate(found) if found else np.zeros(0, "<u4")


def ids_of(tokenizer: str, end_id: int) -> int:
    """How many ids there are: those of the tokenizer's file and the end id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)


def written(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, folder: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards of docs (doc_id, text) under folder and returns their manifest, itself a table there.

    One range shuffle puts the documents in ascending order, rows without doc_id first; rows that repeat a doc_id may
    be dealt to several tasks. A manifest row appears only for a task that ended well, so files of lost attempts
    are never read.
    """
    width = width_of(vocabulary)

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        encode, end, rows = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes(), []
        system, top = opened(folder)
        task, base = TaskContext.get().partitionId(), attempt_name()
        out = shard = None

        def finish() -> None:
            shard.close()
            out.close()
            rows.append((task, len(rows), f"{folder}/{base}-{len(rows):04d}.ids", len(shard.documents), shard.ids))

        for pdf in batches:
            ids_, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for a, b in in_chunks(texts):
                for doc_id, ids in zip(ids_[a:b], encode(texts[a:b])):
                    if shard is None:
                        system.create_dir(top, recursive=True)
                        out = system.open_output_stream(f"{top}/{base}-{len(rows):04d}.ids")
                        shard = ShardWriter(out, width)
                    shard.add(None if pd.isna(doc_id) else int(doc_id), ids + end)
                    if shard.ids >= shard_ids:
                        finish()
                        shard = None
        if shard is not None:
            finish()
        yield pd.DataFrame(rows, columns=["task", "shard", "path", "documents", "ids"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).withColumn("at", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts(docs), "doc_id", "at").sortWithinPartitions("doc_id", "at")
    # Object columns keep whole numbers beyond 2**53 exact where a null is in the batch.
    dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the manifest's shards, from the files.

    The driver sees a number and a path for each shard, a few bytes for every SHARD_IDS ids, and hands each task one shard.
    """
    import itertools

    spark, shards = manifest.sparkSession, sorted(manifest.collect(), key=lambda r: (r["task"], r["shard"]))
    before = [0, *itertools.accumulate(r["ids"] for r in shards)]
    known = spark.createDataFrame([(i, r["path"], b) for i, (r, b) in enumerate(zip(shards, before))], "id long, path string, before long")

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path, first in zip(pdf["path"], pdf["before"]):
                system, at = opened(path)
                with system.open_input_file(at) as source:
                    shard = Shard(source)
                    for a in range(0, len(shard), 10_000):
                        b = min(len(shard), a + 10_000)
                        crc = [zlib.crc32(shard.document(i)) for i in range(a, b)]
                        doc_ids = pd.array(shard.doc_ids[a:b].astype(np.int64), "Int64")
                        doc_ids[shard.null[a:b]] = pd.NA
                        yield pd.DataFrame({"doc_id": doc_ids, "start": int(first) + shard.starts[a:b], "n_tokens": np.diff(shard.starts[a : b + 1]), "ids_crc32": crc})

    one_each = spark.range(0, len(shards), 1, max(1, len(shards)))
    return one_each.join(F.broadcast(known), "id").select("path", "before").mapInPandas(read, SCHEMA)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int | None = None) -> DataFrame:
    """Where each document of docs (doc_id, text) lies in the written ids, and their checksum, as read from the files.

    A null or empty text is the end id alone. Rows that repeat a doc_id lie one after the other, rows without one
    before all others. Other columns are ignored. An empty table gives no rows. vocabulary: by default the number of the tokenizer's ids.
    """
    return read_back(written(docs, tokenizer, end_id, vocabulary or ids_of(tokenizer, end_id), new_folder(docs.sparkSession, "ids")))
