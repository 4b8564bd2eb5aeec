"""Shards of near equal bytes, or of a fixed capacity and few in number, by best-fit-decreasing bin packing.

The groups that a shard keeps whole are the copies of one text. Groups go in, largest first, to the shard whose free space is the least
that holds them, which a balanced tree of the free spaces finds. One such pass over all groups would be one task, so packing has levels:
groups are dealt to blocks of a bounded number, a task packs each block's into bundles of a small share of a shard's capacity, and
bundles are packed in turn; the last level, of bundles alone, makes the shards. For a given number of shards the capacity is the least,
found by halving, with which best fit needs no more. Rows then meet their group's shard by one shuffle and are written to files; a row's slot is its place
in its shard's files, which are counted and not sorted. A task writes a file for each shard it has rows of, so the bytes of the texts, not the
partitions of that shuffle, say how many tasks write.

A group of more bytes than a shard's share can't stay whole if shards are to be near equal (a third of all rows may be copies of one
text): it is cut into as few pieces as that share allows, and its rows are dealt evenly to the pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, new_folder, text_of, unused

#: Groups or bundles of a block, about, and items of the last level, at most.
BLOCK, LAST = 8_192, 65_536
#: Bundles that fill the shards of a last level, about; there are at least LEAST in a shard.
BUNDLES, LEAST = 16_384, 8
#: Shards of a fixed capacity that are packed together, about.
DOMAIN = 32
#: Rows of a group that one task joins or numbers, about.
HOT = 100_000
#: Bytes of texts that a task writes, about.
TASK = 64 << 20
#: Files whose first slots are broadcast, at most; those of more files are joined by key.
FILES = 100_000
RESULT = ["size", "law", "shard", "slot", "grown_shard"]


class Free:
    """The free spaces of open bins as a height-balanced search tree of (space, bin)."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None  # a node is (key, lower, higher, height)

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._with(self.root, key)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least space that holds size, of equal ones that of the first bin."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self.root = self._without(self.root, best)
        return best

    def _with(self, node, key):
        if node is None:
            return key, None, None, 1
        at, low, high, _ = node
        return _balanced(at, self._with(low, key), high) if key < at else _balanced(at, low, self._with(high, key))

    def _without(self, node, key):
        at, low, high, _ = node
        if key < at:
            return _balanced(at, self._without(low, key), high)
        if key > at:
            return _balanced(at, low, self._without(high, key))
        if low is None or high is None:
            return low or high
        heir = high
        while heir[1] is not None:
            heir = heir[1]
        return _balanced(heir[0], low, self._without(high, heir[0]))


def _height(node) -> int:
    return 0 if node is None else node[3]


def _node(key, low, high):
    return key, low, high, 1 + max(_height(low), _height(high))


def _balanced(key, low, high):
    """A node over two trees whose heights differ by two at most, turned where they differ by two."""
    if _height(low) > _height(high) + 1:
        k, a, b, _ = low
        if _height(a) >= _height(b):
            return _node(k, a, _node(key, b, high))
        return _node(b[0], _node(k, a, b[1]), _node(key, b[2], high))
    if _height(high) > _height(low) + 1:
        k, a, b, _ = high
        if _height(b) >= _height(a):
            return _node(k, _node(key, low, a), b)
        return _node(a[0], _node(key, low, a[1]), _node(k, a[2], b))
    return _node(key, low, high)


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each of the sizes, which descend; None if more than most bins would be needed. A larger item has a bin of its own."""
    free, bins, used, least = Free(), [], 0, sizes[-1] if sizes else 0
    for size in sizes:
        space, at = free.take(size) or (capacity, used)
        if at == used:
            if used == most:
                return None
            used += 1
        bins.append(at)
        if space - size >= least:
            free.add((space - size, at))
    return bins


def even(sizes: list[int], shards: int) -> list[int]:
    """The bin of each of the sizes, which descend, with the least capacity (to one part in 4,096) for which best fit needs no more than so many bins."""
    low = max([-(-sum(sizes) // shards), *sizes[:1]])
    found, high = best_fit(sizes, low, shards), low
    while found is None:  # twice the mean is always enough
        high += max(1, low // 16)
        found = best_fit(sizes, high, shards)
    while high - low > max(1, low // 4096):
        middle = (low + high) // 2
        bins = best_fit(sizes, middle, shards)
        if bins is None:
            low = middle
        else:
            found, high = bins, middle
    return found


def _packed(items: DataFrame, by: list[str], capacity: int, shards: int | None, name: str) -> DataFrame:
    """items (item, bytes and the columns by) with the bin that best fit gives each in its group of equal by, as the column name."""

    def run(pdf):
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
        sizes = pdf["bytes"].tolist()
        pdf[name] = best_fit(sizes, capacity) if shards is None else even(sizes, shards)
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.groupBy(*by).applyInPandas(run, f"{schema}, `{name}` int")


def packed(groups: DataFrame, total: int, capacity: int, shards: int | None = None) -> DataFrame:
    """(item, shard) of groups (item, bytes), which hold total bytes: in so many shards of near equal bytes, or in few shards of a capacity.

    Every level's items are groups of a bounded number, so no task holds more than BLOCK or LAST of them. For a given capacity
    the groups are dealt to domains of about DOMAIN shards, each packed alone, so at most one shard in DOMAIN is filled in part more than needed.
    groups is read twice.
    """
    domains = 1 if shards else max(1, round(total / (capacity * DOMAIN)))
    share = max(1, capacity // max(LEAST, BUNDLES // (shards or DOMAIN)))
    items = groups.select("item", "bytes", F.pmod(F.xxhash64("item"), F.lit(domains)).cast("int").alias("domain"))
    n, up = items.count(), []
    while True:
        blocks = max(1, math.ceil(n / domains / BLOCK))
        level = _packed(items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(blocks)).cast("int")), ["domain", "block"], share, None, "bin")
        level = cut(level.coalesce(tasks := domains * blocks))  # a partition without a block is a file for nothing
        level = level.withColumn("bundle", F.format_string("%010d-%010d-%010d", "domain", "block", "bin"))
        up.append((level.select("item", "bundle"), tasks))
        items = cut(level.groupBy("domain", F.col("bundle").alias("item")).agg(F.sum("bytes").alias("bytes")).coalesce(tasks))
        before, n = n, items.count()
        if n <= LAST * domains or n > before // 2:
            break
        share *= 2
    found = cut(_packed(items, ["domain"], capacity, shards, "shard").coalesce(domains))
    if domains > 1:
        first = found.groupBy("domain").agg((F.max("shard") + 1).alias("n"))
        first = first.select("domain", (F.sum("n").over(Window.orderBy("domain")) - F.col("n")).cast("int").alias("first"))
        found = found.join(first, "domain").withColumn("shard", F.col("shard") + F.col("first"))
    found = found.select("item", "shard")
    for level, tasks in reversed(up):
        found = level.join(found.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard").coalesce(tasks)
    return found


def _size(text: Column) -> Column:
    return F.octet_length(text).cast("long") + 1


def assigned(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """docs (all columns) with size and shard: in so many shards of near equal bytes, or in as few as best fit makes of a capacity.

    A document's size is its text's UTF-8 bytes and one; a null text counts as an empty one and shares its group. Equal texts share a
    shard, but for groups of more bytes than a shard should have: their rows are dealt evenly to pieces. A single document larger than a
    shard's share or capacity has a shard of its own if it is the capacity that is given, and else makes that shard as large as it must be. Rows
    that repeat a doc_id or lack one are rows like others. Columns of docs named size or shard are replaced. An empty
    table gives no rows. There are no more partitions than one for each TASK bytes, rounded up to a multiple of the cores.
    """
    if (shards is None) == (capacity is None) or (shards or capacity) < 1:
        raise ValueError("give a number of shards or a capacity, of one at least")
    key, piece = unused(docs, "__text"), unused(docs, "__piece")
    rows = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "shard")])
    rows = rows.withColumns({key: F.unhex(F.sha2(text_of().cast("binary"), 256)), "size": _size(text_of())})
    groups = cut(rows.groupBy(F.col(key).alias("text")).agg(F.first("size").alias("size"), F.count("*").alias("n")))
    total, widest = groups.agg(F.sum(F.col("size") * F.col("n")), F.max("size")).first()
    share = capacity or max(-(-(total or 0) // shards), widest or 1)
    # Each part of a group's rows is dealt to the pieces alone, so that a piece may get a row a part more than its even share.
    parts = F.ceil(F.col("n") / HOT).cast("int")
    copies = F.greatest(F.lit(1), F.floor(F.lit(share) / F.col("size")) - F.col("parts") + 1)
    pieces = F.when((F.col("n") > 1) & (F.col("n") * F.col("size") > share), F.ceil(F.col("n") / copies)).otherwise(1)
    groups = groups.withColumn("parts", parts).withColumn("pieces", pieces.cast("int"))
    each = groups.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    item = F.concat("text", F.encode(F.format_string("%010d", "piece"), "utf-8")).alias("item")
    own = F.when(F.col("pieces") == 1, F.col("n")).otherwise(F.ceil((F.col("n") - F.col("piece")) / F.col("pieces")) + F.col("parts") - 1) * F.col("size")
    found = packed(each.select(item, own.cast("long").alias("bytes")), total or 0, share, shards)
    at = cut(found.select(F.substring("item", 1, 32).alias(key), F.decode(F.expr("substring(item, 33)"), "utf-8").cast("int").alias(piece), "shard"))

    # Of groups of many rows there are few: each has more than HOT rows or more bytes than a shard's share.
    hot = F.broadcast(groups.where((F.col("pieces") > 1) | (F.col("n") > HOT)).select(F.col("text").alias(key), "pieces", "parts"))
    part, pieces_, parts_ = unused(docs, "__part"), unused(docs, "__pieces"), unused(docs, "__parts")
    hot = hot.withColumnsRenamed({"pieces": pieces_, "parts": parts_})
    rows = rows.join(hot, key, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(parts_)).cast("int"), F.lit(0)))
    whole = rows.where(F.coalesce(F.col(pieces_), F.lit(1)) == 1).withColumn(piece, F.lit(0))
    if groups.where("pieces > 1").limit(1).count():
        dealt = rows.where(F.col(pieces_) > 1)
        number = F.row_number().over(Window.partitionBy(key, part).orderBy(F.lit(0))) - 1 + F.col(part)
        whole = whole.unionByName(dealt.withColumn(piece, F.pmod(number, F.col(pieces_)).cast("int")))
    each = at.join(hot.select(key, parts_), key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts_), F.lit(1)) - 1))).drop(parts_)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, math.ceil((total or 0) / TASK / cores))  # whole rounds
    return whole.drop(pieces_, parts_).join(each, [key, piece, part]).drop(key, piece, part).coalesce(tasks)


def write(docs: DataFrame, folder: str, shards: int | None = None, capacity: int | None = None) -> None:
    """Writes docs to folder as Parquet, one folder shard=N a shard, with assigned()'s size."""
    assigned(docs, shards, capacity).write.partitionBy("shard").parquet(folder)


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of a folder of shards (schema: their columns without slot) with slot: the place in the shard, files in order of their names.

    Files are numbered by counts alone, so no row is sorted, nor moved unless there are more than FILES files.
    """
    rows = spark.read.schema(schema).parquet(folder)
    taken = rows.columns
    file, at = unused(rows, "__file"), unused(rows, "__at")
    rows = rows.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
    counts = rows.groupBy("shard", file).agg(F.count("*").alias("n"))
    first = counts.select("shard", file, (F.sum("n").over(Window.partitionBy("shard").orderBy(file)) - F.col("n")).alias("n"))
    first = first.withColumnRenamed("n", unused(rows, "__first"))
    first = F.broadcast(first) if counts.count() <= FILES else first
    return rows.join(first, ["shard", file]).select(*taken, (F.col(unused(rows, "__first")) + F.col(at)).alias("slot"))


def sharded(docs: DataFrame, shards: int = 16, capacity: int | None = None, folder: str | None = None) -> DataFrame:
    """docs (all columns) with size, law ('bytes'), shard, slot (gapless from 0 in each shard) and grown_shard (null), from the written shards.

    Odd rows as in assigned(). Columns of docs with the names of these are replaced. folder: by default a new one in the shared folder.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULT])
    folder = folder or new_folder(docs.sparkSession, "shards")
    rows = assigned(docs, None if capacity else shards, capacity)
    schema = rows.schema
    rows.write.partitionBy("shard").parquet(folder)
    found = read(docs.sparkSession, folder, schema)
    return found.select(*docs.columns, "size", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
