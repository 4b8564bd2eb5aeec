"""Codes of integer vectors: codebooks by weighted Lloyd rounds over the distinct parts of each position.

A vector's components become integers and the vector is cut into parts. Equal parts of a position are one row with a weight, so what many
vectors share (a third of them may be equal) is compared once. Each round gives every distinct part to the nearest entry of its position's
codebook and sums weights and components by entry, first within a task's batch, then over tasks; the driver gets only these sums, as many
as the codebooks have numbers. At the end each distinct part has a code and an error, which are joined back to the vectors. All arithmetic
is on whole numbers, so the result does not depend on the order of rows or tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import HOT, cut, joined

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers are held within so much of zero (vectors within 65,536 at SCALE 1,024), so that distances are whole numbers of 64 bits.
FAR = 1 << 26
#: Labels whose sums are broadcast, at most; more are joined by key.
FEW = 50_000


def bounds_of(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; equal in length if dim allows it, else apart by one."""
    return [dim * i // parts for i in range(parts + 1)]


def packed(part) -> bytes:
    """A part's integers in the fewest bytes each, of two and four, that hold them: equal for equal parts alone, as all have one length."""
    import numpy as np

    small = part.astype("<i2")
    return (small if (small == part).all() else part.astype("<i4")).tobytes()


def unpacked(column, length: int):
    import numpy as np

    return np.array([np.frombuffer(p, "<i2" if len(p) == 2 * length else "<i4") for p in column], np.int64).reshape(-1, length)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows whose vector isn't null and holds neither nulls nor numbers that aren't finite."""
    x = F.col("embedding")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    return rows.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def whole(embedding, scale: int = SCALE):
    """The components of a batch of vectors as integers, rounded down."""
    import numpy as np

    return np.clip(np.floor(np.stack(embedding) * scale), -FAR, FAR).astype(np.int64)


def parted(rows: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """row, vec_id, label and parts (binaries) of rows."""
    at, label = bounds_of(dim, parts), rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                x = whole(pdf.pop("embedding"), scale)
                cuts = [[packed(p) for p in x[:, a:b]] for a, b in zip(at, at[1:])]
                yield pd.concat([pdf, pd.Series([list(p) for p in zip(*cuts)], index=pdf.index, name="parts")], axis=1)

    # vec_id and label pass as text: beside a null, large whole numbers would lose digits.
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    made = rows.mapInPandas(run, "row long, vec_id string, label string, parts array<binary>")
    return made.withColumns({"vec_id": F.col("vec_id").cast("long"), "label": F.col("label").cast(label)})


def nearest(x, entries):
    """(index, squared distance) of the entry nearest to each row of x, ties to the lower index; exact."""
    import numpy as np

    largest = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * largest * largest * max(1, x.shape[1]) < 2**53 else np.int64  # doubles are exact up to there
    e = entries.astype(kind)
    half, out, index = (e * e).sum(1), [], []
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096].astype(kind)
        d = half - 2 * (part @ e.T)
        best = d.argmin(1)
        index.append(best)
        out.append((d[np.arange(len(part)), best] + (part * part).sum(1)).astype(np.int64))
    return (np.concatenate(index), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sums(distinct: DataFrame, books: list) -> list:
    """(position, entry, weight, sums of components) of the distinct parts that are nearest to each entry."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for k, own in pdf.groupby("position"):
                entries = books[int(k)]
                x, weight = unpacked(own["part"], entries.shape[1]), own["weight"].to_numpy(np.int64)
                at, _ = nearest(x, entries)
                for entry in np.unique(at):
                    mine = at == entry
                    out.append((int(k), int(entry), int(weight[mine].sum()), (x[mine] * weight[mine, None]).sum(0).tolist()))
            yield pd.DataFrame(out, columns=["position", "entry", "weight", "sums"])

    found = distinct.mapInPandas(run, "position int, entry int, weight long, sums array<long>")
    each = found.select("position", "entry", "weight", F.posexplode("sums").alias("at", "value"))
    total = each.groupBy("position", "entry", "at").agg(F.sum("weight").alias("weight"), F.sum("value").alias("value"))
    return total.collect()


def lloyd(distinct: DataFrame, books: list, rounds: int = ROUNDS) -> list:
    """The codebooks (an array of entries a position) after rounds of Lloyd over distinct parts (position, part, weight)."""
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for r in _sums(distinct, books):
            books[r["position"]][r["entry"], r["at"]] = r["value"] // r["weight"]
    return books


def _coded(distinct: DataFrame, books: list) -> DataFrame:
    """distinct with code (two hex digits, more if there are more than 256 entries) and error."""
    digits = max(2, len(f"{max(map(len, books)) - 1:x}"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for k, own in pdf.groupby("position"):
                at, error = nearest(unpacked(own["part"], books[int(k)].shape[1]), books[int(k)])
                yield pd.DataFrame({"position": own["position"], "part": own["part"], "weight": own["weight"], "code": [f"{a:0{digits}x}" for a in at], "error": error})

    return distinct.mapInPandas(run, "position int, part binary, weight long, code string, error long")


def digest(books: list) -> str:
    """SHA-256 of all entries' integers by part, entry and position within the part, as decimals with commas between."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with label_error: error summed over the rows of one label, nulls together.

    The sums are combined before the shuffle; those of few labels are broadcast, more are joined by key with frequent labels dealt over tasks.
    """
    key = rows.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = cut(key.groupBy("__label").agg(F.sum("error").alias("label_error")))
    found = key.join(F.broadcast(sums), "__label") if sums.count() <= FEW else joined(key, sums, "__label")
    return found.drop("__label")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list]:
    """(vec_id, label, code, error, label_error of every row that takes part; the codebooks).

    vectors: vec_id, embedding, label. Rows whose vector is null or holds nulls or numbers that aren't finite are left out, and
    so are those of another length than the row of the least vec_id (of several, that of the least vector). Codebooks
    start from the vectors of the least vec_ids; rows that repeat one come in the order of their vectors, rows without one last. With fewer
    rows than entries there are as many entries as rows. Integers beyond FAR count as FAR. An empty vector has parts without
    components, which are all equal. Other columns are ignored. Tables without usable rows give no rows and no codebooks.
    """
    import numpy as np

    spark, rows = vectors.sparkSession, usable(vectors)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = rows.orderBy(*order).select(F.size("embedding")).first()
    if first is None:
        label = rows.schema["label"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long"), []
    dim = first[0]
    rows = rows.where(F.size("embedding") == dim)
    seeds = whole([r["embedding"] for r in rows.orderBy(*order).select("embedding").limit(entries).collect()], scale).reshape(-1, dim)
    at = bounds_of(dim, parts)
    books = [seeds[:, a:b] for a, b in zip(at, at[1:])]

    cuts = cut(parted(rows, dim, parts, scale))
    each = cuts.select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part"))
    distinct = cut(each.groupBy("position", "part").agg(F.count("*").alias("weight")))
    books = lloyd(distinct, books, rounds)
    coded = cut(_coded(distinct, books))

    # Parts that very many vectors share are few, as each has more than HOT rows: they are broadcast and move no row.
    often = coded.where(F.col("weight") > HOT).select("position", "part", "code", "error")
    rest = coded.where(F.col("weight") <= HOT).select("position", "part", F.col("code").alias("own_code"), F.col("error").alias("own_error"))
    found = each.join(F.broadcast(often), ["position", "part"], "left")
    found = found.where(F.col("code").isNotNull()).drop("part").unionByName(
        found.where(F.col("code").isNull()).drop("code", "error").join(rest, ["position", "part"]).drop("part").withColumnsRenamed({"own_code": "code", "own_error": "error"})
    )
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda c: c["code"]), "")
    whole_rows = found.groupBy("row", "vec_id", "label").agg(codes.alias("code"), F.sum("error").alias("error")).drop("row")
    return with_label_error(cut(whole_rows)), books
