"""Nearest neighbours from an inverted file with product-quantised residuals.

Coarse centroids come in two levels, so that their number can grow with the square root of the rows: the tops are fitted on a
bounded sample at the driver, the cells of each top by a task of its own. Every row is indexed under its nearest cell with a code of
its residual and the length of what the code leaves of it. Of equal vectors only the least ids can be among anyone's nearest, so only those are candidates, and a vector that a third
of all rows share costs no more than others. Rows of small cells share blocks, cells too large for one are dealt over several, so no group
grows with the data. A query visits its nearest cells' blocks; there a table of asymmetric distances gives each row's distance by code. The true one
differs from it by no more than what the code left, so the rows that can't be among the nearest fall out and no other does, whatever the
rows look like and however well codes fit them; the rest are ranked again by exact distances, and each block's best are merged. How many cells a query visits is
measured on the whole index: as many as make the stated share of true neighbours of a few queries reachable, and never fewer than
hold the candidates it needs. Queries that still lack neighbours, as those may all be rows of their own id, visit all cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, sampled

#: Rows that tops and codes are fitted on, about; rows that the cells are fitted on, about, for each cell; tops that a row's cell is looked for in.
SAMPLE_ROWS, CELL_ROWS, TOPS = 32_768, 16, 2
#: Parts that a residual is cut into, and the codes of each.
SUBSPACES, CODES = 16, 256
#: Rows of a block and queries of a chunk, about; rows that the cells a query visits hold at least; rows that exact distances are taken of at once.
BLOCK, CHUNK, LEAST_ROWS, STRIP = 8_192, 4_096, 128, 1_024
#: Rounding of sums of products, as a share of their largest terms.
ROUNDING = 1e-12
#: Queries that the number of visited cells is measured on, and the share of their true neighbours it must reach.
TRIAL_QUERIES, REACH = 96, 0.97


def centroids(rows, n: int, rounds: int = 8):
    """n centres of rows by Lloyd's rounds from evenly spaced rows; a centre that loses all rows stays."""
    import numpy as np

    centres = rows[np.linspace(0, len(rows) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(rows, centres)
        count = np.bincount(at, minlength=n)
        total = np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], axis=1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(rows, centres):
    import numpy as np

    half = (centres**2).sum(1) / 2
    return np.concatenate([(half - rows[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)


class Quantiser:
    """Coarse centres under their tops and, for each part of the residual, its codes' values.

    It goes with every task: the centres are four times the square root of the rows, the values fixed in number.
    """

    def __init__(self, sample, tops, cells: dict) -> None:
        import numpy as np

        self.dim, self.tops = sample.shape[1], tops
        found = [cells.get(t, tops[t : t + 1]) for t in range(len(tops))]
        self.coarse, self.ends = np.concatenate(found), np.cumsum([0, *map(len, found)])
        self.bounds = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        rest = sample - self.coarse[self.cell_of(sample)]
        self.values = [centroids(rest[:, a:b], min(CODES, len(rest))) for a, b in zip(self.bounds, self.bounds[1:])]

    def cell_of(self, rows):
        """The nearest cell of each row among those of its nearest tops."""
        import numpy as np

        far = (self.tops**2).sum(1) / 2 - rows @ self.tops.T
        least, cell = np.full(len(rows), np.inf), np.zeros(len(rows), int)
        near = np.argpartition(far, min(TOPS, far.shape[1]) - 1, axis=1)[:, :TOPS] if len(rows) else np.zeros((0, 1), int)
        for t in np.unique(near):
            own, (a, b) = np.flatnonzero((near == t).any(1)), self.ends[t : t + 2]
            distance = (self.coarse[a:b] ** 2).sum(1) / 2 - rows[own] @ self.coarse[a:b].T
            at = distance.argmin(1)
            best = distance[np.arange(len(own)), at]
            closer = best < least[own]
            least[own[closer]], cell[own[closer]] = best[closer], a + at[closer]
        return cell

    def index(self, rows):
        """(cell, codes, left) of each row: left is the length of its residual without the coded one, rounded up."""
        import numpy as np

        cell, codes, left = self.cell_of(rows), [], 0.0
        rest = rows - self.coarse[cell]
        for a, b, v in zip(self.bounds, self.bounds[1:], self.values):
            codes.append(nearest(rest[:, a:b], v))
            left = left + ((rest[:, a:b] - v[codes[-1]]) ** 2).sum(1)
        return cell, np.stack(codes, axis=1).astype(np.uint8), np.sqrt(left) + ROUNDING * np.sqrt((rest**2).sum(1))

    def order(self, queries, most: int):
        """The nearest cells of each query, nearest first."""
        import numpy as np

        far = (self.coarse**2).sum(1) / 2 - queries @ self.coarse.T
        if most >= far.shape[1]:
            return far.argsort(axis=1, kind="stable")
        some = np.argpartition(far, most - 1, axis=1)[:, :most]
        return np.take_along_axis(some, np.take_along_axis(far, some, 1).argsort(axis=1, kind="stable"), 1)

    def places(self, codes):
        """codes as places in a query's table."""
        import numpy as np

        return codes + np.cumsum([0, *[len(v) for v in self.values[:-1]]])

    def bias(self, cell, codes):
        """What a row adds to every query's squared distance: |r|^2 + 2 c.r for its centre c and coded residual r."""
        total = 0.0
        for k, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            coded = self.values[k][codes[:, k]]
            total = total + (coded * (coded + 2 * self.coarse[cell, a:b])).sum(1)
        return total

    def distances(self, query, centres, cell, places, bias):
        """(least, most) of the distances of a query to coded rows, which rounding leaves open; cell is each row's place in centres.

        The square is |q - c|^2 + bias - 2 q.r, the last from one table for the query.
        """
        import numpy as np

        table = np.concatenate([v @ query[a:b] for v, a, b in zip(self.values, self.bounds, self.bounds[1:])])
        far = ((centres - query) ** 2).sum(1)[cell]
        square = far + bias - 2 * table[places].sum(1)
        open_ = ROUNDING * (far.max() + np.abs(bias).max() + 2 * len(self.values) * np.abs(table).max())
        return np.sqrt(np.maximum(square - open_, 0)), np.sqrt(np.maximum(square + open_, 0))


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part: an id, and a finite vector that isn't zero."""
    x = F.col("embedding")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    return rows if dim is None else rows.where(F.size(x) == dim)


def packed(vectors) -> "list[bytes]":
    import numpy as np

    return [np.ascontiguousarray(v, "<f8").tobytes() for v in vectors]


def unpacked(column, dim: int):
    import numpy as np

    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dim)


def best_of(scores, ids, k: int):
    """The places of the k least scores, ties to the lesser id, in that order."""
    import numpy as np

    if len(scores) > k:
        bound = np.partition(scores, k - 1)[k - 1]
        at = np.flatnonzero(scores <= bound)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], scores[at]))][:k]


def exact_distances(rows, query, at):
    """The distances of a query to the rows at some places, a strip of them at a time, so that wide vectors take no second copy of a block."""
    import numpy as np

    return np.concatenate([np.zeros(0), *[np.sqrt(((rows[at[i : i + STRIP]] - query) ** 2).sum(1)) for i in range(0, len(at), STRIP)]])


def indexed(rows: DataFrame, model: Quantiser) -> DataFrame:
    """vec_id, cell, codes, left (see Quantiser.index) and vector (doubles as bytes) of every row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_numpy())
                cell, codes, left = model.index(x)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "cell": cell.astype("int32"), "codes": [c.tobytes() for c in codes], "left": left, "vector": packed(x)})

    return rows.mapInPandas(run, "vec_id long, cell int, codes binary, left double, vector binary")


def trained(rows: DataFrame, sample, n: int) -> Quantiser:
    """The quantiser of n rows (vec_id, embedding): tops from the sample, each top's cells from about CELL_ROWS rows a cell by a task of its own."""
    import numpy as np

    dim, cells = sample.shape[1], max(1, min(4 * math.isqrt(n) + 1, n // CELL_ROWS))
    tops = centroids(sample, min(len(sample), math.isqrt(cells)))
    steps = 1 << 30
    few = rows.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(steps)) < math.ceil(steps * min(1.0, cells * CELL_ROWS / n)))

    def under(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_numpy())
                yield pd.DataFrame({"top": nearest(x, tops), "vector": packed(x)})

    def fit(key, pdf):
        import pandas as pd

        x = np.unique(unpacked(pdf["vector"], dim), axis=0)  # sorted, so that the order in which rows come doesn't count
        x = x[np.random.default_rng(0).permutation(len(x))]
        own = centroids(x, max(1, min(len(x), round(len(pdf) / CELL_ROWS))))
        return pd.DataFrame({"top": key[0], "centres": [own.tobytes()]})

    found = few.mapInPandas(under, "top int, vector binary").groupBy("top").applyInPandas(fit, "top int, centres binary").collect()
    return Quantiser(sample, tops, {r["top"]: np.frombuffer(r["centres"], "<f8").reshape(-1, dim) for r in found})


def candidates(index: DataFrame, k: int) -> DataFrame:
    """The rows of index that can be among the k nearest of any query: of equal vectors those of the k + 1 least ids, of an id's rows k."""
    by_vector, by_id = Window.partitionBy("vector").orderBy("vec_id"), Window.partitionBy("vector", "vec_id").orderBy("cell")
    least = index.withColumn("__place", F.dense_rank().over(by_vector)).where(F.col("__place") <= k + 1).drop("__place")
    return least.withColumn("__place", F.row_number().over(by_id)).where(F.col("__place") <= k).drop("__place")


def _best_rows(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact(index: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query_id, rank, vec_id, score, cell of a few queries' true neighbours, by comparison with every row of the index."""
    import numpy as np

    ids, dim = np.array([q for q, _ in queries], np.int64), len(queries[0][1])
    x = np.array([v for _, v in queries], float)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows, own, out = unpacked(pdf["vector"], dim), pdf["vec_id"].to_numpy(), []
            for q, v in zip(ids, x):
                score = exact_distances(rows, v, np.arange(len(rows)))
                score[own == q] = np.inf
                at = best_of(score, own, k)
                at = at[np.isfinite(score[at])]
                out.append(pd.DataFrame({"query_id": q, "vec_id": own[at], "score": score[at], "cell": pdf["cell"].to_numpy()[at]}))
            if out:
                yield pd.concat(out)

    return _best_rows(index.select("vec_id", "cell", "vector").mapInPandas(run, "query_id long, vec_id long, score double, cell int"), k)


def visits(index: DataFrame, model: Quantiser, trial: list, k: int, reach: float = REACH) -> int:
    """The least number of cells whose visit reaches that share of the trial queries' true neighbours."""
    import numpy as np

    cells = len(model.coarse)
    if not trial:
        return cells
    found = exact(index, trial, k).collect()
    place = {q: np.argsort(order) for (q, _), order in zip(trial, model.order(np.array([v for _, v in trial], float), cells))}
    at = sorted(int(place[r["query_id"]][r["cell"]]) for r in found)
    return at[min(len(at) - 1, math.ceil(reach * len(at)) - 1)] + 1 if at else cells


class Layout:
    """Where cells lie: small cells one after the other until a block is full, large ones in several blocks.

    Cells of one top have neighbouring numbers, so a query's cells share blocks.
    """

    def __init__(self, count: dict[int, int]) -> None:
        self.count, self.first, self.blocks = count, {}, {}
        last, free = -1, 0
        for cell, n in sorted(count.items()):
            if n > free:
                self.first[cell], self.blocks[cell] = last + 1, max(1, math.ceil(n / BLOCK))
                last += self.blocks[cell]
                free = BLOCK - n if n <= BLOCK else 0
            else:
                self.first[cell], self.blocks[cell], free = last, 1, free - n


def _visited(queries: DataFrame, model: Quantiser, layout: Layout, most: int, enough: int) -> DataFrame:
    """block, query_id, vector, cells: for each query the blocks it visits, for its most nearest cells and on until they hold enough rows."""
    dim = model.dim

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        held = np.array([layout.count.get(c, 0) for c in range(len(model.coarse))])
        for pdf in batches:
            if len(pdf):
                x, out = unpacked(pdf["vector"], dim), []
                order = model.order(x, min(len(held), 2 * most))
                for i, (q, v) in enumerate(zip(pdf["query_id"], pdf["vector"])):
                    cells = order[i]
                    if held[cells].sum() < enough:
                        cells = model.order(x[i : i + 1], len(held))[0]
                    cells = cells[: max(most, int(np.searchsorted(held[cells].cumsum(), enough)) + 1)]
                    at: dict[int, list[int]] = {}
                    for c in cells[held[cells] > 0].tolist():
                        for b in range(layout.first[c], layout.first[c] + layout.blocks[c]):
                            at.setdefault(b, []).append(c)
                    out += [(b, q, v, cs) for b, cs in at.items()]
                yield pd.DataFrame(out, columns=["block", "query_id", "vector", "cells"])

    return queries.mapInPandas(run, "block int, query_id long, vector binary, cells array<int>")


def _searched(index: DataFrame, asked: DataFrame, model: Quantiser, layout: Layout, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k nearest rows of each block it visits."""
    spark, dim = index.sparkSession, model.dim
    asked = cut(asked)
    chunks = asked.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    of_cell = F.broadcast(spark.createDataFrame([(c, layout.first[c], layout.blocks[c]) for c in layout.first], "cell int, first int, blocks int"))
    asked = asked.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).drop("chunks")
    dealt = index.join(of_cell, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    dealt = dealt.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("block", "chunk", "vec_id", "cell", "codes", "left", "vector")

    def search(block, queries):
        import numpy as np
        import pandas as pd

        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(block) and len(queries):
            block = block.sort_values("vec_id", kind="stable")
            ids, x, cell, left = block["vec_id"].to_numpy(), unpacked(block["vector"], dim), block["cell"].to_numpy(), block["left"].to_numpy()
            codes = np.frombuffer(b"".join(block["codes"]), np.uint8).reshape(len(block), -1)
            places, bias = model.places(codes), model.bias(cell, codes)
            own, local = np.unique(cell, return_inverse=True)
            centres = model.coarse[own]
            for q, v, cells in zip(queries["query_id"], unpacked(queries["vector"], dim), queries["cells"]):
                seen = np.zeros(len(model.coarse), bool)
                seen[np.asarray(cells)] = True
                at = np.flatnonzero(seen[cell] & (ids != q))
                if len(at) > k:
                    least, most = model.distances(v, centres, local[at], places[at], bias[at])
                    bound = np.partition(most + left[at], k - 1)[k - 1]
                    at = at[~(least - left[at] > bound * (1 + ROUNDING))]  # k rows are no farther than bound; what is no number stays
                score = exact_distances(x, v, at)
                best = best_of(score, ids[at], k)
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out)

    return dealt.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(search, "query_id long, vec_id long, score double")


def neighbours(vectors: DataFrame, is_query=None, k: int = 10, reach: float = REACH) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest rows found, by Euclidean distance, ties to the lesser id.

    vectors: vec_id, embedding. is_query: a condition on vec_id, by default ids divisible by 100. Rows without id, and vectors that
    are null, zero, or hold a null or a number that isn't finite, take no part; nor do those of another
    length than most of the sample. A query never meets rows of its own id; rows that repeat an id are rows each, and as queries
    are one if their vectors are equal. A query has fewer than k rows only if there are no more of other ids.
    Tables without usable rows give no rows.
    """
    import numpy as np

    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    few = sampled(usable(vectors), SAMPLE_ROWS, "vec_id", "embedding").toPandas()
    if not len(few):
        return spark.createDataFrame([], empty)
    lengths = few["embedding"].map(len)
    dim = int(lengths.mode()[0])
    few = few[lengths == dim].sort_values("vec_id", kind="stable")
    sample = np.stack(few["embedding"].to_numpy())
    rows = usable(vectors, dim)
    model = trained(rows, sample, rows.count())
    index = cut(candidates(indexed(rows, model), k))
    queries = cut(indexed(rows.where(is_query), model).select(F.col("vec_id").alias("query_id"), "vector").distinct())
    layout = Layout(dict(index.groupBy("cell").count().collect()))
    trial = [(r["query_id"], np.frombuffer(r["vector"], "<f8").tolist()) for r in sampled(queries, TRIAL_QUERIES, "query_id", "vector").collect()]
    if not trial:
        return spark.createDataFrame([], empty)
    most = visits(index, model, trial, k, reach)
    found = cut(_best_rows(_searched(index, _visited(queries, model, layout, most, max(LEAST_ROWS, 2 * k)), model, layout, k), k))
    total, ids = sum(layout.count.values()), found.groupBy("query_id").count()
    lacking = cut(queries.join(ids.where(F.col("count") >= min(k, total)), "query_id", "left_anti"))
    if lacking.limit(1).count():
        again = _best_rows(_searched(index, _visited(lacking, model, layout, len(model.coarse), total), model, layout, k), k)
        found = found.join(lacking.select("query_id"), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
