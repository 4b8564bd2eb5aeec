"""Quality by ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed features of the text gives a score; ordered thresholds cut it into grades:
P(grade > k) = sigmoid(score - threshold k). From that come the expected grade and the probability of the top grade, by
which documents are selected. Grades: 0 poor, 1 good but toxic, 2 good.
Features are present or not: the text's words, and coarse classes of what marks junk (runs of punctuation by how frequent
they are, shares of capitals, digits and repeated lines, length).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lectern.llm.common import sampled, small_batches, unused

#: Rated documents that the model is fitted on, about, and its hashed features.
SAMPLE_DOCS, SPACE = 8192, 1 << 18
GRADES = 3
WORDS, MARKS, LINES = re.compile(r"[^\W\d_]+"), re.compile(r"[^\w\s]+"), re.compile(r"[^\n]+")


def grade_of(quality: Column, toxic: Column) -> Column:
    """The rating of a label row; null without a quality."""
    return F.when(quality == 0, 0).when((quality > 0) & (F.coalesce(toxic, F.lit(0)) > 0), 1).when(quality > 0, 2)


def features(text: str):
    """The hashed features of a whole text, each once, as sorted numbers under SPACE."""
    import math
    from collections import Counter

    import numpy as np
    import xxhash

    found, marks, lines = WORDS.findall(text), Counter(MARKS.findall(text)), LINES.findall(text)
    n, level = max(1, len(found)), lambda x: min(9, int(math.log2(1 + 512 * x)))
    seen = {w.lower() for w in found}
    seen |= {f"\0mark {m[:8]} {level(c / n)}" for m, c in marks.items()}
    seen |= {
        f"\0capitals {level(sum(w.isupper() for w in found) / n)}",
        f"\0marks {level(sum(marks.values()) / n)}",
        f"\0repeats {level(1 - len(set(lines)) / max(1, len(lines)))}",
        f"\0digits {level(sum(map(str.isdigit, text)) / max(1, len(text)))}",
        f"\0length {len(found).bit_length()}",
    }
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(x) for x in seen), np.int64, len(seen)) & (SPACE - 1))


class Ordinal:
    """A fitted model: weights over SPACE and GRADES - 1 ordered thresholds."""

    def __init__(self, weights, thresholds) -> None:
        self.weights, self.thresholds = weights, thresholds

    def judge(self, text: str) -> tuple[float, float]:
        """(expected grade, probability of the top grade)."""
        import numpy as np

        score = float(self.weights[features(text)].sum())
        above = 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))
        return float(above.sum()), float(above[-1])


def fit(rows: list, grades: list[int], rounds: int = 12, rate: float = 0.15, ridge: float = 2e-3, least: int = 3) -> Ordinal | None:
    """Fits by adaptive gradient steps; rows: arrays of features. None without rows. Features of fewer than least rows weigh nothing."""
    import numpy as np

    if not rows:
        return None
    there, used = np.bincount(np.concatenate(rows), minlength=SPACE) >= least, np.full(SPACE, -1)
    used[there] = np.arange(there.sum())
    rows = [r[r >= 0] for r in (used[x] for x in rows)]
    y, rng, size = np.array(grades), np.random.default_rng(0), int(there.sum())
    w, seen = np.zeros(size), np.full(size, 1e-6)
    share = np.clip(np.cumsum(np.bincount(y, minlength=GRADES))[:-1] / len(y), 0.01, 0.99)
    cuts = np.log(share / (1 - share)) + np.arange(GRADES - 1) * 1e-3
    cut_seen, sigmoid = np.full(GRADES - 1, 1e-6), lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            lengths, flat = [len(rows[i]) for i in part], np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), lengths)
            score = np.bincount(owner, w[flat], len(part))
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            low, high = sigmoid(edges[y[part]] - score), sigmoid(edges[y[part] + 1] - score)
            by_score = low + high - 1  # of the log-likelihood
            g = np.bincount(flat, by_score[owner], size) / len(part) - ridge * w
            seen += g * g
            w += rate * g / np.sqrt(seen)
            width = np.maximum(high - low, 1e-12)
            by_cut = np.array([((y[part] == k) * high * (1 - high) / width - (y[part] == k + 1) * low * (1 - low) / width).sum() for k in range(GRADES - 1)]) / len(part)
            cut_seen += by_cut * by_cut
            cuts = np.maximum.accumulate(cuts + rate * by_cut / np.sqrt(cut_seen))
    weights = np.zeros(SPACE)
    weights[there] = w
    return Ordinal(weights, cuts)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Ordinal | None:
    """The model of about sample rated documents, taken by a hash; their features, not their texts, come to the driver.

    Label rows without quality are left out; of rows that repeat a doc_id, and of documents that do, each counts.
    """
    rated = labels.select(labels["doc_id"].cast("long").alias("__rated"), grade_of(F.col("quality"), F.col("toxic")).alias("__grade")).where("__grade is not null and __rated is not null")
    few = sampled(rated, sample, "__rated", "__grade")

    @pandas_udf("array<int>")
    def hashed(texts):
        import pandas as pd

        return pd.Series([features(t or "").astype("int32") for t in texts])

    texts = small_batches(docs).select(docs["doc_id"].cast("long").alias("__doc"), docs["text"].alias("__text"))
    got = texts.join(F.broadcast(few), F.col("__doc") == F.col("__rated")).select("__rated", "__grade", hashed("__text").alias("features"))
    got = got.orderBy(F.xxhash64("__rated"), "__rated", "__grade", "features").limit(4 * sample).toPandas()  # more only if ids repeat
    got = got.sort_values(["__rated", "__grade"], kind="stable")
    return fit(got["features"].tolist(), got["__grade"].tolist())


def judge_udf(model: Ordinal | None):
    @pandas_udf("struct<expected_grade double, tail_probability double>")
    def judge(texts):
        import pandas as pd

        rows = [model.judge(t or "") if model else (None, None) for t in texts]
        return pd.DataFrame(rows, columns=["expected_grade", "tail_probability"], dtype="float64")

    return judge


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability and keep of every row: whether it is of the top grade with the given probability.

    A null text is judged as an empty one. Without any rating all is kept and the numbers are null. Rows that repeat a
    doc_id, or have none, are judged each for itself. An empty table gives no rows.
    """
    said = docs.select(docs["doc_id"].cast("long").alias("doc_id"), judge_udf(trained(docs, labels))(docs["text"]).alias("said"))
    return said.select("doc_id", "said.*").withColumn("keep", F.coalesce(F.col("tail_probability") >= least, F.lit(True)))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs (all columns) that the classifier keeps."""
    judge, said = judge_udf(trained(docs, labels)), unused(docs, "__said")
    return docs.withColumn(said, judge(docs["text"])).where(F.coalesce(F.col(said)["tail_probability"] >= least, F.lit(True))).drop(said)
