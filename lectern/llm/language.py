"""Language identification with unigram piece models, summed over all segmentations.

The pieces are a fixed public vocabulary's. For each language the pieces' probabilities are learned by expectation
maximisation on the words of a bounded sample of documents. A forward pass over a word sums the probabilities of all
ways to cut it into pieces, so no single segmentation has to be right. A text's score is the product over its words,
runs of letters in lower case; all else is alike in every language and left out. Runs longer than LONGEST, as in scripts without
spaces, are summed whole too, one at a time and in logarithms.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lectern.llm.common import cut, parts, small_batches, unused
from lectern.llm.tokens import in_chunks

#: Documents of each language that the models are fitted on, about; rounds of fitting; what each piece has in advance.
SAMPLE_DOCS, ROUNDS, SMOOTHING = 1500, 4, 0.05
#: Words of up to so many letters are summed many at a time, in plain probabilities, which double precision holds.
LONGEST = 24
#: Words that a worker remembers.
REMEMBERED = 400_000
#: Runs of what may be letters; numbers such as fractions and Roman numerals are among them and are taken out afterwards.
ALNUM = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: The logarithm of the odds for its letters alone beyond which a text is in no learned language; a few letters don't decide.
DOUBT = 10.0


class Pieces:
    """The vocabulary's pieces by their text, and the lattice of a list of words."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.size, self.other = sp.get_piece_size(), sp.unk_id()
        # Every beginning of a piece is listed too, with -1 if it is none itself, so a search ends where no piece goes on.
        self.steps = dict.fromkeys((p[:i] for p in self.ids for i in range(1, len(p))), -1) | self.ids

    def lattice(self, words: list[str]):
        """(word, start, end, piece) of every piece in every word, as arrays, in order of end and word; a letter that is no piece is the unknown one."""
        import numpy as np

        step, other, count = self.steps.get, self.other, []
        out: list[int] = []
        add = out.extend
        for word in words:
            before = len(out)
            for start in range(len(word)):
                piece = step(word[start], -1)
                add((start, start + 1, other if piece < 0 else piece))
                for end in range(start + 2, len(word) + 1):
                    piece = step(word[start:end])
                    if piece is None:
                        break
                    if piece >= 0:
                        add((start, end, piece))
            count.append((len(out) - before) // 3)
        start, end, piece = np.array(out, np.int32).reshape(-1, 3).T
        order = np.argsort(end, kind="stable")
        return np.repeat(np.arange(len(words), dtype=np.int32), count)[order], start[order], end[order], piece[order]

    @staticmethod
    def _summed(w, values):
        """(words, sums of their rows), for rows in order of word."""
        import numpy as np

        first = np.append(0, np.flatnonzero(np.diff(w)) + 1)
        return w[first], np.add.reduceat(values, first, axis=0)

    def forward(self, words: list[str], edges, probabilities):
        """alpha[word, position, language]: the probability of all segmentations up to there."""
        import numpy as np

        alpha = np.zeros((len(words), LONGEST + 2, probabilities.shape[1]))
        alpha[:, 0] = 1
        w, start, end, piece = edges
        bounds = np.searchsorted(end, np.arange(LONGEST + 3))
        for e in range(1, LONGEST + 2):
            part = slice(bounds[e], bounds[e + 1])
            if part.start < part.stop:
                at, sums = self._summed(w[part], alpha[w[part], start[part]] * probabilities[piece[part]])
                alpha[at, e] = sums
        return alpha

    def backward(self, words: list[str], edges, probabilities):
        import numpy as np

        beta = np.zeros((len(words), LONGEST + 2, probabilities.shape[1]))
        beta[np.arange(len(words)), [len(w) for w in words]] = 1
        order = np.lexsort((edges[0], -edges[1]))
        w, start, end, piece = (x[order] for x in edges)
        bounds = np.searchsorted(-start, np.arange(-LONGEST - 1, 2))
        for k, s in enumerate(range(LONGEST + 1, -1, -1)):
            part = slice(bounds[k], bounds[k + 1])
            if part.start < part.stop:
                at, sums = self._summed(w[part], beta[w[part], end[part]] * probabilities[piece[part]])
                beta[at, s] += sums
        return beta


    def long(self, word: str, logs):
        """(edges as arrays start, end, piece; log alpha; log beta) of one word of any length; logs: log probabilities."""
        import numpy as np

        _, start, end, piece = self.lattice([word])
        n, k = len(word), logs.shape[1]
        alpha, beta = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        alpha[0] = beta[n] = 0
        weight, bounds = logs[piece], np.searchsorted(end, np.arange(n + 2))
        for e in range(1, n + 1):
            part = slice(bounds[e], bounds[e + 1])
            alpha[e] = np.logaddexp.reduce(alpha[start[part]] + weight[part], axis=0)
        order = np.argsort(start, kind="stable")
        bounds = np.searchsorted(start[order], np.arange(n + 1))
        for s in range(n - 1, -1, -1):
            part = order[bounds[s] : bounds[s + 1]]
            beta[s] = np.logaddexp.reduce(beta[end[part]] + weight[part], axis=0)
        return (start, end, piece), alpha, beta

    def scores(self, words: list[str], probabilities):
        """log probability[word, language] of words, each with the mark that begins a word, over all their segmentations."""
        import numpy as np

        out = np.zeros((len(words), probabilities.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST + 1]
        some = [words[i] for i in short]
        alpha = self.forward(some, self.lattice(some), probabilities)
        out[short] = np.log(np.maximum(alpha[np.arange(len(some)), [len(w) for w in some]], 1e-300))
        if len(short) < len(words):
            logs = np.log(probabilities)
            for i, w in enumerate(words):
                if len(w) > LONGEST + 1:
                    out[i] = self.long(w, logs)[1][-1]
        return out

    def expected(self, words: list[str], n, probabilities):
        """How often each piece is used in words that occur n[word, language] times, over all segmentations: [piece, language]."""
        import numpy as np

        total = np.zeros_like(probabilities)
        short = np.array([len(w) <= LONGEST for w in words], bool)
        some = ["▁" + w for w, s in zip(words, short) if s]
        edges = self.lattice(some)
        alpha, beta = self.forward(some, edges, probabilities), self.backward(some, edges, probabilities)
        w, start, end, piece = edges
        weight = n[short] / np.maximum(beta[:, 0], 1e-300)
        share = alpha[w, start] * probabilities[piece] * beta[w, end] * weight[w]
        for k in range(n.shape[1]):
            total[:, k] += np.bincount(piece, share[:, k], self.size)
        logs = np.log(probabilities)
        for i in np.flatnonzero(~short):
            (start, end, piece), alpha, beta = self.long("▁" + words[i], logs)
            np.add.at(total, piece, np.exp(alpha[start] + logs[piece] + beta[end] - alpha[-1]) * n[i])
        return total


def cut_words(text: str) -> list[str]:
    """Runs of letters (Unicode category L) in lower case."""
    found = ALNUM.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def fitted(pieces: int, model_file: str, counted: DataFrame, languages: int):
    """probabilities[piece, language] from words and their counts (word, n0, n1, ...).

    Each round's expectations are taken where the words are and added up by Spark; a row for each piece comes back.
    """
    import numpy as np

    names, probabilities = [f"n{i}" for i in range(languages)], np.full((pieces, languages), 1 / pieces)

    def expect(batches: Iterator, p) -> Iterator:
        import pandas as pd

        total, own = np.zeros_like(p), _pieces(model_file)
        for pdf in batches:
            total += own.expected(pdf["word"].tolist(), pdf[names].to_numpy("float64"), p)
        used = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"piece": used} | {c: total[used, i] for i, c in enumerate(names)})

    for _ in range(ROUNDS):
        now = probabilities
        each = counted.mapInPandas(lambda batches: expect(batches, now), "piece long, " + ", ".join(f"{c} double" for c in names))  # noqa: B023
        got = each.groupBy("piece").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        total = np.full_like(probabilities, SMOOTHING)
        total[got["piece"].to_numpy("int64")] += got[names].to_numpy("float64")
        probabilities = total / total.sum(axis=0)
    return probabilities


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def learned(docs: DataFrame, model_file: str, sample: int = SAMPLE_DOCS):
    """(languages, probabilities, background) from text and lang of the documents that aren't held out.

    About sample documents of each language are taken, by a hash of doc_id, their words counted and the models fitted by Spark;
    only the pieces' expected counts come to the driver.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(docs["doc_id"]))
    there = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, steps = sorted(there), 1 << 20
    if not languages:
        return [], None, {}
    keep = F.coalesce(*[F.when(F.col("lang") == l, F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < int(steps * min(1.0, sample / n)) + 1) for l, n in there.items()])

    @pandas_udf("array<string>")
    def words(texts):
        import pandas as pd

        return pd.Series([cut_words(t) for t in texts])

    each = usable.where(keep).select("lang", F.explode(words("text")).alias("word"))
    counted = each.groupBy("word").agg(*[F.count_if(F.col("lang") == l).cast("double").alias(f"n{i}") for i, l in enumerate(languages)])
    # A task sees its words in one order in every run, so that sums are the same.
    counted = cut(counted.repartition(parts(docs), "word").sortWithinPartitions("word"))
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=model_file).get_piece_size()
    return languages, fitted(size, model_file, counted, len(languages)), background(counted, len(languages))


def background(counted: DataFrame, languages: int) -> dict[str, float]:
    """Logarithms of the letters' shares in all learning words (word, n0, n1, ...); a word's end counts as one.

    A letter that isn't among them ('') counts as an average one, so that a text in other letters is in no learned language.
    """
    import math

    n = sum((F.col(f"n{i}") for i in range(languages)), F.lit(0.0))
    each = counted.select(F.explode(F.split(F.concat(F.lit(" "), "word"), "")).alias("letter"), n.alias("n")).where("letter <> ''")
    held = {r["letter"]: r["n"] for r in each.groupBy("letter").agg(F.sum("n").alias("n")).collect()}
    total = sum(held.values())
    return {c: math.log(n / total) for c, n in held.items()} | {"": -math.log(max(1, len(held)))}


_known_pieces: dict[str, Pieces] = {}


def _pieces(model_file: str) -> Pieces:
    """One for each process and vocabulary."""
    if model_file not in _known_pieces:
        _known_pieces[model_file] = Pieces(model_file)
    return _known_pieces[model_file]


_memory: dict = {}


def identify_udf(languages: list[str], probabilities, letters: dict[str, float], model_file: str):
    """lang_pred, score and own of a text. null or without letters: und, 0, false. Ties go to the first language.

    own: whether the language explains the text as well as its letters alone do, by their shares in all learning words, or worse by DOUBT at
    most. Texts in no learned language fall apart into pieces that are rare there, which makes them less likely than that.
    """
    spark_like = (languages, probabilities)
    key = hash((tuple(languages), None if probabilities is None else probabilities.tobytes()))

    @pandas_udf("struct<lang_pred string, score double, own boolean>")
    def identify(texts):
        import numpy as np
        import pandas as pd

        names, probs = spark_like
        if key not in _memory:
            _memory.clear()
            _memory[key] = (_pieces(model_file) if names else None, {}, np.zeros((1024, 1 + max(1, len(names)))))
        pieces, known, table = _memory[key]
        out: list[tuple[str, float, bool]] = []
        letter, rare, end = letters.get, letters.get(""), letters.get(" ", letters.get(""))
        gc.disable()  # many small objects and no cycles: the collector would only cost
        try:
            whole = [t or "" for t in texts] if names else [""] * len(texts)
            for a, b in in_chunks(whole):
                cut = [cut_words(t) for t in whole[a:b]]
                missing = list(set().union(*cut).difference(known))
                if len(known) + len(missing) > REMEMBERED:
                    known.clear()
                    missing = list(set().union(*cut))
                for i in range(0, len(missing), 20_000):
                    part = ["▁" + w for w in missing[i : i + 20_000]]
                    scores = pieces.scores(part, probs)
                    begin = len(known)
                    while begin + len(part) > len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[begin : begin + len(part), :-1] = scores
                    table[begin : begin + len(part), -1] = [end + sum([letter(c, rare) for c in w]) for w in missing[i : i + 20_000]]
                    known.update(zip(missing[i : i + 20_000], range(begin, begin + len(part))))
                    _memory[key] = (pieces, known, table)
                for found in cut:
                    if not found:
                        out.append((UNKNOWN, 0.0, False))
                        continue
                    *total, alone = table[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].sum(axis=0)
                    total = np.array(total)
                    odds = np.exp(total - total.max())
                    out.append((names[int(total.argmax())], float(odds.max() / odds.sum()), bool(total.max() >= alone - DOUBT)))
        finally:
            gc.enable()
        return pd.DataFrame(out, columns=["lang_pred", "score", "own"])

    return identify


def predicted(docs: DataFrame, model_file: str, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Nothing but the text goes into a prediction. Without any document to learn from all is und. Rows that repeat a
    doc_id are predicted each for itself; a row without one is not held out, and not learned from. An empty table
    gives no rows.
    """
    identify = identify_udf(*learned(small_batches(learn_from or docs), model_file), model_file)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), identify(docs["text"]).alias("said"))
    return rows.select("doc_id", "held_out", "said.lang_pred", "said.score")


def accepted(docs: DataFrame, model_file: str, learn_from: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """docs (all columns) in a learned language, known with at least the given probability; und goes, and so does what is in none of them."""
    identify = identify_udf(*learned(small_batches(learn_from or docs), model_file), model_file)
    said = unused(docs, "__said")
    return docs.withColumn(said, identify(docs["text"])).where((F.col(said)["lang_pred"] != UNKNOWN) & (F.col(said)["score"] >= least) & F.col(said)["own"]).drop(said)
