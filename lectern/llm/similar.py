"""Groups of documents that share most of their shingles: SimHash groups, MinHash keys for the rest, exact check by sets, connected components.

Two texts are alike if the Jaccard likeness of their sets of distinct five-word shingles is 0.8 at least. First comes op3's method: SimHash
fingerprints, the index over byte positions, the tally of meetings, and differing bits (llm/simhash.py). Each of its groups is a posting here, so it
finds every pair within two bits whole and the exact check follows. At 0.8 some ten of 64 bits differ and no byte need be shared, so the looser pairs
have an index of their own, keyed by bands of MinHash values. Whether a pair meets in one of them depends on its likeness alone, never on the number
of documents. How many bands there are follows from the share of pairs at the least likeness that may fail to meet.
Every row of a posting is verified against its least node, each row's set going once to that node's set. Links make components. In a posting that
still holds several, only rows outside its largest component have anything to gain: they meet all rows of the posting, in blocks of bounded
size within tasks, so a posting of many near copies and a few strangers costs the strangers times the copies and not the copies' square. Postings
of all lengths go this one way. What blocks find are links between components, which are joined in a second, small graph.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.common import cut, small_batches, unused
from lectern.llm.components import connected_components

WORDS, LIKENESS = 5, 0.8
#: MinHash values of a band, and the share of lone pairs at the least likeness that may meet in no band.
ROWS, MISSED = 6, 0.001
#: Rows of a block of a posting, and rows that are verified against one node in one task, about.
BLOCK, FAN = 512, 4_096


def bands_of(likeness: float, missed: float = MISSED) -> int:
    """The number of bands in which all but missed of the pairs at likeness meet at least once."""
    return 1 if likeness >= 1 else math.ceil(math.log(missed) / math.log1p(-(likeness**ROWS)))


def shingles_of(text: str | None, words: int):
    """The hashes of a text's distinct word shingles, ascending; A-Z count as lower case."""
    import numpy as np
    import xxhash

    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n, shingles = max(1, len(found) - words + 1), None
    for i in range(min(words, len(found))):
        part = _mixed(h[i : i + n] + np.uint64(i + 1))
        shingles = part if shingles is None else _mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + part)
    return np.unique(shingles)


def band_keys(shingles, bands: int):
    """A key for each band: its number and its least values, mixed. No shingles: no keys."""
    import numpy as np

    if not len(shingles):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(0)
    factors, shifts = (rng.integers(0, 2**64, (bands * ROWS, 1), np.uint64) for _ in range(2))
    least = np.full(bands * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1 << 10):
        np.minimum(least, (shingles[None, at : at + (1 << 10)] * (factors | np.uint64(1)) + shifts).min(axis=1), out=least)
    keys = np.arange(bands, dtype=np.uint64)
    for values in least.reshape(bands, ROWS).T:
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values)
    return keys.view(np.int64)


def _mixed(x):
    import numpy as np

    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _set_hash(shingles) -> int:
    """Equal for equal sets of shingles."""
    import xxhash

    n = xxhash.xxh64_intdigest(shingles.tobytes())
    return n - 2**64 if n >= 2**63 else n


def indexed(docs: DataFrame, words: int = WORDS, likeness: float = LIKENESS) -> DataFrame:
    """(doc_id, same, size, fp, keys) of every row: same is a hash of its set of shingles, size their number, fp the SimHash of all its shingles."""
    bands = bands_of(likeness)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            sets = [shingles_of(t, words) for t in pdf["text"]]
            prints = [simhash.fingerprint_of(t, words) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "same": [_set_hash(s) for s in sets], "size": [len(s) for s in sets], "fp": prints, "keys": [band_keys(s, bands) for s in sets]})

    # doc_id passes as text: beside a null, a large whole number would lose digits.
    rows = docs.select(docs["doc_id"].cast("long").cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id string, same long, size long, fp long, keys array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def _sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of nodes (node, least, same), from the text of a document that each stands for."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            sets = [shingles_of(t, words) for t in pdf["text"]]
            kept = [i for i, (s, same) in enumerate(zip(sets, pdf["same"])) if _set_hash(s) == same]
            yield pd.DataFrame({"node": pdf["node"].iloc[kept], "shingles": [sets[i].view("int64") for i in kept]})

    texts = docs.select(docs["doc_id"].cast("long").alias("least"), docs["text"].cast("string").alias("text"))
    rows = texts.join(nodes.select("node", "least", "same"), "least").select("node", "same", "text")
    return rows.mapInPandas(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs (head, node) whose sets of shingles are alike.

    A node's set goes to its head, FAN nodes to a task; the head's goes once to each of these tasks.
    """
    parts_ = F.broadcast(pairs.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > FAN).select("head", F.ceil(F.col("n") / FAN).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    rows = pairs.join(parts_, "head", "left").select("head", part, "node")
    rows = rows.join(sets, "node").select("head", "part", "node", F.col("shingles").alias("a"))
    heads = pairs.select("head").distinct().join(sets.withColumnRenamed("node", "head"), "head").join(parts_, "head", "left")
    heads = heads.select("head", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("shingles").alias("b"))
    a, b, common = F.size("a"), F.size("b"), F.size(F.array_intersect("a", "b"))
    may_be = F.least(a, b) >= likeness * F.greatest(a, b)
    alike = F.when(may_be, common / (a + b - common) >= likeness)
    return rows.join(heads, ["head", "part"]).where(alike).select("head", "node")


def _across(mixed: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Links (src, dst) of components that join all alike rows of each key's posting, by exact likeness.

    mixed: key, node, component, other (whether the row is outside its posting's largest component), n and others (their numbers). Blocks of others
    meet blocks of all rows, so no task holds more than two blocks; each gives at most a spanning forest of its components.
    """

    def run(pdf):
        import numpy as np
        import pandas as pd

        few, many = pdf[pdf["few"]], pdf[~pdf["few"]]
        out = []
        if len(few) and len(many):
            sizes, many_sizes = few["shingles"].map(len).to_numpy(), many["shingles"].map(len).to_numpy()
            known, column = np.unique(np.concatenate(few["shingles"].to_list()), return_inverse=True)
            own = np.repeat(np.arange(len(few)), sizes)
            stored = np.concatenate(many["shingles"].to_list())
            at = np.minimum(np.searchsorted(known, stored), max(0, len(known) - 1))
            held = known[at] == stored if len(known) else np.zeros(len(stored), bool)
            row, at = np.repeat(np.arange(len(many)), many_sizes)[held], at[held]
            order, order_many = np.argsort(column, kind="stable"), np.argsort(at, kind="stable")
            own, column, row, at = own[order], column[order], row[order_many], at[order_many]
            common = np.zeros((len(few), len(many)), np.float32)
            for begin in range(0, len(known), 2048):
                ends = [begin, begin + 2048]
                left, right = np.zeros((len(few), 2048), np.float32), np.zeros((len(many), 2048), np.float32)
                a, b = np.searchsorted(column, ends)
                left[own[a:b], column[a:b] - begin] = 1
                a, b = np.searchsorted(at, ends)
                right[row[a:b], at[a:b] - begin] = 1
                common += left @ right.T
            alike = common / (sizes[:, None] + many_sizes[None, :] - common.astype(float)) >= likeness
            mine, theirs = few["component"].to_numpy(), many["component"].to_numpy()
            i, j = np.nonzero(alike & (mine[:, None] != theirs[None, :]))
            root: dict = {}

            def top(c):
                while root.setdefault(c, c) != c:
                    root[c] = c = root[root[c]]
                return c

            for a, b in sorted({(min(a, b), max(a, b)) for a, b in zip(mine[i].tolist(), theirs[j].tolist())}):
                x, y = top(a), top(b)
                if x != y:
                    root[y] = x
                    out.append((a, b))
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node", "key"), blocks(n)).cast("int")
    few = mixed.where("other").select("key", "node", "component", F.lit(True).alias("few"), mine("others").alias("i"), every("n").alias("j"))
    many = mixed.select("key", "node", "component", F.lit(False).alias("few"), every("others").alias("i"), mine("n").alias("j"))
    dealt = few.unionByName(many).join(sets, "node")
    return dealt.groupBy("key", "i", "j").applyInPandas(run, "src long, dst long")


def simhash_postings(prints: DataFrame) -> DataFrame:
    """(key, node) of prints (node, fp): one key for each group of fingerprints that links of SimHash join, equal ones included."""
    distinct = cut(prints.select("fp").distinct())
    of = cut(connected_components(simhash.links(distinct))).withColumnRenamed("node", "fp")
    group = F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp"))
    return prints.join(of, "fp", "left").select(group.alias("key"), "node").distinct()


def links(nodes: DataFrame, prints: DataFrame, docs: DataFrame, words: int = WORDS, likeness: float = LIKENESS) -> DataFrame:
    """(node, component) of the nodes that links join: components are those of all alike pairs that meet in a posting.

    nodes: node, least (a document it stands for), same, size, keys; no two have one set of shingles. prints: node, fp (a set has several
    if its shingles repeat in different numbers). Every pair of a posting, a group of SimHash or a key of MinHash, is verified unless other links already join it.
    """
    index = simhash_postings(prints).unionByName(nodes.select(F.explode("keys").alias("key"), "node"))
    postings = index.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
    listed = cut(index.join(postings.select("key", "head"), "key"))
    pairs = cut(listed.where("node <> head").select("head", "node").distinct())
    named = pairs.select(F.explode(F.array("head", "node")).alias("node")).distinct()
    sets = cut(_sets(nodes.join(named, "node"), docs, words))
    of = cut(connected_components(_verified(pairs, sets, likeness), "head", "node"))

    rows = listed.select("key", "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts_ = cut(rows.groupBy("key", "component").agg(F.count("*").alias("m")))
    ends = parts_.groupBy("key").agg(F.max(F.struct("m", "component"))["component"].alias("largest"), F.sum("m").alias("n"), F.max("m").alias("m"))
    several = ends.where("n > m").select("key", "largest", "n", (F.col("n") - F.col("m")).alias("others"))
    mixed = cut(rows.join(several, "key").withColumn("other", F.col("component") != F.col("largest")).drop("largest"))
    joined = connected_components(cut(_across(mixed, sets, likeness).distinct()))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    every = of.unionByName(joined.select(F.col("component").alias("node"), "component")).distinct()
    return every.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))


def grouped(docs: DataFrame, words: int = WORDS, likeness: float = LIKENESS) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id; component_id is the least doc_id that links reach.

    Equal sets of shingles are one node, so copies cost no pair. A document of fewer than five words has one shingle; those
    without words, null texts included, are alike. Rows that repeat a doc_id are grouped each by its own text.
    """
    docs = small_batches(docs).where(docs["doc_id"].isNotNull())
    rows = cut(indexed(docs, words, likeness).withColumn("row", F.monotonically_increasing_id()))
    found = rows.groupBy("same", "size").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    nodes = cut(found.join(rows.select(F.col("row").alias("node"), "keys"), "node"))
    prints = rows.select("same", "size", "fp").distinct().join(found.select("same", "size", "node"), ["same", "size"]).select("node", "fp")
    of = nodes.select("node", "same", "size", "least").join(links(nodes, cut(prints), docs, words, likeness), "node", "left")
    of = cut(of.withColumn("component", F.coalesce("component", "node")))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(of.join(least, "component").select("same", "size", "component_id"))
    return rows.join(named, ["same", "size"]).select("doc_id", "component_id")


def deduplicated(docs: DataFrame, words: int = WORDS, likeness: float = LIKENESS) -> DataFrame:
    """docs (all columns) with one document of each group: that with the least doc_id.

    Of rows that repeat that doc_id one is kept. Rows without doc_id are kept, as no decision can name them.
    """
    name = unused(docs, "__kept")
    kept = grouped(docs, words, likeness).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    named = docs.where(docs["doc_id"].isNotNull()).join(kept, docs["doc_id"].cast("long") == F.col(name), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(docs["doc_id"].isNull()))
