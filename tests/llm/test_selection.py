"""Small tests of sharding, vector codes and importance resampling: brute force, bounds of packing, and the defined results for odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, resampling, sharding, vectorcodes

EXTRA = "shard string, size string, slot string, __text string, __piece string, row int, bucket string, rank string"


def plain_best_fit(sizes, capacity):
    bins, out = [], []
    for size in sizes:
        at = min((i for i, free in enumerate(bins) if free >= size), key=lambda i: (bins[i], i), default=None)
        if at is None:
            bins.append(capacity)
            at = len(bins) - 1
        bins[at] -= size
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_that_of_a_plain_search(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 60 if seed % 2 else 5) for _ in range(400)), reverse=True)
    assert sharding.best_fit(sizes, 60) == plain_best_fit(sizes, 60)
    used = max(sharding.best_fit(sizes, 60)) + 1
    assert sharding.best_fit(sizes, 60, used) is not None and sharding.best_fit(sizes, 60, used - 1) is None


def test_the_tree_of_free_spaces_stays_low():
    tree, held, rng = sharding.Free(), set(), random.Random(0)
    for i in range(3000):
        tree.add(key := (rng.randrange(500), i))
        held.add(key)
        if i % 3 == 0:
            size = rng.randrange(500)
            want = min((k for k in held if k[0] >= size), default=None)
            assert tree.take(size) == want
            held.discard(want)
    assert tree.root[3] <= 1.45 * math.log2(len(held) + 2)


def test_even_bins():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 1000) for _ in range(2000)), reverse=True)
    loads = np.bincount(sharding.even(sizes, 16), sizes, 16)
    assert loads.max() - loads.min() < 0.01 * loads.mean()
    assert sorted(sharding.even([5, 5, 5], 3)) == [0, 1, 2] and sharding.even([], 4) == [] and sharding.even([9, 1], 1) == [0, 0]


def shards_of(df):
    rows = df.collect()
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["text"] or ""].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, groups


@pytest.fixture()
def documents(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randint(0, 400) + str(i) for i in range(600)] + ["copy" * 20] * 90 + [None, "", "", "é" * 50]
    rows = [(None if i % 97 == 0 else i // 2 if i % 50 == 0 else i, t, "a", "b", "c", "d", "e", i, "f", "g") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA)


def test_shards(documents):
    found = sharding.sharded(documents, 16)
    assert found.columns == ["doc_id", "text", "__text", "__piece", "row", "bucket", "rank", "size", "law", "shard", "slot", "grown_shard"]
    rows, groups = shards_of(found)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(str, ((r["doc_id"], r["text"]) for r in documents.collect())))
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    assert all(len(s) == 1 for s in groups.values())  # equal texts, null and empty too, share a shard
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert sorted(loads) == list(range(16)) and max(loads.values()) < 1.02 * min(loads.values())
    again = {(r["row"], r["shard"]) for r in sharding.sharded(documents.repartition(7), 16).collect()}
    assert again == {(r["row"], r["shard"]) for r in rows}


def test_shards_over_several_levels(documents, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 40)
    monkeypatch.setattr(sharding, "LAST", 64)
    monkeypatch.setattr(sharding, "BUNDLES", 256)
    monkeypatch.setattr(sharding, "FILES", 3)
    rows, groups = shards_of(sharding.sharded(documents, 4))
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert len(rows) == documents.count() and all(len(s) == 1 for s in groups.values()) and max(loads.values()) < 1.1 * min(loads.values())


def test_the_bytes_of_texts_say_how_many_files_are_written(spark, monkeypatch, tmp_path):
    """Each partition of the shuffle wrote a file a shard: on many small partitions thousands of files, each of which starts processes beside an executor."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    docs = [(i, f"text {i % 500} " * (i % 7)) for i in range(900)]
    frame, cores = spark.createDataFrame(docs, "doc_id long, text string"), spark.sparkContext.defaultParallelism
    sizes = sum(len(t) + 1 for _, t in docs)
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for task, tasks in ((sharding.TASK, cores), (sizes // (3 * cores) + 1, 3 * cores)):  # few bytes: a task a core; more: a task for each TASK of them
            monkeypatch.setattr(sharding, "TASK", task)
            folder = tmp_path / str(tasks)
            found = sharding.sharded(frame, 4, folder=str(folder)).collect()
            assert len(list(folder.glob("shard=*/*.parquet"))) <= 4 * tasks
            assert len({p.name for p in folder.glob("shard=*/*.parquet")}) > tasks // 2  # nor does one task write all
            assert sorted((r["doc_id"], r["text"]) for r in found) == docs
            for shard in range(4):
                assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_group_larger_than_a_shard_is_dealt_to_pieces(spark, monkeypatch):
    """A third of the rows is one text, then with repeated ids and more rows than a task numbers."""
    rows = [(i, "t" * (i % 50) + str(i)) for i in range(800)] + [(1000 + i, "hot " * 10) for i in range(400)]
    for docs, hot in ((rows, sharding.HOT), ([(7, "hot " * 10)] * 600 + rows[:300], 300)):
        monkeypatch.setattr(sharding, "HOT", hot)
        got, groups = shards_of(sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string"), 8))
        loads = Counter()
        for r in got:
            loads[r["shard"]] += r["size"]
        assert len(got) == len(docs) and len(groups.pop("hot " * 10)) > 2 and all(len(s) == 1 for s in groups.values())
        assert max(loads.values()) < 1.05 * min(loads.values())
    one = sharding.sharded(spark.createDataFrame([(1, "a" * 5000), (2, "b"), (3, "c")], "doc_id long, text string"), 2).collect()
    assert {r["doc_id"]: r["shard"] for r in one} == {1: 0, 2: 1, 3: 1}


def test_few_shards_of_a_capacity(documents):
    rows = sharding.assigned(documents, capacity=2_000).collect()
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= 2_000 and sorted(loads) == list(range(len(loads)))
    assert len(loads) <= 1.1 * math.ceil(sum(loads.values()) / 2_000) + 1
    alone = sharding.assigned(documents, capacity=100)  # most texts are larger: a shard each
    assert alone.where("size > 100").groupBy("shard").agg(F.count_distinct("text").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        sharding.assigned(documents)


def test_shards_of_no_rows_and_of_few(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.sharded(docs).count() == 0 and sharding.assigned(docs, capacity=5).count() == 0
    got = sharding.sharded(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(None, None, 1, "bytes", 0, 0, None)]


def plain_codes(rows, dim, entries=256, rounds=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    at = [dim * i // 4 for i in range(5)]
    x = [[math.floor(1024 * v) for v in r[1]] for r in rows]
    books = [[v[a:b] for v in x[:entries]] for a, b in zip(at, at[1:])]

    def near(part, book):
        return min((sum((p - c) ** 2 for p, c in zip(part, entry)), i) for i, entry in enumerate(book))

    for _ in range(rounds):
        for k, (a, b) in enumerate(zip(at, at[1:])):
            members = defaultdict(list)
            for v in x:
                members[near(v[a:b], books[k])[1]].append(v[a:b])
            for i, own in members.items():
                books[k][i] = [sum(c) // len(own) for c in zip(*own)]
    out, labels = [], Counter()
    for r, v in zip(rows, x):
        found = [near(v[a:b], books[k]) for k, (a, b) in enumerate(zip(at, at[1:]))]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
        labels[r[2]] += out[-1][3]
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return [(i, code, e, labels[label]) for i, label, code, e in out], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("dim, n, entries", [(8, 300, 20), (7, 120, 256), (16, 400, 256)])
def test_vector_codes(spark, dim, n, entries):
    """Against a plain version: a third of the rows is one vector, labels repeat and lack, ids repeat, lack and are large."""
    rng = np.random.default_rng(dim)
    x = np.round(rng.normal(size=(n, dim)), 3)
    x[::3] = x[0]
    x[5] *= 60  # beyond two bytes
    ids = [None if i % 40 == 7 else 2**60 + i if i % 9 == 1 else i // 2 for i in range(n)]
    rows = [(ids[i], x[i].tolist(), None if i % 5 == 0 else i % 3) for i in range(n)]
    odd = [(1, None, 1), (2, [1.0, None] + [0.0] * (dim - 2), 1), (3, [float("nan")] * dim, 1), (4, [float("inf")] * dim, 2), (5, [1.0], 2)]
    schema = "vec_id long, embedding array<double>, label int, code string, error string, part int, position int, weight int"
    vectors = spark.createDataFrame([(*r, "c", "e", 1, 2, 3) for r in rows + odd], schema)
    found, books = vectorcodes.compressed(vectors, entries=entries)
    want, digest = plain_codes(rows, dim, entries)
    got = [tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and vectorcodes.digest(books) == digest


def test_vector_codes_of_hot_parts_and_many_labels(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, ([0.5] * 8 if i % 3 else rng.normal(size=8).round(3).tolist()), i % 40) for i in range(300)]
    want, _ = plain_codes(rows, 8)
    monkeypatch.setattr(vectorcodes, "HOT", 30)
    monkeypatch.setattr(vectorcodes, "FEW", 5)
    found, _ = vectorcodes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()) == sorted(want)


def test_vector_codes_of_no_rows_and_of_far_ones(spark):
    schema = "vec_id long, embedding array<float>, label int"
    found, books = vectorcodes.compressed(spark.createDataFrame([(1, None, 1)], schema))
    assert found.count() == 0 and books == []
    far = spark.createDataFrame([(1, [1e30] * 4, 1), (2, [-1e30] * 4, 1), (3, [0.0] * 4, None)], schema)
    found, books = vectorcodes.compressed(far, entries=1, rounds=0)
    assert [tuple(r) for r in found.orderBy("vec_id").select("vec_id", "code", "error").collect()] == [(1, "00000000", 0), (2, "00000000", 4 * (2 * vectorcodes.FAR) ** 2), (3, "00000000", 4 * vectorcodes.FAR**2)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_draw(docs, target, run=1, buckets=10_000, percent=10, least=20):
    lower = str.maketrans(resampling.UPPER, resampling.LOWER)

    def features(text):
        words = WORD.findall((text or "").translate(lower))
        runs = [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in runs]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(itertools.chain(*[f for _, _, f in own])), Counter(itertools.chain(*[features(x)[1] for x in target]))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def draws(spark):
    rng, words = random.Random(0), "alpha BETA gamma delta épée 12 x9 don't semi;colon naïve 漢字 zulu".split()
    text = lambda n: rng.choice([" ", "\n", "\x00 "]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(200)] + [(300, None), (301, ""), (302, " .,; "), (None, text(40)), (2**60 + 1, text(30)), (303, text(5_000))]
    docs += [(304, "same " * 25)] * 40  # repeated rows
    frame = spark.createDataFrame([(*d, "a", "b", "c", "d", "e", 1, "f", "g") for d in docs], "doc_id long, text string, " + EXTRA).repartition(5)
    return docs, frame


@pytest.mark.parametrize("run, buckets, cut", [(1, 10_000, 2_000_000), (3, 50, 300)])
def test_resampling(spark, monkeypatch, run, buckets, cut):
    docs, frame = draws(spark)
    aim = ["zulu alpha beta", None, "gamma gamma épée", ""]
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(aim)], "item_id long, text string, doc_id int")
    slices = resampling.slices
    monkeypatch.setattr(resampling, "slices", lambda lengths: slices(lengths, cut))
    got = [tuple(r) for r in resampling.resampled(frame, target, run=run, buckets=buckets).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_draw(docs, aim, run, buckets)))


def test_resampling_of_no_rows_and_the_drawn_documents(spark):
    docs, frame = draws(spark)
    target = spark.createDataFrame([(1, "zulu zulu")], "item_id long, text string")
    assert resampling.resampled(frame.where("false"), target).count() == 0
    got = resampling.resampled(frame, target.where("false")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_draw(docs, [])))
    kept = resampling.drawn(frame, target, percent=50)
    assert kept.columns == frame.columns
    ids = {r[0] for r in plain_draw(docs, ["zulu zulu"], percent=50) if r[4] is not None and r[0] is not None}
    assert {r["doc_id"] for r in kept.collect()} == ids


def test_slices():
    assert list(resampling.slices([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(resampling.slices([], 6)) == [] and list(resampling.slices([99], 6)) == [(0, 1)]


def test_sharding_query_over_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode()) for r in rows)
