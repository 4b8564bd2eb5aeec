"""Streams of transcripts: the source and its restarts, the order of segments, candidates, messages, and what consumers read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus, metrics
from lectern.sources import transcripts
from lectern.streaming import answers, console, segments, session


def put(folder, name, rows, mode="a"):
    folder.mkdir(exist_ok=True)
    with open(folder / f"{name}.json", mode) as f:
        for s, seq, text, final, sec in rows:
            f.write(json.dumps({"session": s, "seq": seq, "text": text, "is_final": final, "lang": "en", "t_client": f"2024-01-01T{sec // 3600:02}:{sec // 60 % 60:02}:{sec % 60:02}Z"}, ensure_ascii=False) + "\n")


@pytest.mark.parametrize("length", [40, 1 << 20])
def test_source_over_restarts(spark, tmp_path, length):
    """Lines that are appended, a line that isn't whole yet, new files, ranges that cut lines: nothing is lost or doubled."""
    source, seen = tmp_path / "in", []
    stream = transcripts.read_transcripts(spark, str(source), length=length)
    for step in range(3):
        for name in ("a", "b", "c")[: step + 1]:
            new = [(ord(name), 10 * step + i, "말씀 " * (i % 4), i % 2 == 0, step * 20 + i) for i in range(7)]
            put(source, name, new)
            seen += [(r[0], r[1], r[2], r[3]) for r in new]
        with open(source / "a.json", "a") as f:
            f.write('{"session": 1, ') if step == 1 else None
            f.write("") if step != 2 else None
        got = session.drained(spark, stream, str(tmp_path / "out"))
        if step == 1:
            with open(source / "a.json", "a") as f:
                f.write('"seq": 500, "text": "late end", "is_final": true, "lang": "en", "t_client": "2024-01-01T00:00:00+00:00"}\n')
            assert 500 not in {r["seq"] for r in got.collect()}
    want = sorted(seen + [(1, 500, "late end", True)])
    assert sorted((r["session"], r["seq"], r["text"], r["is_final"]) for r in got.collect()) == want


def test_source_refuses_other_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"session": 1, "seq": "no"}\n')
    with pytest.raises(Exception, match="x.json, byte 0"):
        session.drained(spark, transcripts.read_transcripts(spark, str(tmp_path)), str(tmp_path / "out"))


def plain_order(rows, patience):
    """The segments of one session by number, from their arrival in order: later ones wait, gaps are given up at the end of all."""
    first = {}
    for r in rows:
        first.setdefault(r[1], r)
    out, due = [], 0
    for seq in sorted(first):
        out.append((first[seq][0], seq, first[seq][2], seq - due))
        due = seq + 1
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_segments_come_in_order(spark, tmp_path, batches):
    """Shuffled, repeated and lost segments equal a batch replay; a hot session among them."""
    rng, source = random.Random(batches), tmp_path / "in"
    rows = [(s, q, f"{s}-{q}", True, q) for s in range(4) for q in range(60 if s == 0 else 12) if rng.random() > 0.15]
    rows = sorted(rows, key=lambda r: r[1] + rng.random() * 6)  # no segment comes more than six seconds late
    for i in range(0, len(rows), 9):
        rows.insert(i + rng.randrange(3), rows[i])
    stream = segments.in_order(transcripts.read_transcripts(spark, str(source)), late=60, patience=30)
    for k in range(batches):
        put(source, f"part{k}", rows[k * len(rows) // batches : (k + 1) * len(rows) // batches])
        got = session.drained(spark, stream, str(tmp_path / "out"), session.PROVIDER)
    for k in range(3):  # the speakers' clocks go on
        put(source, "clock", [(99, k, "", True, 4000 + k)])
        got = session.drained(spark, stream, str(tmp_path / "out"), session.PROVIDER)
    want = [r for s in range(4) for r in plain_order([x for x in rows if x[0] == s], 30)]
    assert sorted((r["session"], r["seq"], r["text"], r["given_up"]) for r in got.where("session < 99").collect()) == sorted(want)


@pytest.fixture(scope="module")
def verses(spark):
    return spark.createDataFrame([("jo", 3, v, f"k{v}", f"e{v}") for v in range(15, 18)] + [("jo", 4, 1, "k", "e"), ("rm", 8, 1, "", "r1"), ("rm", 8, 28, "", "r28")], "abbrev string, ch int, v int, ko string, en string")


def test_places(verses):
    got = {(r["abbrev"], r["ch"], r["v"]): (r["place"], r["last"]) for r in corpus.placed(verses).collect()}
    assert got == {("jo", 3, 15): (1, 4), ("jo", 3, 16): (2, 4), ("jo", 3, 17): (3, 4), ("jo", 4, 1): (4, 4), ("rm", 8, 1): (1, 2), ("rm", 8, 28): (2, 2)}


def test_transcript_to_messages(spark, tmp_path, verses):
    """Text in, messages out, over restarts: interim and final under one id, a verse that isn't there, next over the chapter's end, a repeat, clear."""
    source = tmp_path / "in"
    said = [
        (1, 0, "요한복음 3장 17절", False, 1), (1, 1, "요한복음 3장 17절 말씀", True, 2), (1, 3, "Romans eight twenty eight", True, 4), (1, 2, "John 3:99 and nothing", True, 3), (1, 4, "John 3:17 again", True, 10),
        (2, 0, "요한 3장", True, 5),
    ]
    commands = [(1, 100, 0, 5, "select", 2, None), (1, 101, 0, 6, "next", None, None), (1, 102, 0, 7, "next", None, None), (1, 103, 0, 8, "select", 9, None), (1, 104, 0, 40, "clear", None, None), (2, 105, 0, 3, "next", None, None)]
    schema = "session long, seq long, item int, sec long, kind string, n int, abbrev string"
    frame = spark.createDataFrame(commands, schema).select("session", "seq", "item", F.timestamp_seconds(F.col("sec") + 1704067200).alias("t_client"), F.timestamp_seconds(F.col("sec") + 1704067200).alias("t_sent"), "kind", "n", "abbrev", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("boolean").alias("final"))
    frame.write.parquet(f"{tmp_path}/commands")
    ordered = segments.in_order(transcripts.read_transcripts(spark, str(source)), late=60)
    found = console.mentions(console.candidates(ordered, console.catalog(verses)))
    asked = spark.readStream.schema(console.EVENT).parquet(f"{tmp_path}/commands").withWatermark("t_sent", "60 seconds")
    for k in range(2):
        put(source, "a", said[k * 3 : k * 3 + 3])
        mentions_ = session.drained(spark, found, str(tmp_path / "mentions"), session.PROVIDER)
    assert sorted((r["session"], r["seq"], r["abbrev"], r["place"]) for r in mentions_.collect()) == [(1, 0, "jo", 3), (1, 1, "jo", 3), (1, 3, "rm", 2), (1, 4, "jo", 3)]
    # The session's state over mentions and commands of one time line.
    stream = spark.readStream.schema(console.EVENT).parquet(f"{tmp_path}/mentions/out").withWatermark("t_sent", "60 seconds").unionByName(asked)
    got = console.with_verses(session.drained(spark, console.messages(stream), str(tmp_path / "said"), session.PROVIDER), console.catalog(verses))
    rows = sorted(((r["session"], r["seq"], r["type"], r["abbrev"], r["place"], r["status"], r["at"], r["displayed"], r["en"]) for r in got.collect()), key=str)
    want = [
        (1, 0, "candidates", "jo", 3, "tentative", 1, False, "e17"), (1, 1, "candidates", "jo", 3, "confirmed", 1, False, "e17"), (1, 3, "candidates", "rm", 2, "confirmed", 1, False, "r28"),
        (1, 100, "context", "jo", 3, "confirmed", 2, True, "e17"), (1, 100, "show", "jo", 3, "confirmed", 2, True, "e17"), (1, 101, "context", "jo", 4, None, None, None, "e"), (1, 101, "show", "jo", 4, None, None, None, "e"),
        (1, 104, "clear", None, None, None, None, None, None),
    ]
    assert rows == sorted(want, key=str)
    assert len({r["id"] for r in got.where("abbrev = 'jo' and type = 'candidates'").collect()}) == 1


def test_one_stream_from_text_to_messages(spark, tmp_path, verses):
    """The two stateful steps in one query."""
    source = tmp_path / "in"
    put(source, "a", [(1, 1, "John 3:17", True, 2), (1, 0, "요한복음 삼 장 십칠 절", False, 1), (2, 0, "Romans 8:28", True, 3)])
    ordered = segments.in_order(transcripts.read_transcripts(spark, str(source)), late=60)
    said = console.messages(console.mentions(console.candidates(ordered, console.catalog(verses))))
    got = session.drained(spark, said, str(tmp_path / "out"), session.PROVIDER)
    assert sorted((r["session"], r["seq"], r["status"]) for r in got.collect()) == [(1, 0, "tentative"), (1, 1, "confirmed"), (2, 0, "confirmed")]


ASKED, ANSWER = "session long, seq long, sec long", "session long, seq long, ms long, abbrev string, ch int, v int"


@pytest.mark.parametrize("streaming", [False, True])
def test_answers_in_time_late_and_never(spark, tmp_path, streaming):
    asked = spark.createDataFrame([(1, 1, 0), (1, 2, 10), (1, 3, 20), (1, 4, 30), (2, 1, 0), (None, 9, 0)], ASKED).select("session", "seq", F.timestamp_seconds(F.col("sec") + 10**9).alias("t_asked"))  # a stream drops what is at the epoch
    said = [(1, 1, 900, "jo", 3, 16), (1, 1, 1500, "jo", 3, 17), (1, 2, 12_000, "rm", 8, 1), (1, 3, 99_000, "rm", 8, 1), (1, 4, 29_000, "rm", 8, 1), (2, 1, 1000, "xx", 1, 1), (None, 9, 1, "jo", 3, 16)]
    replies = spark.createDataFrame(said, ANSWER).select("session", "seq", F.timestamp_millis(F.col("ms") + 10**12).alias("t_answer"), "abbrev", "ch", "v")
    if streaming:
        for step in range(2):
            for name, df, t in (("q", asked, "t_asked"), ("a", replies, "t_answer")):
                (df.limit(1).withColumns({"session": F.lit(-1).cast("long"), t: F.lit("2100-01-01").cast("timestamp")}) if step else df).write.mode("append").parquet(f"{tmp_path}/{name}")
            q, a = (spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}") for name, df in (("q", asked), ("a", replies)))
            got = session.drained(spark, answers.awaited(q, a), str(tmp_path / "out")).where("session is null or session > 0")
    else:
        got = answers.awaited(asked, replies)
    rows = sorted(((r["session"], r["seq"], r["outcome"], r["v"]) for r in got.collect()), key=str)
    assert rows == sorted([(1, 1, "in_time", 16), (1, 1, "in_time", 17), (1, 2, "late", 1), (1, 3, "never", None), (1, 4, "never", None), (2, 1, "in_time", 1), (None, 9, "never", None)], key=str)
    catalog = spark.createDataFrame([("jo", 3, 16), ("jo", 3, 17), ("rm", 8, 1)], "abbrev string, ch int, v int")
    assert sorted((r["seq"], r["v"], r["late"]) for r in answers.labelled(got, catalog).collect()) == [(1, 16, False), (1, 17, False), (2, 1, True)]


def test_hops_of_two_clocks(spark):
    """The offset is the median of the last five pings before the message; a message before the first ping has none."""
    pings = spark.createDataFrame([(1, 100 * i, i, 100 * i + o, 100 * i, 100 * i, 100 * i + o) for i, o in enumerate((7000, -7000, 1000, 3000, 2000, 99000, 2500), 1)], "session long, t long, event_id long, t0 long, t1 long, t2 long, t3 long")
    messages = spark.createDataFrame([(50, 1, 10_000, 50, 60, 11_000), (51, 1, 10_000, 520, 5_520, 11_000), (52, 1, 10_000, 900, 1_900, 11_000)], "event_id long, session long, t_client long, t_recv long, t_sent long, t_render long")
    got = {(r["event_id"], r["hop"]): r["ms"] for r in metrics.hops(pings, messages, 5).collect()}
    assert {k[0] for k in got} == {51, 52}
    assert got[51, "received"] == (520 - (10_000 - 2000)) / 1000 and got[51, "answered"] == 5.0 and got[51, "rendered"] == (11_000 - 2000 - 5_520) / 1000
    assert got[52, "received"] == (900 - (10_000 - 2500)) / 1000


def test_a_batch_that_fails_between_roles_is_told_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, "candidates", "jo", 3, "x", "confirmed", 1, False), (1, 2, 0, "show", "jo", 3, "x", "confirmed", 1, True)], console.MESSAGE)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    failing = {"left": 1}

    class Failing(console.Ledger):
        def write(self, rows, role, batch):
            super().write(rows, role, batch)
            if role == "display" and failing["left"]:
                failing["left"] -= 1
                raise RuntimeError("the display is gone")

    sink = Failing(str(tmp_path / "told"))
    run = lambda: spark.readStream.schema(console.MESSAGE).parquet(f"{tmp_path}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="the display is gone"):
        run()
    told = lambda role: [r["seq"] for r in sink.read(spark, role, console.MESSAGE).collect()]
    assert told("console") == [1] and told("display") == []  # half written, so not read
    before = sorted(p.name for p in (tmp_path / "told" / "console").rglob("*.parquet"))
    run()
    assert told("console") == [1] and told("display") == [2]
    assert sorted(p.name for p in (tmp_path / "told" / "console").rglob("*.parquet")) == before  # not written again
    run()
    sink(rows, 0)
    assert told("console") == [1] and told("display") == [2]


class Kept:
    """A state without a store, which counts what is written to it."""

    def __init__(self):
        self.values, self.writes, self.timers = {}, 0, set()

    def getValueState(self, name, *schemas):
        return State(self, name)

    getMapState = getValueState

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.now


class State:
    def __init__(self, kept, name):
        self.kept, self.own = kept, kept.values.setdefault(name, {})

    def exists(self):
        return () in self.own

    def get(self):
        return self.own[()]

    def update(self, value):
        self.own[()] = value

    def iterator(self):
        return iter(list(self.own.items()))

    def values(self):
        return iter(list(self.own.values()))

    def updateValue(self, key, value):
        self.own[key], self.kept.writes = value, self.kept.writes + 1

    def removeKey(self, key):
        del self.own[key]


def test_very_many_waiting_segments_are_few_writes(spark):
    """A first gap holds back all of a session; what then is given up equals a plain replay, and the state has no write for each segment."""
    import pandas as pd

    seqs = [q for q in range(1, 30_000) if q % 11 != 5]
    random.Random(1).shuffle(seqs)
    kept, order = Kept(), segments.InOrder(0, 5)
    kept.now = 0
    order.init(kept)
    frame = lambda own: pd.DataFrame({"seq": own, "text": [f"t{q}" for q in own], "is_final": True, "lang": "ko", "micros": [q * 1_000_000 for q in own]})
    for part in (seqs[:20_000], seqs[20_000:] + seqs[:50]):
        assert not list(order.handleInputRows((7,), (frame(part[i : i + 9000]) for i in range(0, len(part), 9000)), kept))
    assert kept.writes < 100 and kept.timers == {6000}
    got = []
    for kept.now in (15_000, 10**9):  # at 15 s the segments of the first ten seconds have waited long enough
        got.append(pd.concat(order.handleExpiredTimer((7,), kept, None)))
    rows = pd.concat(got)
    want = [(7, q, f"t{q}", g) for q, g in ((r[1], r[3]) for r in plain_order([(7, q, "", True) for q in seqs], 5))]
    assert list(zip(rows["session"], rows["seq"], rows["text"], rows["given_up"])) == want
    assert int(got[0]["seq"].max()) == 15 and kept.values["due"][()] == (30_000,) and not kept.values["waiting"] and not kept.timers
