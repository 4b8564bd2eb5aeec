"""From transcripts to the messages of consoles and displays, in one stream.

Segments come in the order of their numbers, references are detected in their texts, looked up in the corpus by a join with its verses, and
go through each session's state: the candidates, newest first, and what is displayed. Commands of the interpreter join them there. Messages are written
by a sink that keeps a ledger of batches for each role, so a batch that is run again writes nothing twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators import corpus, detect
from lectern.streaming.session import LISTED

#: kind: mention, select (n: the candidate's number in the list), display_ref (abbrev, place, last), next or clear.
EVENT = "session long, seq long, item int, t_client timestamp, t_sent timestamp, kind string, n int, abbrev string, place long, last long, final boolean"
MESSAGE = "session long, seq long, item int, type string, abbrev string, place long, id string, status string, at int, displayed boolean"
#: Whom a message is for.
ROLES = {"console": ("candidates", "context"), "display": ("show", "clear")}
#: Seconds without events after which a session's state goes.
EXPIRES = 12 * 3600


def catalog(verses: DataFrame) -> DataFrame:
    """abbrev, ch, v, place, last, ko, en of verses (abbrev, ch, v, ko, en), for candidates(); keep it with stored() where it is more than a scan, as every batch reads it."""
    return corpus.placed(verses).join(verses, ["abbrev", "ch", "v"])


def stored(catalog: DataFrame, path: str) -> DataFrame:
    """The catalog, written to path as a table of buckets by the keys of the join, so that no batch of a stream shuffles it again."""
    spark, keys = catalog.sparkSession, ["abbrev", "ch", "v"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    catalog.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(name := f"catalog_{uuid.uuid4().hex}")
    return spark.table(name)


def candidates(segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """References in a stream of ordered segments (segments.ORDERED) that the corpus has.

    Columns: session, seq, item, t_client, t_sent, final, abbrev, ch, v (the first if none was said), v2, matched, start, end,
    confidence, place, last, ko, en; the join with the catalog is by key, so a large corpus isn't broadcast.
    """
    key = F.struct("session", "seq", "t_client", "t_sent", F.col("is_final").alias("final")).alias("k")
    # A session's segments come out of one task; what is in them is looked for by all.
    found = detect.detected(segments.repartition("session", "seq").select(key, "text"), "k")
    v = F.greatest(F.lit(1), F.coalesce("v1", F.lit(1)))
    wanted = found.select("k.*", "item", "abbrev", "ch", v.alias("v"), "v2", "matched", "start", "end", "confidence")
    return wanted.join(catalog, ["abbrev", "ch", "v"])


def mentions(found: DataFrame) -> DataFrame:
    """EVENT rows of candidates(); what is said first in a segment comes first."""
    order = (F.col("start") * 1000 + F.col("item")).cast("int")
    none = lambda t: F.lit(None).cast(t)
    return found.select("session", "seq", order.alias("item"), "t_client", "t_sent", F.lit("mention").alias("kind"), none("int").alias("n"), "abbrev", "place", "last", "final")


class Console(StatefulProcessor):
    """A session's candidates and display, in values and lists of the state; a timer ends a silent session."""

    def __init__(self, seconds: int, listed: int, expires: int) -> None:
        self.seconds, self.listed, self.expires = seconds, listed, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "abbrev string, place long, last long")
        self.known = handle.getListState("known", "abbrev string, place long, last long, micros long, final boolean, id string, displayed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import hashlib

        import pandas as pd

        shown = self.shown.get() if self.shown.exists() else None
        known = [list(c) for c in self.known.get()] if self.known.exists() else []
        events = pd.concat(list(rows)).sort_values(["micros", "seq", "item"], kind="stable")  # of one session in one trigger
        out, newest = [], 0

        def say(e, type_, ref=None, c=None) -> None:
            at = next((i + 1 for i, k in enumerate(known) if k is c), None)
            out.append((key[0], e.seq, e.item, type_, ref and ref[0], ref and ref[1], c and c[5], c and ("confirmed" if c[4] else "tentative"), at, None if c is None else c[6]))

        for e in events.itertuples(index=False):
            newest = max(newest, int(e.micros))
            if e.kind == "mention":
                own = next((c for c in known if (c[0], c[1]) == (e.abbrev, e.place) and e.micros - c[3] < self.seconds * 1_000_000), None)
                if own is None:
                    name = hashlib.sha256(f"{key[0]}|{e.abbrev}|{int(e.place)}|{e.seq}|{e.item}".encode()).hexdigest()
                    own = [e.abbrev, int(e.place), int(e.last), int(e.micros), bool(e.final), name, False]
                    known = [own, *known][: self.listed]
                    say(e, "candidates", own, own)
                elif e.final and not own[4]:
                    own[4] = True
                    say(e, "candidates", own, own)
            elif e.kind == "clear":
                shown, known = None, []
                say(e, "clear")
            else:
                chosen = None
                if e.kind == "select" and 0 < e.n <= len(known):
                    chosen = known[int(e.n) - 1]
                    chosen[6] = True
                    shown = tuple(chosen[:3])
                elif e.kind == "next" and shown and shown[1] < shown[2]:
                    shown = (shown[0], shown[1] + 1, shown[2])
                elif e.kind == "display_ref" and e.abbrev is not None:
                    shown = (e.abbrev, int(e.place), int(e.last))
                else:
                    continue
                say(e, "context", shown, chosen)
                say(e, "show", shown, chosen)
        self.shown.clear() if shown is None else self.shown.update(tuple(shown))
        self.known.put([tuple(c) for c in known]) if known else self.known.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(newest // 1000 + self.expires * 1000)
        if out:
            yield pd.DataFrame(out, columns=["session", "seq", "item", "type", "abbrev", "place", "id", "status", "at", "displayed"]).astype({"place": "Int64", "at": "Int32", "displayed": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.shown.clear()
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def messages(events: DataFrame, seconds: int = 30, listed: int = LISTED, expires: int = EXPIRES) -> DataFrame:
    """MESSAGE rows from a stream of EVENT rows with a watermark on t_sent.

    A mention gives a candidate, or confirms a tentative one under its id; a repeat less than seconds after it says nothing. select shows a candidate and marks
    it as displayed, next the verse after the displayed one in its book's order (none after the last), display_ref what it names. clear ends display, list and
    suppression. Selections of empty places, and next without a display, say nothing. Events count in order of time, seq and item within a trigger.
    """
    rows = events.select("session", "seq", "item", F.unix_micros("t_client").alias("micros"), "kind", "n", "abbrev", "place", "last", "final", "t_sent")
    return rows.groupBy("session").transformWithStateInPandas(Console(seconds, listed, expires), MESSAGE, "append", "eventTime")


def with_verses(said: DataFrame, catalog: DataFrame) -> DataFrame:
    """Messages with ch, v, ko and en of what they name; null for a clear."""
    return said.join(catalog.drop("last"), ["abbrev", "place"], "left")


class Ledger:
    """A foreachBatch sink: each role's messages under folder/role, and the batches that were written whole in folder/role-ledger.

    Only batches in the ledger are read. A batch that fails between two roles and is run again writes only what isn't in a ledger yet; what it had half
    written is replaced. name tells apart streams with other checkpoints that write to one folder.
    """

    def __init__(self, folder: str, name: str = "stream", roles: dict = ROLES) -> None:
        self.folder, self.name, self.roles = folder.rstrip("/"), name, roles

    def _done(self, spark: SparkSession, role: str, batch: int) -> bool:
        return self._exists(spark, f"{self.folder}/{role}-ledger/{self.name}-{batch}")

    @staticmethod
    def _exists(spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def write(self, rows: DataFrame, role: str, batch: int) -> None:
        rows.where(F.col("type").isin(*self.roles[role])).write.mode("overwrite").parquet(f"{self.folder}/{role}/stream={self.name}/batch={batch}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, kept = rows.sparkSession, rows.persist()
        try:
            for role in self.roles:
                if not self._done(spark, role, batch):
                    self.write(kept, role, batch)
                    at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{role}-ledger/{self.name}-{batch}")
                    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)  # one step: there or not
        finally:
            kept.unpersist()

    def read(self, spark: SparkSession, role: str, schema) -> DataFrame:
        """What the role was told, of the batches in its ledger."""
        if not self._exists(spark, f"{self.folder}/{role}-ledger"):
            return spark.createDataFrame([], schema)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{role}-ledger")
        done = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
        paths = [f"{self.folder}/{role}/stream={n.rpartition('-')[0]}/batch={n.rpartition('-')[2]}" for n in done]
        return spark.read.schema(schema).parquet(*paths)
