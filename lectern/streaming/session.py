"""Sessions as stateful streams: the displayed reference as context, suppression of repeats, and the messages to consoles and displays.

State is kept for each session and dropped after EXPIRES of silence. It outlives a restart in the stream's checkpoint, where a service that
keeps it in memory would begin a new session; a new checkpoint folder is a new session here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.shared import shared_folder

OUTPUT = "session long, event_id long, ref long, context long, emitted boolean"
STATE = "context long, seen string"
MESSAGE = "session long, event_id long, type string, ref long, candidate_id string, status string, place int"
MESSAGE_STATE = "context long, candidates string"
#: A session without events for so many milliseconds, by the events' own time, is over; events that come later than this are dropped.
EXPIRES = 12 * 3600 * 1000
#: Candidates that a console lists.
LISTED = 5


def _in_order(batches: Iterator):
    """A micro-batch's events of one session in order of time and number; its size is bounded by what a trigger reads."""
    import pandas as pd

    return pd.concat(list(batches)).sort_values(["micros", "event_id"], kind="stable")


def _expire(state: GroupState, at: int) -> None:
    """Lets the state go when the watermark is at that time, in milliseconds."""
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def sessions(events: DataFrame, seconds: int, expires: int = EXPIRES) -> DataFrame:
    """session, event_id, ref, context and emitted of every mention in a stream of events.

    events: session, event_id, ts (timestamp), kind (mention, display, clear), ref. The context is what was displayed last, never what was detected; a
    clear empties it and ends suppression. A mention is emitted unless the same reference was emitted less than
    seconds before. Events count in order of ts and event_id within a batch, late ones in order of arrival. The state
    keeps only emissions that can still suppress.
    """

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        context, seen = state.get if state.exists else (None, "{}")
        recent: dict[str, int] = json.loads(seen)
        rows, out = _in_order(batches), []
        for event_id, micros, kind, ref in zip(rows["event_id"], rows["micros"], rows["kind"], rows["ref"]):
            if kind == "display":
                context = int(ref)
            elif kind == "clear":
                context, recent = None, {}
            else:
                last = recent.get(str(int(ref)))
                emitted = last is None or micros - last >= seconds * 1_000_000
                if emitted:
                    recent[str(int(ref))] = int(micros)
                out.append((key[0], event_id, int(ref), context, emitted))
        newest = int(rows["micros"].max())
        state.update((context, json.dumps({r: t for r, t in recent.items() if newest - t < seconds * 1_000_000})))
        _expire(state, newest // 1000 + expires)
        if out:
            yield pd.DataFrame(out, columns=["session", "event_id", "ref", "context", "emitted"]).astype({"context": "Int64"})

    rows = events.withWatermark("ts", f"{expires} milliseconds").select("session", "event_id", "ts", F.unix_micros("ts").alias("micros"), "kind", "ref")
    return rows.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def messages(events: DataFrame, seconds: int, expires: int = EXPIRES, listed: int = LISTED) -> DataFrame:
    """MESSAGE rows for consoles and displays, from a stream of events of sessions.

    events: session, event_id, ts (timestamp), kind, ref, final. kind is mention (a reference in an interim or final segment), select (the candidate at
    place ref of the list, from 1), display_ref (ref itself), next (the one after what is displayed) or clear. Messages: candidates (a new one, or a tentative one that is
    confirmed by a final segment under its id; status says which), context and show (what is displayed from now on), clear. A reference seen in
    interim and final segments keeps the id of its first; repeats less than seconds after it are silent; a clear ends that. The
    list keeps the newest candidates; place is where the message's stands. A selection of an empty place says nothing.
    """

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import hashlib

        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        context, stored = state.get if state.exists else (None, "[]")
        known: list[dict] = json.loads(stored)  # newest first
        rows, out = _in_order(batches), []
        say = lambda event_id, type_, ref=None, c=None, place=None: out.append((key[0], event_id, type_, ref, c and c["id"], c and ("confirmed" if c["final"] else "tentative"), place))
        for event_id, micros, kind, ref, final in zip(rows["event_id"], rows["micros"], rows["kind"], rows["ref"], rows["final"]):
            ref = None if pd.isna(ref) else int(ref)
            if kind == "mention":
                own = next((c for c in known if c["ref"] == ref and micros - c["at"] < seconds * 1_000_000), None)
                if own is None:
                    known = [{"ref": ref, "at": int(micros), "final": bool(final), "id": hashlib.sha256(f"{key[0]}|{ref}|{event_id}".encode()).hexdigest()}, *known][:listed]
                    say(event_id, "candidates", ref, known[0], 1)
                elif final and not own["final"]:
                    own["final"] = True
                    say(event_id, "candidates", ref, own, known.index(own) + 1)
            elif kind == "clear":
                context, known = None, []
                say(event_id, "clear")
            else:
                chosen = None
                if kind == "select":
                    if ref is None or not 0 < ref <= len(known):
                        continue
                    chosen = known[ref - 1]
                    context = chosen["ref"]
                elif kind == "next":
                    if context is None:
                        continue
                    context += 1
                else:
                    context = ref
                say(event_id, "context", context, chosen)
                say(event_id, "show", context, chosen)
        state.update((context, json.dumps(known)))
        _expire(state, int(rows["micros"].max()) // 1000 + expires)
        if out:
            yield pd.DataFrame(out, columns=["session", "event_id", "type", "ref", "candidate_id", "status", "place"]).astype({"ref": "Int64", "place": "Int32"})

    rows = events.withWatermark("ts", f"{expires} milliseconds").select("session", "event_id", "ts", F.unix_micros("ts").alias("micros"), "kind", "ref", "final")
    return rows.groupBy("session").applyInPandasWithState(step, MESSAGE, MESSAGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: State with timers, maps and lists needs this store.
STORE, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark: SparkSession, stream: DataFrame, folder: str | None = None, store: str | None = None) -> DataFrame:
    """All that a stream gives for what is there now, written to folder (a new one in the shared folder) and read from it.

    A folder that was drained to before goes on where it ended: its state and what it has read are in the checkpoint. store: the
    state store of this query, by default that of the session, whose setting stays as it is.
    """
    folder, before = folder or shared_folder(spark, "stream"), spark.conf.get(STORE)
    try:
        spark.conf.set(STORE, store or before)
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
