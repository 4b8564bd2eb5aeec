"""Segments of a transcript in the order of their numbers, as a stateful stream.

Each session waits for the number that is due. What comes early is kept in the state, what comes again is dropped. A number that stays away is given
up once the watermark is patience past the first segment that waits for it. The state of a session that waits for nothing is one number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.sources.transcripts import SEGMENT

ORDERED = SEGMENT + ", given_up long, t_sent timestamp"
#: How long a gap holds back what comes after it, and how late a segment may be, in seconds of the speaker's clock.
PATIENCE, LATE = 5, 10


#: So many numbers of a session's waiting segments are one value of its state.
BLOCK = 1024
#: So many blocks are put in order at a time.
BLOCKS = 64
#: Rows of a frame that is handed on.
FRAME = 10_000


def _cut(table, marks) -> list:
    """The table in pieces of equal marks that are in a row."""
    import numpy as np

    ends = [*(np.flatnonzero(np.diff(marks)) + 1).tolist(), table.num_rows]
    return [table.slice(a, b - a) for a, b in zip([0, *ends], ends)] if table.num_rows else []


class InOrder(StatefulProcessor):
    """Gives each session's segments by number, the first of those with one number; given_up counts the numbers before it that never came.

    t_sent is the time for what follows in the stream: t_client, or the watermark for a segment that waited longer than that.
    What waits is kept in Arrow tables by blocks of numbers, so a session for which very many wait is some values of the state and no object a segment.
    """

    def __init__(self, first: int, patience: int) -> None:
        self.first, self.patience = first, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "seq long")
        self.waiting = handle.getMapState("waiting", "block long", "segments binary")

    def _next(self) -> int:
        return self.due.get()[0] if self.due.exists() else self.first

    def _held(self):
        """The table of what waits, and (rows, first number) of each of its blocks."""
        import pyarrow as pa

        schema = pa.schema([("seq", pa.int64()), ("text", pa.large_string()), ("is_final", pa.bool_()), ("lang", pa.large_string()), ("micros", pa.int64())])
        tables = {k: pa.ipc.open_stream(segments).read_all() for k, segments in sorted((k[0], bytes(v[0])) for k, v in self.waiting.iterator())}
        return pa.concat_tables([schema.empty_table(), *tables.values()]), {k: (t.num_rows, t["seq"][0].as_py()) for k, t in tables.items()}

    def _write(self, before: dict, waiting) -> int:
        """Writes the blocks of what waits, in the order of numbers, and takes them out of before; one that has as many and the same first is the same. The earliest time."""
        import pyarrow as pa

        blocks = waiting["seq"].to_numpy() // BLOCK
        for table in _cut(waiting, blocks):
            block = table["seq"][0].as_py() // BLOCK
            if before.pop(block, None) != (table.num_rows, table["seq"][0].as_py()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.combine_chunks())
                self.waiting.updateValue((block,), (sink.getvalue().to_pybytes(),))
        return int(waiting["micros"].to_numpy().min())

    def _keep(self, gone: dict, due: int, earliest: list[int]) -> None:
        """Drops the blocks of which nothing waits any more, and sets the one timer for when the earliest of what waits has waited long enough, in milliseconds."""
        for block in gone:
            self.waiting.removeKey((block,))
        self.due.update((due,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if earliest:
            self.handle.registerTimer(min(earliest) // 1000 + self.patience * 1000)

    @staticmethod
    def _frames(key, table, given_up, timerValues) -> Iterator:
        """What goes on, as frames."""
        import pandas as pd

        sent = pd.Timestamp(timerValues.getCurrentWatermarkInMs() + 1, unit="ms")
        for a in range(0, table.num_rows, FRAME):
            out = table.slice(a, FRAME).to_pandas()
            time = pd.to_datetime(out["micros"], unit="us")
            own = out.drop(columns="micros").assign(t_client=time, given_up=given_up[a : a + FRAME], t_sent=time.clip(lower=sent))
            own.insert(0, "session", key[0])
            yield own

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pyarrow as pa

        due, (held, before) = self._next(), self._held()
        pieces = defaultdict(list)  # by ranges of numbers, so that only one range at a time is put in order

        def deal(table) -> None:
            of = table["seq"].to_numpy() // (BLOCK * BLOCKS)
            at = np.argsort(of, kind="stable")
            for piece in _cut(table.take(pa.array(at)), of[at]):
                pieces[piece["seq"][0].as_py() // (BLOCK * BLOCKS)].append(piece)

        deal(held)
        schema = held.schema
        del held
        for pdf in rows:
            new = pdf[["seq", "text", "is_final", "lang", "micros"]][pdf["seq"] >= due]
            deal(pa.Table.from_pandas(new.assign(is_final=[bool(x) for x in new["is_final"]]), schema, preserve_index=False).replace_schema_metadata())
        earliest = []
        for k in sorted(pieces):
            every = pa.concat_tables(pieces.pop(k))
            seq, at = np.unique(every["seq"].to_numpy(), return_index=True)  # the first to come of each number
            every = every.take(pa.array(at))
            ready = int((seq == due + np.arange(len(seq))).sum())  # once a number is missing, all later ones are larger
            due += ready
            yield from self._frames(key, every.slice(0, ready), np.zeros(ready, "int64"), timerValues)
            if ready < len(seq):
                earliest.append(self._write(before, every.slice(ready)))
        self._keep(before, due, earliest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np

        due, (held, before) = self._next(), self._held()
        now = timerValues.getCurrentWatermarkInMs()
        seq, micros = held["seq"].to_numpy(), held["micros"].to_numpy()
        gaps = np.diff(seq, prepend=due - 1) - 1
        # Gaps are given up one after the other, as long as the earliest of all that still waits has waited long enough; what follows without a gap goes too.
        starts = np.flatnonzero(gaps)
        earliest = np.minimum.accumulate(micros[::-1])[::-1]
        stay = starts[earliest[starts] // 1000 + self.patience * 1000 > now]
        upto = int(stay[0]) if len(stay) else len(seq)
        yield from self._frames(key, held.slice(0, upto), gaps[:upto], timerValues)
        earliest = [self._write(before, held.slice(upto))] if upto < len(seq) else []
        self._keep(before, int(seq[upto - 1]) + 1 if upto else due, earliest)

    def close(self) -> None:
        pass


def in_order(segments: DataFrame, first: int = 0, patience: int = PATIENCE, late: int = LATE) -> DataFrame:
    """ORDERED rows of a stream of SEGMENT rows, in the order of seq in each session from first on.

    Of segments with one number the first to come counts; one whose number was given up, or that is later than late seconds, is dropped. A gap at the
    end of all data is given up in the batch after the one whose data, of any session, move the watermark on. Rows without session, seq or t_client are dropped.
    """
    whole = segments.where("session is not null and seq is not null and t_client is not null").withWatermark("t_client", f"{late} seconds")
    rows = whole.select("session", "seq", "text", "is_final", "lang", F.unix_micros("t_client").alias("micros"), "t_client")
    return rows.groupBy("session").transformWithStateInPandas(InOrder(first, patience), ORDERED, "append", "eventTime", eventTimeColumnName="t_sent")
