"""WARC archives of pages, and their capture index merged from locally sorted runs.

Payloads are kept once: of captures with one payload the one with the largest page_id is a response record, the others
revisit records that hold headers only. Every archive's captures are sorted by URL key and timestamp in the task that wrote it: a run.
Ranges of the key space are then merged: each task has its range's stretch of every run and merges them with a
loser tree, so that the ranges one after the other are the capture histories in global order. Only index rows move.
"""

from __future__ import annotations

import bisect
import contextlib
import itertools
import math
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, joined, new_folder, parts, sampled
from lectern.llm.storage import attempt_name, opened

#: An archive is closed after so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Captures of a range, about; keys sampled for the ranges' bounds, about, for each range; captures of a stretch that is sent as one row.
RANGE_CAPTURES, RANGE_SAMPLE, STRETCH = 200_000, 64, 2_000
URN = "urn:page:"
INDEX = "url_key string, captured string, page_id long, record_type string, payload_digest string, archive string, offset long, length long"


def url_key(url: Column) -> Column:
    """The url with its host's labels reversed and joined by commas, without scheme, port, fragment or www.; null: empty."""
    parts_ = r"(?s)^(?:[^:/?#]*://)?(?:www\d*\.)?([^/?#:]*)(?::\d+)?([^#]*).*\z"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, parts_, 1)), r"\.")), ",")
    return F.coalesce(F.concat(host, F.lit(")"), F.regexp_extract(url, parts_, 2)), F.lit(""))


def capture_time(page_id: Column) -> Column:
    """The time of a page of a table that has none: page_id seconds after 1970 (in four-digit years)."""
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(253_402_300_800))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


class LoserTree:
    """Merges k sorted iterators: the inner nodes hold the losers of their matches, so each step plays log2 k of them."""

    def __init__(self, sources: list[Iterator], key) -> None:
        self.key, self.k = key, max(1, len(sources))
        self.sources = sources
        self.heads: list[Any] = [next(s, None) for s in sources] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        x, y = self.key(x), self.key(y)
        return x < y or (x == y and a < b)

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.tree[node]
            if building and other < 0:
                self.tree[node] = winner  # waits for its opponent
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[at := self.tree[0]]) is not None:
            yield head
            self.heads[at] = next(self.sources[at], None)
            self._play(at)


def record(kind: str, url: str, page_id: int | None, date: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One record, gzipped by itself. A revisit's block has the HTTP header of the full payload and no payload."""
    import gzip

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: <{URN}{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress(("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n", 5, mtime=0)


def parsed(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """(named fields, bytes of the full payload, payload) of a gzipped record."""
    import gzip

    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1]), payload


def captures(pages: DataFrame, date: Column | None = None, least: int = 0) -> DataFrame:
    """A row for each record to write: page_id, url, date, sha1, size, html (responses only), kind, refers_to.

    Of captures with one payload of at least least bytes the largest (page_id, url) is the response. Their payloads are gathered once for each digest, combined
    before the shuffle, and meet the one response there without being moved again, so the copies of a page cost a small row each; the
    small rows of a digest with very many captures are dealt over several tasks. Smaller payloads are all responses, as they are.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), (capture_time(F.col("page_id")) if date is None else date).alias("date"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html").cast("long")})
    large = rows.where(F.col("size") >= least)
    seen = cut(large.groupBy("sha1", "page_id", "url", "date", "size").agg(F.count("*").alias("times")))
    best = cut(seen.groupBy("sha1").agg(F.max(F.struct("page_id", "url", "date")).alias("best")))
    known = joined(seen, best, "sha1")
    first = (F.col("best.page_id").eqNullSafe(F.col("page_id"))) & (F.col("best.url") == F.col("url")) & F.col("best.date").eqNullSafe(F.col("date"))
    known = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1))).withColumn("one", (F.col("copy") == 0) & first)
    common = ["page_id", "url", "date", "sha1", "size"]
    revisits = known.where("not one").select(*common, F.lit(None).cast("string").alias("html"), F.lit("revisit").alias("kind"), F.col("best.page_id").alias("refers_to"))
    payloads = large.groupBy("sha1").agg(F.first("html").alias("html"))
    as_response = lambda df: df.select(*common, "html", F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to"))
    out = as_response(payloads.join(known.where("one").select(*common), "sha1")).unionByName(revisits.repartition(parts(pages), "page_id", "url"))
    return out.unionByName(as_response(rows.where(F.col("size") < least))) if least > 0 else out


def archived(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes records to archives under folder and returns the runs: each archive's captures (INDEX) in order of key, a table.

    A run is there only if its task ended well, so archives of lost attempts are never read. pos numbers a run's rows.
    """

    def write(batches: Iterator) -> Iterator:
        import base64

        import pyarrow as pa

        system, top = opened(folder)
        base, number, out, at, run = attempt_name(), 0, None, 0, []

        def finished():
            out.close()
            run.sort(key=_order)
            return pa.RecordBatch.from_pylist([{**row, "pos": i} for i, row in enumerate(run)], schema=_arrow(pos=pa.int32()))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(top, recursive=True)
                    name, at, run = f"{base}-{number:04d}.warc.gz", 0, []
                    out = system.open_output_stream(f"{top}/{name}", compression=None)  # records are compressed one by one
                digest, date = base64.b32encode(row["sha1"]).decode(), row["date"] or ""
                payload = (row["html"] or "").encode() if row["kind"] == "response" else b""
                data = record(row["kind"], row["url"], row["page_id"], date, digest, row["size"], row["refers_to"], payload)
                out.write(data)
                run.append({"url_key": row["url_key"], "captured": date, "page_id": row["page_id"], "record_type": row["kind"], "payload_digest": digest, "archive": f"{folder}/{name}", "offset": at, "length": len(data)})
                at += len(data)
                if at >= archive_bytes:
                    yield finished()
                    out, number = None, number + 1
        if out is not None:
            yield finished()

    records.withColumn("url_key", url_key(F.col("url"))).mapInArrow(write, f"{INDEX}, pos int").write.parquet(f"{folder}/runs")
    return records.sparkSession.read.schema(f"{INDEX}, pos int").parquet(f"{folder}/runs")


def _arrow(**more):
    """INDEX and more as an Arrow schema."""
    import pyarrow as pa

    of = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([*((n, of[t]) for n, t in (x.split() for x in INDEX.split(", "))), *more.items()])


def _order(row: dict) -> tuple:
    """Captures by URL key, timestamp and page_id (null first), then by their place."""
    page_id = row["page_id"]
    return row["url_key"], row["captured"], page_id is not None, page_id or 0, row["archive"], row["offset"]


def merged(runs: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """The captures of all runs in global order: INDEX, range and place (both from 0).

    A range's captures lie between two bounds, which come from a sample that grows with the ranges and don't change the result. A key with very many
    captures is cut by timestamp and page_id like any other. The stretch of a run in a range is sent as one row for
    STRETCH captures, in which they stay in order; the merging task plays the runs against each other.
    """
    names = INDEX.replace(",", "").split()[::2]
    n = runs.count()
    ranges = max(1, math.ceil(n / range_captures), min(parts(runs), n // 1_000))
    few = sampled(runs.select("url_key", "captured", "page_id", "archive", "offset"), RANGE_SAMPLE * ranges, "url_key", "page_id", "archive", "offset").collect() if ranges > 1 else []
    sample = sorted(_order(r.asDict()) for r in few)
    bounds = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []

    def stretches(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("range", pa.int32()), ("run", pa.string()), ("pos", pa.int32()), ("rows", pa.list_(pa.struct(list(_arrow()))))])
        for batch in batches:
            out, rows = [], sorted(batch.to_pylist(), key=lambda r: (r["archive"], r["pos"]))
            for run, own in itertools.groupby(rows, lambda r: r["archive"]):
                own = list(own)
                keys = [_order(r) for r in own]
                cuts = [0, *(bisect.bisect_left(keys, b) for b in bounds), len(own)]
                for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                    for i in range(a, b, STRETCH):
                        out.append({"range": k, "run": run, "pos": own[i]["pos"], "rows": [{c: r[c] for c in names} for r in own[i : min(b, i + STRETCH)]]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def merge(key, table):
        import pyarrow as pa

        parts_of = sorted(table.select(["run", "pos", "rows"]).to_pylist(), key=lambda r: (r["run"], r["pos"]))
        runs_here = [itertools.chain.from_iterable(x["rows"] for x in own) for own in (list(g) for _, g in itertools.groupby(parts_of, lambda r: r["run"]))]
        order = LoserTree(runs_here, _order)
        number = key[0].as_py()
        return pa.Table.from_pylist([{**row, "range": number, "place": i} for i, row in enumerate(order)], schema=_arrow(range=pa.int32(), place=pa.int32()))

    sent = runs.mapInArrow(stretches, f"range int, run string, pos int, rows array<struct<{', '.join(x.replace(' ', ': ') for x in INDEX.split(', '))}>>")
    return sent.groupBy("range").applyInArrow(merge, f"{INDEX}, range int, place int")


def histories(runs: DataFrame) -> DataFrame:
    """The merged index with position, the place of each capture in the global order; the ranges' sizes are all that is broadcast."""
    index = cut(merged(runs))
    sizes = sorted(index.groupBy("range").count().collect())
    before = [0, *itertools.accumulate(r["count"] for r in sizes)]
    bases = runs.sparkSession.createDataFrame([(r["range"], b) for r, b in zip(sizes, before)], "range int, base long")
    return index.join(F.broadcast(bases), "range").select(*[F.col(x.split()[0]) for x in INDEX.split(", ")], (F.col("base") + F.col("place")).alias("position"))


def read_back(index: DataFrame) -> DataFrame:
    """The records that an index names, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, date, position.

    Each archive is read by one task, in order of offset. A response whose payload doesn't have its digest raises.
    """

    def read(batches: Iterator) -> Iterator:
        import base64
        import hashlib

        import pyarrow as pa

        of = lambda urn: int(urn.removeprefix("<" + URN).rstrip(">")) if urn and urn != f"<{URN}>" else None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("position", pa.int64())])
        name = None
        with contextlib.ExitStack() as archive:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if row["archive"] != name:
                        archive.close()
                        system, at = opened(name := row["archive"])
                        source = archive.enter_context(system.open_input_file(at))
                    source.seek(row["offset"])
                    fields, size, payload = parsed(source.read(row["length"]))
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name}: the record at {row['offset']} isn't whole")
                    out.append((of(fields["WARC-Record-ID"]), size, digest, kind, of(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], fields["WARC-Date"], row["position"]))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    places = index.select("archive", "offset", "length", "position").repartition(parts(index), "archive").sortWithinPartitions("archive", "offset")
    return places.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, position long")


def round_trip(pages: DataFrame, least: int = 0, date: Column | None = None) -> DataFrame:
    """The records of pages (page_id, url, html) as written to archives, found by the merged index and read back.

    A null html is empty, a null url the empty key. Of rows that repeat page_id, url and payload one is the response, the others revisit
    it; a page without page_id is the response only if no other has its payload. An empty table gives no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    return read_back(histories(archived(captures(pages, date, least), folder)))
