"""Transcripts as a stream: JSON lines of segments under a folder, read by a Python data source that remembers how far each file was read.

A source of speech is anything that appends lines to files there. An offset is the number of bytes read of each file, up to the end of a whole line, so a
line that is still being written waits, and a batch that is run again reads the same bytes. Files are cut into ranges for several
tasks; a range holds the lines that begin in it.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SEGMENT = "session long, seq long, text string, is_final boolean, lang string, t_client timestamp"
#: Bytes of a file that one task reads, about.
RANGE = 32 << 20


def _opened(uri: str):
    from urllib.parse import urlparse

    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


class TranscriptReader(DataSourceStreamReader):
    def __init__(self, folder: str, ending: str, length: int) -> None:
        self.folder, self.ending, self.length = folder, ending, length

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, top = _opened(self.folder)
        files = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        found = {}
        for info in files:
            if info.type == fs.FileType.File and info.base_name.endswith(self.ending) and not info.base_name.startswith((".", "_")):
                if whole := self._whole_lines(system, info.path, info.size):
                    found[info.path] = whole
        return found

    @staticmethod
    def _whole_lines(system, path: str, size: int) -> int:
        """The bytes up to the last line's end."""
        with system.open_input_file(path) as source:
            end = size
            while end > 0:
                begin = max(0, end - (1 << 16))
                source.seek(begin)
                at = source.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, upto in sorted(end.items()):
            begin = start.get(path, 0)
            out += [Range(path, at, min(at + self.length, upto)) for at in range(begin, upto, self.length)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        with io.BufferedReader(system.open_input_file(partition.path)) as stored:
            at = partition.begin
            if at:  # a line that began before belongs to the range before
                stored.seek(at - 1)
                at += len(stored.readline()) - 1
            while at < partition.end:
                line = stored.readline()
                at += len(line)
                if line.strip():
                    yield _segment(line, partition.path, at - len(line))

    def commit(self, end: dict) -> None:
        pass


def _segment(line: bytes, path: str, at: int) -> tuple:
    try:
        x = json.loads(line)
        time = datetime.fromisoformat(x["t_client"].replace("Z", "+00:00"))
        time = time if time.tzinfo else time.replace(tzinfo=UTC)
        return int(x["session"]), int(x["seq"]), x.get("text"), bool(x.get("is_final")), x.get("lang"), time
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"{path}, byte {at}: no transcript segment") from e


class Transcripts(DataSource):
    """spark.readStream.format("transcripts").option("path", folder); further options: ending (of file names) and length (bytes of a task's range)."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SEGMENT

    def streamReader(self, schema: StructType) -> TranscriptReader:
        return TranscriptReader(self.options["path"], self.options.get("ending", ".json"), int(self.options.get("length", RANGE)))


def read_transcripts(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of SEGMENT rows from the JSON lines under folder; a malformed line raises an error that names its file and place."""
    spark.dataSource.register(Transcripts)
    return spark.readStream.format("transcripts").option("path", folder).options(**options).load()
