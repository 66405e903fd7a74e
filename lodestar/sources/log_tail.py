"""Growing log files as a stream: a Python data source that remembers, per file, up to which byte it has read.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("path", "/var/log/nginx/*.log").load()

Rows are path, at (byte at which the line begins) and line, trimmed; blank lines are left out. Only whole lines are read:
one that isn't ended yet waits for its end. A file that is shorter than what was read of it was begun anew, and is read from
its start; a file that is gone is forgotten. Files must be where every worker can read them. Long pieces are cut into
ranges of RANGE bytes, each a task; a line belongs to the range in which it begins.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE = 64 << 20
BLOCK = 1 << 16


def last_line_end(path: str, size: int) -> int:
    """Byte behind the last line end of the first size bytes; 0 if there is none."""
    with open(path, "rb") as file:
        end = size
        while end:
            start = max(0, end - BLOCK)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin from start up to (not at) end; begin: where a line is known to begin."""

    path: str
    begin: int
    start: int
    end: int


class LogTailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, range_bytes: int) -> None:
        self.pattern, self.range_bytes = pattern, range_bytes

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                out[path] = last_line_end(path, os.path.getsize(path))
            except FileNotFoundError:  # it went between the listing and the look
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            if stop < begin:
                begin = 0
            pieces += [Piece(path, begin, at, min(at + self.range_bytes, stop)) for at in range(begin, stop, self.range_bytes)]
        return pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        try:
            file = open(partition.path, "rb")  # noqa: SIM115
        except FileNotFoundError:  # it was taken away after it was seen
            return
        with file:
            at = partition.start
            if at > partition.begin:
                file.seek(at - 1)
                at += len(file.readline()) - 1  # the rest of a line of the range before
            file.seek(at)
            while at < partition.end:
                raw = file.readline()
                if not raw:
                    return
                line = raw.decode("utf-8", "replace").strip()
                if line:
                    yield (partition.path, at, line)
                at += len(raw)


class LogTail(DataSource):
    """Options: path (a pattern), range (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> LogTailReader:  # noqa: N802
        return LogTailReader(self.options["path"], int(self.options.get("range", RANGE)))
