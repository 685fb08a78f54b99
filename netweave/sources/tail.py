"""A streaming source that tails growing text files, across rotation.

``spark.readStream.format("log_tail")``, option ``paths`` (comma-separated files
or glob patterns on a mounted file system) gives (source, file, made, pos,
value): ``made`` is the identity of the file under its path (device and inode),
``pos`` the byte at which a line starts.  The offset is, for each path, that
identity and the byte up to which whole lines were read: a line whose end is not
there yet waits for the next batch, and a file that is not there yet is taken up
once it is; with option ``wait`` the stream fails if none is after so many
seconds.  Where a path has got another file, the old one is read to its end
first, under whatever name it has in its folder now, then the new one from its
start; a file that is shorter than before is read anew.  What was rotated out of
the folder, or renamed while no stream ran and no file stood in its place, is
lost with a warning.  The driver looks only at the ends of files; executors read
the bytes, a long stretch in several tasks, short ones of many files in one.
"""

from __future__ import annotations

import glob
import json
import logging
import os
import time
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes and stretches that one task reads; a batch with more has more tasks.
TASK_BYTES, TASK_STRETCHES = 16 << 20, 256
#: Rows that a task hands to Spark at a time.
BATCH_ROWS = 1 << 13
BLOCK = 1 << 16
#: Bytes at the end of a file that are looked at first for a line end.
LOOK = 1 << 12


class Stretch(InputPartition):
    """Lines of ``file``, as it was ``made``, that start in [start, end); lines end at ``stop`` at the latest."""

    def __init__(self, file: str, start: int, end: int, stop: int, made: str | None = None):
        super().__init__((file, made, start))
        self.file, self.start, self.end, self.stop, self.made = file, start, end, stop, made


class Stretches(InputPartition):
    """What one task reads, in order."""

    def __init__(self, parts: list[Stretch]):
        super().__init__((parts[0].value, len(parts)))
        self.parts = parts


def grouped(parts: Iterable[Stretch], most_bytes: int, most: int = TASK_STRETCHES) -> list[Stretches]:
    """Stretches one after the other in groups of at most ``most`` and, where that is more than one, ``most_bytes``."""
    out, own, size = [], [], 0
    for part in parts:
        if own and (len(own) == most or size + part.end - part.start > most_bytes):
            out.append(Stretches(own))
            own, size = [], 0
        own.append(part)
        size += part.end - part.start
    return [*out, Stretches(own)] if own else out


def identity(file: str) -> str:
    found = os.stat(file)
    return f"{found.st_dev}:{found.st_ino}"


def _names(file: str) -> Iterator[str]:
    """That path, and only if it does not do, the others in its folder."""
    yield file
    yield from sorted(glob.glob(os.path.join(glob.escape(os.path.dirname(file)), "*")))


def where_is(file: str, made: str | None) -> str | None:
    """The path at which a file stands now that was tailed as ``file``: that path, or another name in its folder."""
    for path in _names(file):
        try:
            if made is None or identity(path) == made:
                return path
        except OSError:  # it goes while we look
            continue
    return None


def last_line_end(file: str) -> int:
    """The byte after the last line end, or 0."""
    end, look = os.path.getsize(file), LOOK
    with open(file, "rb") as f:
        while end > 0:
            low, look = max(0, end - look), BLOCK
            f.seek(low)
            at = f.read(end - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
    return 0


def _text(line: bytes) -> str:
    return line.rstrip(b"\r\n").decode("utf-8", "replace")


def lines_of(part: Stretch) -> Iterator[tuple[int, str]]:
    """(pos, line) of the lines that start in the stretch."""
    path = where_is(part.file, part.made)
    if path is None:
        logging.getLogger(__name__).warning("%s is gone: bytes %d to %d are lost", part.file, part.start, part.end)
        return
    with open(path, "rb") as f:
        at = part.start
        if at:
            f.seek(at - 1)
            if f.read(1) != b"\n":  # inside a line: it belongs to the stretch before
                at += len(f.readline())
        f.seek(at)
        while at < part.end:
            line = f.readline()
            if not line or at + len(line) > part.stop:
                return
            yield at, _text(line)
            at += len(line)


def line_after(file: str, made: str | None, pos: int, prev: str | None, near: int = BLOCK) -> tuple[str | None, int]:
    """(the line that now follows the line ``prev``, bytes read): ``pos`` is where it started when it was read.

    One stretch of at most ``near`` bytes before and after ``pos`` is read.  Without
    ``prev`` it is the line at ``pos``; None where there is no whole line.
    """
    path = where_is(file, made)
    if path is None:
        return None, 0
    low = max(0, pos - near)
    with open(path, "rb") as f:
        f.seek(low)
        data = f.read(pos - low + near)
    at = pos - low
    if prev is not None:
        before = prev.encode()
        found = [i for end in (b"\n", b"\r\n") if (i := data.rfind(before + end, 0, at + len(before) + 2)) >= 0 and (i == 0 and low == 0 or data[i - 1 : i] == b"\n")]
        if not found:
            return None, len(data)
        at = data.index(b"\n", max(found)) + 1
    end = data.find(b"\n", at)
    return (_text(data[at:end]) if end >= 0 else None), len(data)


def _ends(offset: dict) -> dict[str, tuple[str | None, int]]:
    return {f: tuple(x) if isinstance(x, list) else (None, x) for f, x in json.loads(offset["files"]).items()}


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.patterns = [p.strip() for p in options["paths"].split(",")]
        self.task = int(options.get("taskbytes", TASK_BYTES))
        self.wait = float(options.get("wait", 0))
        self.began, self.known = time.monotonic(), {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for file in (f for pattern in self.patterns for f in glob.glob(pattern)):
            try:
                if self.known.get(file) != [made := identity(file), os.path.getsize(file)]:  # else it has nothing new
                    self.known[file] = [made, last_line_end(file)]
            except FileNotFoundError:  # it goes while we look: what was known of it stays
                continue
        if not self.known and self.wait and time.monotonic() - self.began > self.wait:
            raise TimeoutError(f"no file at {', '.join(self.patterns)} after {self.wait:g} seconds")
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        low, out = _ends(start), []

        def add(file: str, made: str | None, at: int, stop: int) -> None:
            out.extend(Stretch(file, i, min(i + self.task, stop), stop, made) for i in range(at, stop, self.task))

        for file, (made, stop) in _ends(end).items():
            old, at = low.get(file, (made, 0))
            if old is not None and old != made:
                path = where_is(file, old)
                if path is None:
                    logging.getLogger(__name__).warning("%s was replaced and the old file is gone from byte %d on", file, at)
                else:
                    add(file, old, at, last_line_end(path))
            add(file, made, at if old in (None, made) and at <= stop else 0, stop)
        return grouped(out, self.task)

    def read(self, partition: Stretches):
        for part in partition.parts:
            source = os.path.basename(os.path.dirname(part.file))
            for pos, line in lines_of(part):
                yield source, part.file, part.made, pos, line

    def commit(self, end: dict) -> None:
        pass


class BatchReader(TailReader):
    """The same rows in Arrow batches, which Spark takes as they are."""

    def read(self, partition: Stretches):
        rows = super().read(partition)
        while own := list(islice(rows, BATCH_ROWS)):
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*own), kinds)], names=["source", "file", "made", "pos", "value"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "source string, file string, made string, pos long, value string"

    def streamReader(self, schema) -> TailReader:
        return BatchReader(self.options)


def tail(spark, paths: str, **options):
    """A streaming frame over the files at ``paths``."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("paths", paths).options(**options).load()


def replay(lines, target: str, delay_s: float = 0.0) -> None:
    """Append ``lines`` to a file one by one: a live log for demonstrations and tests."""
    with open(target, "a") as f:
        for line in lines:
            f.write(line.rstrip("\n") + "\n")
            f.flush()
            time.sleep(delay_s)
