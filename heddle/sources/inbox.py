"""Requests of a messaging channel as a data source: what a gateway appends to files, read in batch and as a stream.

A gateway appends each request as one JSON line to a file under the day's folder, ``<root>/<YYYY-MM-DD>/<name>.jsonl``; files only grow. ``root`` is a folder that all workers mount. Files are cut into
byte ranges, each a partition, which starts with the first line that begins in it. Conditions on ``day`` are pushed into the listing of folders, the others stay with Spark. A line that
is no request becomes a row with ``error`` and the line as ``body``, and never stops a read.

The stream's offset is how many bytes of each file have been read, up to the last whole line. Days before the newest ``open_days`` are closed: their files are taken as they are and leave the
offset, so that it does not grow with the history.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "day date, file string, at long, request_id string, sender string, recipient string, body string, received_at timestamp, error string"


@dataclass
class Piece(InputPartition):
    """Bytes of a file: lines that begin at ``start`` or later, and before ``end``."""

    path: str
    day: str
    start: int
    end: int


def days(root: str) -> list[str]:
    return sorted(d for d in os.listdir(root) if len(d) == 10 and d[4] == d[7] == "-" and os.path.isdir(os.path.join(root, d))) if os.path.isdir(root) else []


def files(root: str, day: str) -> list[str]:
    return sorted(f for f in os.listdir(os.path.join(root, day)) if f.endswith(".jsonl"))


def whole(path: str, block: int = 65_536) -> int:
    """Bytes up to the end of the last whole line."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - block)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def pieces(path: str, day: str, start: int, end: int, size: int) -> list[Piece]:
    return [Piece(path, day, a, min(end, a + size)) for a in range(start, end, size)]


def request(line: bytes) -> tuple:
    """``(request_id, sender, recipient, body, received_at, error)`` of a line."""
    try:
        r = json.loads(line)
        if not isinstance(r, dict) or not isinstance(r.get("Body"), str):
            raise ValueError("no request")
        at = r.get("at")
        return (*(None if r.get(k) is None else str(r[k]) for k in ("id", "From", "To")), r["Body"], None if at is None else dt.datetime.fromisoformat(at).replace(tzinfo=dt.UTC), None)
    except (ValueError, TypeError) as e:
        return (None, None, None, line.decode("utf-8", "replace"), None, f"{type(e).__name__}: {e}"[:200])


def rows(piece: Piece | None) -> Iterator[tuple]:
    if piece is None:  # Spark's single task where there is nothing to read
        return
    day = dt.date.fromisoformat(piece.day)
    with open(piece.path, "rb") as f:
        if piece.start:
            f.seek(piece.start - 1)
            f.readline()  # the line that began before, or the rest of it
        at = f.tell()
        while at < piece.end and (line := f.readline()):
            if line.strip():
                yield (day, os.path.basename(piece.path), at, *request(line.rstrip(b"\r\n")))
            at += len(line)


class InboxReader(DataSourceReader):
    def __init__(self, root: str, size: int) -> None:
        self.root, self.size, self.tests = root, size, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and f.attribute == ("day",):
                self.tests.append(f)
            yield f  # Spark checks again: the listing only spares folders

    def _asked(self, day: dt.date) -> bool:
        for f in self.tests:
            v = f.value
            fits = day in v if isinstance(f, In) else day == v if isinstance(f, EqualTo) else day > v if isinstance(f, GreaterThan) else day >= v if isinstance(f, GreaterThanOrEqual) else day < v if isinstance(f, LessThan) else day <= v
            if not fits:
                return False
        return True

    def partitions(self) -> list[Piece]:
        out = []
        for day in days(self.root):
            if self._asked(dt.date.fromisoformat(day)):
                for name in files(self.root, day):
                    path = os.path.join(self.root, day, name)
                    out += pieces(path, day, 0, os.path.getsize(path), self.size)
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        return rows(partition)


class InboxStream(DataSourceStreamReader):
    def __init__(self, root: str, size: int, open_days: int) -> None:
        self.root, self.size, self.open_days = root, size, open_days

    def initialOffset(self) -> dict:
        return {"from": "", "files": {}}

    def latestOffset(self) -> dict:
        """Bytes of the files of open days; all of every earlier day."""
        open_ = days(self.root)[-self.open_days :]
        sizes = {f"{day}/{name}": whole(os.path.join(self.root, day, name)) for day in open_ for name in files(self.root, day)}
        return {"from": open_[0] if open_ else "", "files": sizes}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for day in days(self.root):
            if day < start["from"]:
                continue
            for name in files(self.root, day):
                key, path = f"{day}/{name}", os.path.join(self.root, day, name)
                upto = whole(path) if day < end["from"] else end["files"].get(key, 0)
                out += pieces(path, day, start["files"].get(key, 0), upto, self.size)
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        return rows(partition)

    def commit(self, end: dict) -> None:
        pass


class InboxSource(DataSource):
    """``spark.dataSource.register(InboxSource)``, then format ``inbox`` with options ``path``, ``piece_bytes`` and, for streams, ``open_days``."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("piece_bytes", 64 << 20))

    def reader(self, schema) -> InboxReader:
        return InboxReader(self.options["path"], self._size())

    def streamReader(self, schema) -> InboxStream:
        return InboxStream(self.options["path"], self._size(), int(self.options.get("open_days", 2)))
