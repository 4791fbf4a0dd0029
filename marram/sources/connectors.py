"""Folders of calendars and of pages as data sources: `spark.read.format("marram_calendars").load(folder)`, and readStream alike.

A folder's files are dealt to partitions of about PART_BYTES; a file is never cut. A stream's offset is the last file that was taken, by time of change and then by
name, so each file comes once, in a batch with all that were there when the batch began. Files must be put in place whole, as by a rename.
Executors read them by themselves, so the folder must be one that all of them reach.
"""

from __future__ import annotations

import datetime as dt
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from marram.package import ship

PART_BYTES = 16 << 20


@dataclass
class Files(InputPartition):
    """The files that a task reads, in order."""

    paths: list[str]


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", uri) if ":/" in uri else f"file://{uri}")


def _listed(uri: str, suffixes: tuple[str, ...]) -> list[tuple[int, str, int]]:
    """(time of change, path, size) of a folder's files, by time and path; hidden ones are left out."""
    files, root = _folder(uri)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.is_file and f.base_name[0] not in "._" and f.base_name.lower().endswith(suffixes))


def _dealt(found: list[tuple[int, str, int]], most: int) -> list[Files]:
    parts: list[Files] = []
    size = 0
    for _, path, n in found:
        if not parts or size + n > most:  # the first file may be empty
            parts.append(Files([]))
            size = 0
        parts[-1].paths.append(path)
        size += n
    return parts


class _Reader:
    """What batch and stream share: the options, and the rows of a file."""

    def __init__(self, options: dict, suffixes: tuple[str, ...], rows) -> None:
        self.uri, self.suffixes, self.rows = options["path"], suffixes, rows
        self.most = int(options.get("partBytes", PART_BYTES))

    def rows_of(self, partition: Files) -> Iterator[tuple]:
        files, _ = _folder(self.uri)
        for path in partition.paths:
            with files.open_input_stream(path) as f:
                yield from self.rows(path, f.read().decode("utf-8", "replace"))


class _BatchReader(DataSourceReader):
    def __init__(self, reader: _Reader) -> None:
        self.reader = reader

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.reader.uri, self.reader.suffixes), self.reader.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.reader.rows_of(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, reader: _Reader) -> None:
        self.reader = reader

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = _listed(self.reader.uri, self.reader.suffixes)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = (start["time"], start["path"]), (end["time"], end["path"])
        return _dealt([x for x in _listed(self.reader.uri, self.reader.suffixes) if first < x[:2] <= last], self.reader.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.reader.rows_of(partition)


class _FolderSource(DataSource):
    suffixes: tuple[str, ...] = ()

    @staticmethod
    def rows(path: str, text: str) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(_Reader(self.options, self.suffixes, type(self).rows))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Reader(self.options, self.suffixes, type(self).rows))


def _day(value: str) -> dt.date | None:
    m = re.fullmatch(r"([0-9]{8})(?:T[0-9]{6}Z?)?", value)
    try:
        return dt.datetime.strptime(m[1], "%Y%m%d").date() if m else None
    except ValueError:
        return None


class CalendarSource(_FolderSource):
    """Calendars in `.ics` files, several in a file if need be: (unit_id, night, reason).

    unit_id is the calendar's X-WR-CALNAME, else the file's name without its ending. A row for each blocked night, once; a
    calendar with a malformed date gives one row with that reason and no nights. Events without both ends, or that end before they begin, block nothing."""

    suffixes = (".ics",)

    @classmethod
    def name(cls) -> str:
        return "marram_calendars"

    def schema(self) -> str:
        return "unit_id string, night date, reason string"

    @staticmethod
    def rows(path: str, text: str) -> Iterator[tuple]:
        text = re.sub("\n[ \t]", "", text.replace("\r\n", "\n"))
        for body in re.findall(r"(?s)BEGIN:VCALENDAR\n(.*?)END:VCALENDAR", text) or [text]:
            head = body.partition("BEGIN:VEVENT")[0]
            named = re.search(r"(?im)^X-WR-CALNAME(?:;[^:\n]*)?:[ \t]*(\S[^\n]*?)[ \t]*$", head)
            unit = named[1] if named else path.rpartition("/")[2].rpartition(".")[0]
            nights, bad = set(), False
            for event in re.findall(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT", body):
                ends = [re.search(rf"(?im)^{key}(?:;[^:\n]*)?:[ \t]*([^\n]*?)[ \t]*$", event) for key in ("DTSTART", "DTEND")]
                if all(m and m[1] for m in ends):
                    a, b = (_day(m[1]) for m in ends)
                    bad |= a is None or b is None
                    nights |= {a + dt.timedelta(n) for n in range((b - a).days)} if not bad else set()
            if bad:
                yield unit, None, "malformed date"
            else:
                yield from ((unit, night, None) for night in sorted(nights))


class PageSource(_FolderSource):
    """Pages in `.html` and `.htm` files: (url, html). url is the page's canonical link, else its place below the folder."""

    suffixes = (".html", ".htm")

    @classmethod
    def name(cls) -> str:
        return "marram_pages"

    def schema(self) -> str:
        return "url string, html string"

    @staticmethod
    def rows(path: str, text: str) -> Iterator[tuple]:
        tag = next((t for t in re.findall(r"(?i)<link\b[^>]*>", text) if re.search(r"""(?i)\brel\s*=\s*["']?canonical\b""", t)), "")
        link = re.search(r"""(?i)\bhref\s*=\s*["']([^"']+)["']""", tag)
        yield link[1] if link else f"file://{path}", text


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session. Spark plans their batches in Python of its own beside the driver, which gets nothing that
    was sent to executors, so the sources travel with their code."""
    ship(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (CalendarSource, PageSource):
        spark.dataSource.register(source)
