"""Folders of a remote store, listed page by page: a batch source and a stream of what is new.

A folder's pages are JSON objects with ``entries`` (id, type, name, size) and, if there are more, ``next_marker``. Each
listed folder is one partition, so folders are read side by side and a page at a time. A folder that cannot be read gives
one row with ``error``; the others go on.

    spark.dataSource.register(PagedListing)
    spark.read.format("paged_listing").option("base", base).option("folders", "a,b").load()

As a stream the offset names a snapshot: a batch lists its folders, keeps what it saw below ``snapshots``, a folder that
driver and executors share, and gives the entries whose id the snapshot before did not have. A repeated batch reads the
snapshot that its first attempt kept. Renamed entries keep their id and are not new; removed ones are not reported.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "folder string, id string, type string, name string, size long, depth int, path string, error string"
#: A listing that goes on for longer repeats its markers.
MOST_PAGES = 100_000


def file_page(base: str, folder: str, marker: str | None) -> dict:
    """A page of a folder that is kept as files: ``base/folder/start.json``, further ones by their marker."""
    return json.loads(Path(base, folder, f"{marker or 'start'}.json").read_text(encoding="utf-8"))


def pages(base: str, folder: str, fetch=file_page) -> Iterator[dict]:
    """Entries of a folder over all its pages."""
    marker, seen = None, set()
    for _ in range(MOST_PAGES):
        page = fetch(base, folder, marker)
        yield from page.get("entries") or []
        marker = page.get("next_marker")
        if not marker:
            return
        if marker in seen:
            raise ValueError(f"folder {folder}: marker {marker!r} comes again")
        seen.add(marker)
    raise ValueError(f"folder {folder}: more than {MOST_PAGES} pages")


def walk(base: str, root: str, most_depth: int, fetch=file_page) -> Iterator[tuple]:
    """Rows of SCHEMA below a folder; folders inside are opened down to ``most_depth`` levels below it."""
    todo = [(root, "", 0)]
    while todo:
        folder, path, depth = todo.pop()
        try:
            for e in pages(base, folder, fetch):
                at = f"{path}/{e.get('name') or ''}"
                yield root, str(e["id"]), e.get("type"), e.get("name"), int(e.get("size") or 0), depth, at, None
                if e.get("type") == "folder" and depth < most_depth:
                    todo.append((str(e["id"]), at, depth + 1))
        except (OSError, ValueError, KeyError, TypeError) as problem:
            yield root, folder, "folder", None, None, depth, path, f"{type(problem).__name__}: {problem}"


class Folder(InputPartition):
    def __init__(self, folder: str, start: int = 0, end: int = 0):
        self.folder, self.start, self.end = folder, start, end


class PagedListing(DataSource):
    """Options: ``base``, ``folders`` (ids with commas between), ``depth`` (levels opened below them, 0), ``snapshots`` (streams)."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def fetch(self, base: str, folder: str, marker: str | None) -> dict:
        """A page; subclasses ask their store."""
        return file_page(base, folder, marker)

    def _asked(self) -> tuple[str, list[str], int]:
        folders = [f.strip() for f in self.options.get("folders", "").split(",") if f.strip()]
        if not folders or "base" not in self.options:
            raise ValueError("paged_listing needs the options base and folders")
        return self.options["base"], folders, int(self.options.get("depth", "0"))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._asked(), self.fetch)

    def streamReader(self, schema) -> DataSourceStreamReader:
        if "snapshots" not in self.options:
            raise ValueError("a stream of paged_listing needs the option snapshots")
        return _Stream(*self._asked(), self.fetch, self.options["snapshots"])


class _Batch(DataSourceReader):
    def __init__(self, base: str, folders: list[str], depth: int, fetch):
        self.base, self.folders, self.depth, self.fetch = base, folders, depth, fetch

    def partitions(self) -> list[Folder]:
        return [Folder(f) for f in self.folders]

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from walk(self.base, partition.folder, self.depth, self.fetch)


class _Stream(DataSourceStreamReader):
    def __init__(self, base: str, folders: list[str], depth: int, fetch, snapshots: str):
        self.base, self.folders, self.depth, self.fetch, self.snapshots = base, folders, depth, fetch, snapshots

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        return {"snapshot": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f, start["snapshot"], end["snapshot"]) for f in self.folders]

    def commit(self, end: dict) -> None:
        """Snapshots stay: the next batch is told apart from this one's, and a restart may ask for either."""

    def _kept(self, folder: str, number: int) -> list[list]:
        path = Path(self.snapshots, folder, f"{number}.json")
        return json.loads(path.read_text(encoding="utf-8")) if path.exists() else []

    def read(self, partition: Folder) -> Iterator[tuple]:
        before = self._kept(partition.folder, partition.start)
        path = Path(self.snapshots, partition.folder, f"{partition.end}.json")
        if not path.exists():
            rows = [list(r) for r in walk(self.base, partition.folder, self.depth, self.fetch)]
            shut = {r[1] for r in rows if r[7] is not None}
            # what an unreadable folder held is still known
            gone = [r for r in before if r[7] is None and shut and r[1] not in {x[1] for x in rows}]
            path.parent.mkdir(parents=True, exist_ok=True)
            part = path.with_suffix(f".{uuid.uuid4().hex}")
            part.write_text(json.dumps(rows + gone), encoding="utf-8")
            os.replace(part, path)
        known = {r[1] for r in before if r[7] is None}
        for row in self._kept(partition.folder, partition.end):
            if row[7] is not None or row[1] not in known:
                yield tuple(row)
