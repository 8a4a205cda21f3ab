"""A streaming source of files that delivers a file again, whole, whenever it changes.

Spark's own file stream knows new files only. Here an offset stands for a
listing (path, size, time of change) of the folder; between two offsets every file whose
entry is new or differs is delivered, in input partitions of about ``partitionBytes`` bytes. A file that has
not changed is never read. Deleted files are not delivered; when they come back they are new.

Listings are kept as files of the ``state`` folder, written before their offset is
used, and the offset is their number, so logs stay small and a restart plans the same batch. A listing that equals the last one makes no new
offset. A file that changes again after it was listed is delivered as it then is, and once more by the next
listing. Listings that a commit has passed are deleted but for the last.

Rows are the file's lines (``format`` ``lines``: path, modified in ms, size, line from 0, value) or the whole file as one row
(``whole``; line is 0). Bytes that are no UTF-8 become U+FFFD. An empty file has no lines, and one empty value as a whole.

Options: ``path`` and ``state`` (URIs that driver and executors reach), ``pattern`` and ``exclude`` (globs of
relative paths, by commas; ``**/`` any folders), ``format``, ``partitionBytes``, ``maxFiles`` of a batch (0: all).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .readers import glob_regex

SCHEMA = "path string, modified long, size long, line int, value string"


def file_system(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int, int]]  # path, modified, size

    def __post_init__(self):
        super().__init__(None)


def changed(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, int, int]]:
    """Files of the new listing that the old one does not have like this."""
    return [(p, *entry) for p, entry in sorted(new.items()) if old.get(p) != entry]


def dealt(files: list[tuple[str, int, int]], most: int) -> list[Files]:
    """Runs of files of about ``most`` bytes; a larger file is alone."""
    out: list[list] = []
    size = 0
    for f in files:
        if not out or size + f[2] > most:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f[2]
    return [Files(run) for run in out]


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.fs, self.root = file_system(options["path"])
        self.root = self.root.rstrip("/")
        self.state_fs, self.state = file_system(options["state"])
        split = lambda name: [re.compile(glob_regex(g)) for g in options.get(name, "").split(",") if g]
        self.include, self.exclude = split("pattern"), split("exclude")
        self.lines = options.get("format", "lines") == "lines"
        self.most, self.files = int(options.get("partitionBytes", str(64 << 20))), int(options.get("maxFiles", "0"))
        self.last: tuple[int, dict] | None = None

    def listing(self) -> dict[str, list[int]]:
        from pyarrow import fs

        out = {}
        for f in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            name = f.path[len(self.root) :].lstrip("/")
            if f.type == fs.FileType.File and (not self.include or any(p.match(name) for p in self.include)) and not any(p.match(name) for p in self.exclude):
                out[f.path] = [(f.mtime_ns or 0) // 1_000_000, f.size]
        return out

    # listings by number

    def _place(self, n: int) -> str:
        return f"{self.state.rstrip('/')}/listing-{n:012}.json"

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        found = self.state_fs.get_file_info(fs.FileSelector(self.state, allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := re.search(r"/listing-(\d+)\.json$", f.path)))

    def _load(self, n: int) -> dict[str, list[int]]:
        if n == 0:
            return {}
        if self.last is None or self.last[0] != n:
            with self.state_fs.open_input_stream(self._place(n)) as f:
                self.last = (n, json.loads(f.read()))
        return self.last[1]

    def _save(self, n: int, listing: dict) -> None:
        self.state_fs.create_dir(self.state, recursive=True)
        part = f"{self._place(n)}.part"
        with self.state_fs.open_output_stream(part) as f:
            f.write(json.dumps(listing).encode())
        self.state_fs.move(part, self._place(n))
        self.last = (n, listing)

    # the stream

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        numbers = self._numbers()
        n = numbers[-1] if numbers else 0
        known, now = self._load(n), self.listing()
        if now == known:
            return {"listing": n}
        if self.files:  # the other changes wait for the next listing
            take = {p for p, *_ in changed(known, now)[: self.files]}
            now = {p: (e if p in take or known.get(p) == e else known[p]) for p, e in now.items() if p in take or p in known}
        self._save(n + 1, now)
        return {"listing": n + 1}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        old = dict(self._load(start["listing"]))
        return dealt(changed(old, self._load(end["listing"])), self.most)

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["listing"] - 1:
                self.state_fs.delete_file(self._place(n))

    def read(self, part: Files) -> Iterator[tuple]:
        for path, modified, size in part.paths:
            try:
                with self.fs.open_input_stream(path) as f:
                    if not self.lines:
                        yield path, modified, size, 0, f.read().decode("utf-8", "replace")
                        continue
                    # a block at a time: long files are never whole in memory
                    rest, k = b"", 0
                    while block := f.read(1 << 20):
                        *full, rest = (rest + block).split(b"\n")
                        for line in full:
                            yield path, modified, size, k, line.removesuffix(b"\r").decode("utf-8", "replace")
                            k += 1
                    if rest:
                        yield path, modified, size, k, rest.removesuffix(b"\r").decode("utf-8", "replace")
            except FileNotFoundError:
                continue  # gone since it was listed


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ListingReader(self.options)


def changed_files(spark: SparkSession, path: str, state: str, **options) -> DataFrame:
    """The stream of changed files below ``path``; ``state`` belongs to one query, like its checkpoint."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").options(path=path, state=state, **{k: str(v) for k, v in options.items()}).load()
