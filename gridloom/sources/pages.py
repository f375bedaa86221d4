"""Paged rectangle files as a data source: 64-byte pages, read by ranges of pages and written by tasks with a commit.

A file is a header page with the int32 count, then pages of three records (int32 id, four float32 sides), zeros after the
last. Files are opened by pyarrow's file systems (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PAGE, PER_PAGE = 64, 3
#: Pages that one task reads unless the option pages_per_task says otherwise, and that it holds at once.
PER_TASK, AT_ONCE = 1 << 20, 1 << 16
SIDES = ("low0", "high0", "low1", "high1")
RECORD = np.dtype([("id", "<i4"), *((c, "<f4") for c in SIDES)])


def opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    head, _, pattern = path.partition("*")  # a pattern's stars are no part of an address
    system, at = fs.FileSystem.from_uri(head)
    return system, at + ("/" if head.endswith("/") and not at.endswith("/") else "") + (f"*{pattern}" if "*" in path else "")


def files(path: str) -> list[tuple[str, int]]:
    """Files of a path and their sizes: of a folder those not hidden, of a pattern in the last part those that fit."""
    from pyarrow import fs

    system, at = opened(path)
    if "*" in at:
        folder, pattern = posixpath.split(at)
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, pattern)]
    else:
        one = system.get_file_info(at)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [one] if one.is_file else [f for f in system.get_file_info(fs.FileSelector(at)) if f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in found if f.is_file)


@dataclass
class Pages(InputPartition):
    file: str
    first: int
    count: int


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per_task = options["path"], int(options.get("pages_per_task", PER_TASK))

    def partitions(self) -> list[Pages]:
        return [Pages(f, k, min(self.per_task, size // PAGE - 1 - k)) for f, size in files(self.path) for k in range(0, size // PAGE - 1, self.per_task)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.file) as f:
            n = int(np.frombuffer(f.read(4), "<i4")[0])
            for k in range(partition.first, partition.first + partition.count, AT_ONCE):
                f.seek(PAGE * (1 + k))
                raw = np.frombuffer(f.read(PAGE * min(AT_ONCE, partition.first + partition.count - k)), np.uint8)
                rows = np.frombuffer(raw.reshape(-1, PAGE)[:, : RECORD.itemsize * PER_PAGE].tobytes(), RECORD)[: max(0, n - PER_PAGE * k)]
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"].astype(np.int64)), *(pa.array(rows[c].astype(np.float64)) for c in SIDES)], ["id", *SIDES])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PageWriter(DataSourceArrowWriter):
    """Each task writes files under names of its attempt; commit gives those of the attempts that count their names."""

    def __init__(self, options):
        self.path, self.run = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        attempt, made, held = TaskContext.get().taskAttemptId(), [], []

        def close(number: int) -> None:
            table = pa.Table.from_batches(held)
            rows = np.zeros(table.num_rows, RECORD)
            for c in ("id", *SIDES):
                rows[c] = table.column(c).to_numpy()
            if (rows["id"] != table.column("id").to_numpy()).any():
                raise ValueError("an id exceeds 32 bits")
            pages = np.zeros((-(-len(rows) // PER_PAGE), PAGE), np.uint8)
            size = RECORD.itemsize * PER_PAGE
            pages[:, :size] = np.frombuffer(rows.tobytes().ljust(size * len(pages), b"\0"), np.uint8).reshape(-1, size)
            name = f"{at}/_{self.run}-{attempt}-{number}"
            with system.open_output_stream(name) as out:
                out.write(np.array([len(rows)], "<i4").tobytes().ljust(PAGE, b"\0"))
                out.write(pages.tobytes())
            made.append((name, f"{at}/part-{number:05d}.bin"))
            held.clear()

        current = None
        for batch in iterator:
            number = batch.column("file").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x:
                    if held and number[x] != current:
                        close(current)
                    current = int(number[x])
                    held.append(batch.slice(x, y - x))
        if held:
            close(current)
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            for name, final in m.files if m else ():
                system.move(name, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                system.delete_file(name)


class RectPages(DataSource):
    """spark.read.format("rect_pages").load(path): rows (id, SIDES). Written tables also have `file`, the number of each row's file."""

    @classmethod
    def name(cls) -> str:
        return "rect_pages"

    def schema(self) -> str:
        return "id long, low0 double, high0 double, low1 double, high1 double"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options)
