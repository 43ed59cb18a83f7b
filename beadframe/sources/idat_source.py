"""IDAT files as a Spark data source: ``spark.read.format("idat")`` and ``df.write.format("idat")``.

Reading has a partition a pair of files (or a few), so a study of any size is dealt over
tasks, and only its list of names is seen by the driver. Writing takes rows (path,
content): a task writes its files under names that no reader lists, and the commit on the
driver gives them their own; a job that fails leaves none.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .idat import NAME, ROWS, parse

BEADS = "sample_id string, address int, g double, r double, gn int, rn int"
FILES = "path string, content binary"
PENDING = "_pending-"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def content(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_file(path) as f:
        return f.read()


@dataclass
class Pairs(InputPartition):
    """(sample, green path, red path) of the pairs that a task reads."""

    pairs: list[tuple[str, str, str]]


class PairReader(DataSourceReader):
    def __init__(self, path: str, each: int, skip: bool):
        self.path, self.each, self.skip = path, each, skip

    def partitions(self) -> list[Pairs]:
        store, folder = located(self.path)
        found: dict[str, dict[str, list[str]]] = {}
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
            if info.type == fs.FileType.File and (m := re.match(NAME, info.path)):
                found.setdefault(m[1], {}).setdefault(m[2], []).append(info.path)
        # A sample with one file, or with two of a colour, is no pair.
        pairs = [(posixpath.basename(prefix), x["Grn"][0], x["Red"][0]) for prefix, x in sorted(found.items()) if {k: len(v) for k, v in x.items()} == {"Grn": 1, "Red": 1}]
        return [Pairs(pairs[i : i + self.each]) for i in range(0, len(pairs), self.each)] or [Pairs([])]

    def read(self, partition: Pairs) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        for sample, green, red in partition.pairs:
            try:
                g, r = parse(content(store, green)), parse(content(store, red))
            except (ValueError, KeyError, struct.error, OSError, EOFError):
                if self.skip:
                    continue
                raise
            address = g["address"]
            if np.array_equal(address, r["address"]) and (address[1:] > address[:-1]).all():
                at_g = at_r = np.arange(len(address))  # as files are, without the copies that a sort takes
            else:
                address, at_g, at_r = np.intersect1d(address, r["address"], return_indices=True)
            for at in range(0, max(1, len(address)), ROWS):
                sides, part = ((g, at_g[at : at + ROWS]), (r, at_r[at : at + ROWS])), address[at : at + ROWS]
                columns = [pa.array([sample] * len(part), pa.string()), pa.array(part, pa.int32()), *(pa.array(x["mean"][k].astype(float)) for x, k in sides),
                           *(pa.array(x["beads"][k].astype(np.int32)) for x, k in sides)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BEADS.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """(pending path, final name) of a task's files."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, folder = located(self.path)
        store.create_dir(folder, recursive=True)
        files = []
        for row in rows:
            pending = posixpath.join(folder, f"{PENDING}{self.job}-{uuid.uuid4().hex}")
            with store.open_output_stream(pending) as f:
                f.write(bytes(row["content"]))
            files.append((pending, posixpath.basename(row["path"])))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = located(self.path)
        files = [x for m in messages if m for x in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        if self.overwrite:
            old = [x.path for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if re.match(NAME, x.path)]
            for path in old:
                store.delete_file(path)
        for pending, name in files:
            store.move(pending, posixpath.join(folder, name))
        # What tasks that were lost or ran twice have left behind.
        self.sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self.sweep()

    def sweep(self) -> None:
        store, folder = located(self.path)
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if posixpath.basename(info.path).startswith(f"{PENDING}{self.job}"):
                store.delete_file(info.path)


class IdatSource(DataSource):
    """Options: ``path``; ``pairs``, pairs of files to a partition (1); ``damaged``, "fail" or "skip"."""

    @classmethod
    def name(cls) -> str:
        return "idat"

    def schema(self) -> str:
        return BEADS

    def reader(self, schema) -> PairReader:
        damaged = self.options.get("damaged", "fail")
        if damaged not in ("fail", "skip"):
            raise ValueError("damaged must be fail or skip")
        return PairReader(self.options["path"], int(self.options.get("pairs", 1)), damaged == "skip")

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("files are rows (path, content)")
        return FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(IdatSource)
