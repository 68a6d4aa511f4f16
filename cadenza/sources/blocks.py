"""Files as fixed-size blocks of bytes: one splittable Spark source for all raw formats, and one file written by many tasks.

A format says where its blocks start and how large they are; a split is a run of whole blocks, read by seeking, so that a
file of any size is dealt over the cluster and no row is larger than a block. Paths are local or mounted, or URIs of file systems
that Arrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import contextlib
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "file int, block long, raw binary"
FOLLOWED = "file string, block long, raw binary"  # of a stream, whose files have no numbers


def opened(path: str):
    """A seekable Arrow file of a path or URI."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def head_of(path: str, size: int = 1 << 16) -> tuple[bytes, int]:
    """The first bytes of a file, and its length."""
    with opened(path) as f:
        return f.read(size), f.size()


class Split(InputPartition):
    def __init__(self, file: int | str, path: str, start: int, size: int, first: int, count: int, end: int, overlap: int = 0) -> None:
        super().__init__((file, path, start, size, first, count, end, overlap))


def blocks_of(partition: Split | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    if partition is None:  # no file has a block
        return
    file, path, start, size, first, count, end, overlap = partition.value
    with opened(path) as f:
        for block in range(first, first + count):
            f.seek(start + block * size)
            raw = f.read(min(size + overlap, end - start - block * size))
            yield pa.RecordBatch.from_arrays([pa.array([file], kind), pa.array([block], pa.int64()), pa.array([raw], pa.binary())], ["file", "block", "raw"])


class BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.split, self.overlap = json.loads(options["files"]), int(options.get("split", 64 << 20)), int(options.get("overlap", 0))

    def partitions(self) -> list[Split]:
        out = []
        for k, f in enumerate(self.files):
            total, each = -(-max(0, f["end"] - f["start"]) // f["size"]), max(1, self.split // f["size"])
            out += [Split(k, f["path"], f["start"], f["size"], at, min(each, total - at), f["end"], self.overlap) for at in range(0, total, each)]
        return out

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        return blocks_of(partition, pa.int32())


class Follower(DataSourceStreamReader):
    """Blocks of the files of a folder as they grow: the offset is the number of whole blocks of each file by name, so a partial last one waits.

    Offsets are in Spark's checkpoint: a restart goes on behind the last batch that was planned. A batch takes all that has come, cut into splits.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.start, self.size = options["folder"].rstrip("/"), int(options.get("start", 0)), int(options["size"])
        self.suffix, self.split = options.get("suffix", ""), int(options.get("split", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, inner = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        files = (f for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and not f.base_name.startswith("."))
        return {f.base_name: max(0, (f.size or 0) - self.start) // self.size for f in files}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        each, out = max(1, self.split // self.size), []
        for name, blocks in sorted(end.items()):
            path = f"{self.folder}/{name}"
            out += [Split(path, path, self.start, self.size, at, min(each, blocks - at), self.start + blocks * self.size) for at in range(start.get(name, 0), blocks, each)]
        return out

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        return blocks_of(partition, pa.string())

    def commit(self, end: dict) -> None:
        """Nothing is held for blocks that were given out."""


class BlockSource(DataSource):
    """spark.read.format("cadenza_blocks").option("files", json of [{path, start, size, end}]).load()"""

    @classmethod
    def name(cls) -> str:
        return "cadenza_blocks"

    def schema(self) -> str:
        return FOLLOWED if "folder" in self.options else SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))

    def streamReader(self, schema) -> Follower:
        return Follower(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(dict(self.options))


def read_blocks(spark: SparkSession, files: list[tuple[str, int, int, int]], split: int = 64 << 20, overlap: int = 0) -> DataFrame:
    """(file, block, raw) of files (path, start, size, end): blocks of size bytes from start on, with the ``overlap`` bytes behind each, which the next one has
    again; the last may be shorter."""
    spark.dataSource.register(BlockSource)
    named = [dict(zip(("path", "start", "size", "end"), f)) for f in files]
    return spark.read.format("cadenza_blocks").option("files", json.dumps(named)).option("split", split).option("overlap", overlap).load()


def follow_blocks(spark: SparkSession, folder: str, size: int, start: int = 0, suffix: str = "", split: int = 64 << 20) -> DataFrame:
    """A stream of (file, its path, block, raw) of the files of a folder, whole blocks of ``size`` bytes behind ``start`` bytes of head, as they are written;
    new files join."""
    spark.dataSource.register(BlockSource)
    options = {"folder": folder, "size": size, "start": start, "suffix": suffix, "split": split}
    return spark.readStream.format("cadenza_blocks").options(**options).load()


class Placed(WriterCommitMessage):
    def __init__(self, written: int) -> None:
        self.written = written


class BlockWriter(DataSourceArrowWriter):
    """Blocks at their places in one file, beside the target until the job commits.

    A task that runs again writes the same bytes again. The driver writes the head and the tail, sets the length and gives the file its name once all
    tasks have reported and no block is missing; a job that fails leaves the target as it was.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.size, self.length = options["path"], int(options["size"]), int(options["length"])
        self.head, self.tail = (base64.b64decode(options.get(c, "")) for c in ("head", "tail"))
        self.written = int(options.get("written", self.length))
        folder, name = os.path.split(os.path.abspath(self.path))
        self.beside = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Placed:
        done, f = 0, None
        try:
            for batch in iterator:
                for block, raw in zip(batch.column("block").to_pylist(), batch.column("raw").to_pylist()):
                    f = f or os.fdopen(os.open(self.beside, os.O_RDWR | os.O_CREAT, 0o644), "r+b")
                    f.seek(len(self.head) + block * self.size)
                    done += f.write(raw)
        finally:
            if f is not None:
                f.close()
        return Placed(done)

    def commit(self, messages: list[Placed | None]) -> None:
        done = sum(m.written for m in messages if m is not None)
        if done != self.written:
            self.abort(messages)
            raise OSError(f"{done} bytes were written instead of {self.written}")
        with os.fdopen(os.open(self.beside, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
            f.write(self.head)
            f.truncate(len(self.head) + self.length)
            f.seek(len(self.head) + self.length)
            f.write(self.tail)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.beside, self.path)

    def abort(self, messages: list[Placed | None]) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(self.beside)


def write_in_place(blocks: DataFrame, path: str, head: bytes, size: int, length: int, tail: bytes = b"", written: int | None = None) -> None:
    """Writes (block, raw) of ``size`` bytes each, ``length`` in all, behind a head into one file on a mounted path.

    Tasks write each block at its own place, so the data never pass through the driver. The file appears whole or not at all. Blocks that are missing
    are zeros where ``written``, the bytes that blocks hold in all, allows for them.
    """
    blocks.sparkSession.dataSource.register(BlockSource)
    options = {"path": path, "size": size, "length": length, "head": base64.b64encode(head).decode(), "tail": base64.b64encode(tail).decode()}
    options |= {} if written is None else {"written": written}
    blocks.select("block", "raw").write.format("cadenza_blocks").options(**options).mode("append").save()
