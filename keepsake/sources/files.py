"""Data sources of Spark for what lies in files: ``spark.read.format("transcripts")`` and an all-or-nothing sink ``claims``.

``transcripts`` finds the files of a folder by kind and reads them a file a row, some files to a task:

* ``session``: projects/*/*.jsonl below the root, or any of them changed since option ``since``;
* ``memory``: the memory files, projects/*/memory/<name>, for the names of option ``memory``;
* ``instructions``: the files that option ``instructions`` names, in the root and in the folders of option
  ``also``, if they are smaller than 256 KiB.

Empty memory and instruction files are left out. Only names, sizes and times are looked up where the query is planned.

``claims`` takes rows as ``interchange.validated`` gives them. Tasks write Parquet to a folder of the job that no
reader looks into; when all have ended well, one rename makes it a part of the table, and otherwise it is removed. A row
with an ``error`` ends its task and so the whole import.

Paths are what pyarrow can open (local or shared folders, hdfs://, s3://); files in stores that only
Spark can reach are read by ``transcripts.discovered``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files and bytes that one task reads, unless a single file is larger; instruction files have to be smaller than the last.
FILES, BYTES, LARGEST = 256, 32 << 20, 256 * 1024
SCHEMA = "path string, kind string, modified timestamp, raw string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """(path, kind, seconds) of the files of one task."""

    files: list

    def __init__(self, files: list):
        super().__init__(None)
        self.files = files


class TranscriptReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def found(self) -> list[tuple[str, str, float, int]]:
        """(path, kind, modified, size) of the files that are asked for, by path."""
        root = self.options["path"]
        kinds = {k for k in self.options.get("kinds", "session,memory,instructions").replace(" ", "").split(",") if k}
        names = lambda option: {n for n in self.options.get(option, "").replace(" ", "").split(",") if n}
        fs, base = opened(root)
        base = base.rstrip("/")
        out = []

        def listed(folder: str, recursive: bool) -> list:
            return fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=recursive))

        def add(info, kind: str) -> None:
            out.append((info.path, kind, info.mtime.timestamp() if info.mtime else 0.0, info.size))

        since = self.options.get("since")
        least = datetime.fromisoformat(since).replace(tzinfo=timezone.utc).timestamp() if since else float("-inf")
        if kinds & {"session", "memory"}:
            for info in listed(f"{base}/projects", True):
                part = info.path[len(base) :].strip("/").split("/")
                if info.type != pafs.FileType.File:
                    continue
                if "session" in kinds and len(part) == 3 and part[2].endswith(".jsonl") and (info.mtime is None or info.mtime.timestamp() >= least):
                    add(info, "session")
                if "memory" in kinds and len(part) == 4 and part[2] == "memory" and part[3] in names("memory") and info.size:
                    add(info, "memory")
        if "instructions" in kinds:
            for folder in [root, *names("also")]:
                own = opened(folder)[1].rstrip("/")
                for info in listed(own, False):
                    if info.type == pafs.FileType.File and info.path.rsplit("/", 1)[-1] in names("instructions") and 0 < info.size < LARGEST:
                        add(info, "instructions")
        return sorted(set(out))

    def partitions(self) -> list[InputPartition]:
        groups, now, size = [], [], 0
        for path, kind, modified, n in self.found():
            if now and (len(now) >= FILES or size + n > BYTES):
                groups.append(Files(now))
                now, size = [], 0
            now.append((path, kind, modified))
            size += n
        return [*groups, Files(now)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.options["path"])
        for path, kind, modified in partition.files:
            with fs.open_input_stream(path) as f:
                raw = f.read().decode("utf-8", "replace")
            if kind == "session" or raw.strip():
                stamp = pa.array([int(modified * 1e6)], pa.timestamp("us", tz="UTC"))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kind]), stamp, pa.array([raw])], names=["path", "kind", "modified", "raw"])


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TranscriptReader:
        return TranscriptReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    rows: int


class Refused(ValueError):
    """A row has a fault, so nothing is imported."""


class ClaimWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, base = opened(self.path)
        context, rows, writer = TaskContext.get(), 0, None
        try:
            for batch in iterator:
                if "error" in batch.schema.names:
                    faults = batch.column("error").drop_null()
                    if len(faults):
                        raise Refused(faults[0].as_py())
                    batch = batch.drop_columns(["error"])
                if writer is None:
                    fs.create_dir(f"{base}/.job-{self.job}", recursive=True)
                    # named by the attempt, so that a task that is run again writes beside the first
                    writer = pq.ParquetWriter(f"{base}/.job-{self.job}/part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet", batch.schema, filesystem=fs)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(rows) if writer is None else Part(rows, f"part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet")

    def commit(self, messages: list) -> None:
        fs, base = opened(self.path)
        kept = {m.name for m in messages if isinstance(m, Part)}
        if not kept:
            return
        for info in fs.get_file_info(pafs.FileSelector(f"{base}/.job-{self.job}")):
            if info.path.rsplit("/", 1)[-1] not in kept:  # of an attempt that did not count
                fs.delete_file(info.path)
        fs.move(f"{base}/.job-{self.job}", f"{base}/import-{self.job}")

    def abort(self, messages: list) -> None:
        fs, base = opened(self.path)
        if fs.get_file_info(f"{base}/.job-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/.job-{self.job}")


@dataclass
class Part(Written):
    name: str


class Claims(DataSource):
    @classmethod
    def name(cls) -> str:
        return "claims"

    def schema(self) -> str:
        raise NotImplementedError("imports are read as Parquet: spark.read.parquet(path + '/import-*')")

    def writer(self, schema: StructType, overwrite: bool) -> ClaimWriter:
        if overwrite:
            raise ValueError("imports only append: claims are never deleted")
        return ClaimWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    spark.dataSource.register(Transcripts)
    spark.dataSource.register(Claims)
