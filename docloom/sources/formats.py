"""Formats for spark.read and DataFrame.write: Arrow IPC files by record batch, tar shards by ranges of samples.

    register(spark)
    spark.read.format("arrow_ipc").schema("id string, image string").load("/data/train/*.arrow")
    spark.read.format("tar_samples").load("/data/shards/*.tar")
    df.write.format("arrow_by_usage").mode("append").save("/data/split")

A reader plans its partitions from what files say about themselves (an Arrow footer, tar headers) and each task reads its
own part, so no file has to fit in a value or a task. Of Arrow files only the columns of the schema are read.
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from .files import opened

#: Bytes of a shard that a task reads, about; bytes of samples that it holds.
SPLIT, HELD = 1 << 26, 1 << 24
#: Files whose footers or headers are read at once while planning.
READERS = 16
USAGES = ("train", "validation", "test")


def register(spark: SparkSession) -> None:
    for source in (ArrowFiles, TarSamples, ArrowByUsage):
        spark.dataSource.register(source)


def found(path: str) -> list[str]:
    """The files that a path names: a file, all files below a folder, or those of a folder that a pattern fits."""
    system, at = opened(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else path.partition("://")[0] + "://"
    if any(c in at for c in "*?["):
        folder, _, pattern = at.rpartition("/")
        held = [f.path for f in system.get_file_info(fs.FileSelector(folder or "/")) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
    elif system.get_file_info(at).type == fs.FileType.Directory:
        held = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    else:
        held = [at]
    return sorted(prefix + p for p in held)


@dataclass
class Batches(InputPartition):
    """Record batches of an Arrow file from first up to last; a stream, which has no footer, is read whole (last None)."""

    path: str
    first: int = 0
    last: int | None = None


class ArrowFiles(DataSource):
    """Rows of Arrow IPC files (or streams). Option ``batches``: record batches that a task reads, 1 unless given."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        files = found(self.options["path"])
        if not files:
            raise ValueError(f"no files: {self.options['path']}")
        system, at = opened(files[0])
        with system.open_input_file(at) as data:
            try:
                return from_arrow_schema(pa.ipc.open_file(data).schema)
            except pa.ArrowInvalid:
                data.seek(0)
                return from_arrow_schema(pa.ipc.open_stream(data).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrowReader(self.options["path"], schema, int(self.options.get("batches", "1")))


class _ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, batches: int):
        self.path, self.wanted, self.batches = path, schema, batches

    def partitions(self) -> list[Batches]:
        def of(path: str) -> list[Batches]:
            system, at = opened(path)
            with system.open_input_file(at) as data:
                try:
                    n = pa.ipc.open_file(data).num_record_batches
                except pa.ArrowInvalid:
                    return [Batches(path)]
            return [Batches(path, k, min(n, k + self.batches)) for k in range(0, n, self.batches)]

        with ThreadPoolExecutor(READERS) as pool:
            return list(itertools.chain.from_iterable(pool.map(of, found(self.path)))) or [Batches("")]

    def read(self, part: Batches) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        wanted = to_arrow_schema(self.wanted)
        system, at = opened(part.path)
        with system.open_input_file(at) as data:
            if part.last is None:
                held: Iterator[pa.RecordBatch] = iter(pa.ipc.open_stream(data))
            else:
                names = pa.ipc.open_file(data).schema.names
                own = sorted(names.index(f.name) for f in wanted if f.name in names)
                reader = pa.ipc.open_file(data, options=pa.ipc.IpcReadOptions(included_fields=own))
                held = (reader.get_batch(k) for k in range(part.first, part.last))
            for b in held:
                columns = [b.column(f.name).cast(f.type) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)


@dataclass
class Range(InputPartition):
    """The bytes of a shard from start up to end; end None: to its end."""

    path: str
    start: int = 0
    end: int | None = None


class _Part(io.RawIOBase):
    """Reads a file from its place up to end."""

    def __init__(self, data: pa.NativeFile, left: int):
        self.data, self.left = data, left

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        got = self.data.read(self.left if size < 0 else min(size, self.left))
        self.left -= len(got)
        return got


def _key(name: str) -> str:
    return name.rpartition("/")[2].partition(".")[0]


class TarSamples(DataSource):
    """(shard, key, json, jpg) of tar shards: neighbouring members of one key are one sample.

    A shard is parted where a sample ends, about every ``split`` bytes (option); compressed shards are read whole.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_samples"

    def schema(self) -> str:
        return "shard string, key string, json string, jpg binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TarReader(self.options["path"], schema, int(self.options.get("split", str(SPLIT))))


class _TarReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int):
        self.path, self.wanted, self.split = path, schema, split

    def _ranges(self, path: str) -> list[Range]:
        """Follows the headers, which say how far the next one is; contents are not read."""
        system, at = opened(path)
        if system.get_file_info(at).size <= self.split:
            return [Range(path)]
        cuts, last = [0], None
        with system.open_input_file(at) as data:
            try:
                with tarfile.open(fileobj=data, mode="r:") as tar:
                    for m in tar:
                        key = _key(m.name)
                        if m.isfile() and last is not None and key != last and m.offset - cuts[-1] >= self.split:
                            cuts.append(m.offset)
                        last = key if m.isfile() else last
                        tar.members = []  # else all headers are held
            except tarfile.ReadError:
                return [Range(path)]
        return [Range(path, a, b) for a, b in itertools.zip_longest(cuts, cuts[1:])]

    def partitions(self) -> list[Range]:
        with ThreadPoolExecutor(READERS) as pool:
            return list(itertools.chain.from_iterable(pool.map(self._ranges, found(self.path)))) or [Range("")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        wanted = to_arrow_schema(self.wanted)
        system, at = opened(part.path)
        rows: list[dict] = []
        size = 0
        with system.open_input_file(at) as data:
            data.seek(part.start)
            stream = _Part(data, (data.size() if part.end is None else part.end) - part.start)
            with tarfile.open(fileobj=stream, mode="r|*" if part.end is None and not part.start else "r|") as tar:
                members = ((m.name.rpartition("/")[2].partition("."), tar.extractfile(m).read()) for m in tar if m.isfile())
                for key, own in itertools.groupby(members, lambda x: x[0][0]):
                    held = {name[2]: content for name, content in own}
                    rows.append({"shard": part.path, "key": key, "json": held["json"].decode("utf-8", "replace") if "json" in held else None, "jpg": held.get("jpg")})
                    size += sum(map(len, held.values()))
                    if size >= HELD:
                        yield pa.RecordBatch.from_pylist(rows, wanted)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, wanted)


@dataclass
class Written(WriterCommitMessage):
    """(staged, final) paths of a task's files."""

    files: list[tuple[str, str]]


class ArrowByUsage(DataSource):
    """Writes Arrow IPC files below train, validation and test, by the column ``usage`` (left out of the files).

    Tasks write to a folder aside; only when all have ended are files moved into place. If one fails nothing is left.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_by_usage"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("arrow_by_usage adds to a folder; it does not overwrite one")
        return _UsageWriter(self.options["path"].rstrip("/"), self.options.get("usage", "usage"))


class _UsageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, usage: str):
        self.path, self.usage, self.aside = path, usage, f"{path}/_aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.arrow"
        system, aside = opened(self.aside)
        open_files: dict[str, tuple[pa.NativeFile, pa.ipc.RecordBatchFileWriter]] = {}
        try:
            for b in iterator:
                usage = b.column(self.usage)
                rest = b.select([n for n in b.schema.names if n != self.usage])
                for kind in usage.unique().to_pylist():
                    if kind not in USAGES:
                        raise ValueError(f"unknown usage: {kind}")
                    if kind not in open_files:
                        system.create_dir(f"{aside}/{kind}", recursive=True)
                        out = system.open_output_stream(f"{aside}/{kind}/{name}")
                        open_files[kind] = out, pa.ipc.new_file(out, rest.schema)
                    open_files[kind][1].write_batch(rest.filter(pa.compute.equal(usage, kind)))
        finally:
            for out, writer in open_files.values():
                writer.close()
                out.close()
        return Written([(f"{aside}/{kind}/{name}", kind) for kind in open_files])

    def commit(self, messages: list[Written | None]) -> None:
        system, top = opened(self.path)
        _, aside = opened(self.aside)
        run = self.aside.rpartition("-")[2][:8]
        for source, kind in (f for m in messages if m for f in m.files):
            system.create_dir(f"{top}/{kind}", recursive=True)
            system.move(source, f"{top}/{kind}/{run}-{source.rpartition('/')[2]}")
        self._clear(system, aside)

    def abort(self, messages: list[Written | None]) -> None:
        system, aside = opened(self.aside)
        self._clear(system, aside)

    @staticmethod
    def _clear(system: fs.FileSystem, aside: str) -> None:
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)
