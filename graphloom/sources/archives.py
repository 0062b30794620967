"""Archives as a data source: executors unpack ranges of entries, within limits, and nothing that leads outside."""

from __future__ import annotations

import io
import posixpath
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.sources import trees

SCHEMA = "path string, length long, content binary"
#: Bytes of entries, as unpacked, that a task takes; more only if one entry has more.
RANGE = 8 << 20
PIECE = 1 << 20


class _Raw(io.RawIOBase):
    """A file of Arrow's that fails as Python's do."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, to) -> int:  # noqa: ANN001
        return self.file.readinto(to)

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the beginning")
        return self.file.seek(at)

    def tell(self) -> int:
        return self.file.tell()


def _opened(uri: str) -> io.BufferedReader:
    """A seekable file in whatever store the address names."""
    store, path = fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)
    return io.BufferedReader(_Raw(store.open_input_file(path)), 1 << 16)


def inside(name: str) -> str:
    """An entry's path in the archive's folder; ValueError if it leads out of it."""
    path = posixpath.normpath(name.replace("\\", "/"))
    if path.startswith(("/", "../")) or path in ("..", ".") or path[1:2] == ":":
        raise ValueError(f"{name} leads outside")
    return path


def listed(uri: str, max_entries: int = trees.MAX_ENTRIES, max_unpacked: int = trees.MAX_UNPACKED) -> list[tuple[int, str, int]]:
    """Number, path and unpacked size of an archive's files, from its directory; ValueError if it is none, empty, or beyond the
    limits. The one folder that holds all is left off, and so are links."""
    try:
        with _opened(uri) as f, zipfile.ZipFile(f) as z:
            entries = z.infolist()
    except zipfile.BadZipFile as e:
        raise ValueError(f"{uri} is no archive") from e
    if not entries:
        raise ValueError("the archive is empty")
    if len(entries) > max_entries:
        raise ValueError("the archive has too many entries")
    files, total = [], 0
    for i, e in enumerate(entries):
        path = inside(e.filename)
        total += e.file_size
        if total > max_unpacked:
            raise ValueError("the archive is too large")
        if not e.is_dir() and not stat.S_ISLNK(e.external_attr >> 16):
            files.append((i, path, e.file_size))
    tops = {p.split("/", 1)[0] for p in (inside(e.filename) for e in entries) if not p.startswith(".")}
    if len(tops) == 1 and all("/" in p for _, p, _ in files if not p.startswith(".")):
        top = f"{tops.pop()}/"
        files = [(i, p[len(top) :] if p.startswith(top) else p, n) for i, p, n in files if p.startswith(top)]
    return files


@dataclass
class Entries(InputPartition):
    """Files of one archive: number, path, size."""

    archive: str
    files: list[tuple[int, str, int]]


class ZipReader(DataSourceReader):
    def __init__(self, options):  # noqa: ANN001
        self.archives = [x for x in options["path"].split(",") if x]
        self.most = int(options.get("maxEntries", trees.MAX_ENTRIES)), int(options.get("maxUnpacked", trees.MAX_UNPACKED))
        self.range = int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for archive in self.archives:
            part, size = [], 0
            for file in listed(archive, *self.most):
                if part and size + file[2] > self.range:
                    out.append(Entries(archive, part))
                    part, size = [], 0
                part.append(file)
                size += file[2]
            if part:
                out.append(Entries(archive, part))
        return out

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        with _opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            entries = z.infolist()
            for number, path, size in partition.files:
                content = bytearray()
                with z.open(entries[number]) as entry:
                    while piece := entry.read(PIECE):
                        content += piece
                        if len(content) > size:  # more than its directory says
                            raise ValueError(f"{path} is larger than stated")
                yield pa.RecordBatch.from_pydict({"path": [path], "length": pa.array([len(content)], pa.int64()), "content": pa.array([bytes(content)], pa.binary())})


class ZipSource(DataSource):
    """spark.read.format("zip_entries"): path, length, content of the files of archives (path: one, or several by commas).

    Options: maxEntries, maxUnpacked (of each archive), rangeBytes (unpacked, a task's share). The driver reads directories of
    archives only; tasks seek to their own entries."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ZipReader(self.options)  # whatever the case of their names


def entries(spark: SparkSession, *archives: str, **options: int) -> DataFrame:
    """path, length, content of the files of archives."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_entries").options(**{k: str(v) for k, v in options.items()}).load(",".join(archives))


def scan(spark: SparkSession, *archives: str, max_bytes: int = trees.MAX_BYTES, **options: int) -> DataFrame:
    """The sources in archives, as `trees.scan` gives those of the trees in them."""
    return trees.sources(entries(spark, *archives, **options), max_bytes)


def packed(rows: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """Writes each partition's rows as an archive in the folder; archive, files, bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        at = f"{folder.rstrip('/')}/part-{context.partitionId():05d}-{context.attemptNumber()}.zip"
        store, to = fs.FileSystem.from_uri(at)
        store.create_dir(posixpath.dirname(to), recursive=True)
        files = size = 0
        with store.open_output_stream(to) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for name, data in zip(batch.column(0), batch.column(1), strict=True):
                    data = data.as_py() or b""
                    z.writestr(name.as_py(), data)
                    files, size = files + 1, size + len(data)
        if files:
            yield pa.RecordBatch.from_pydict({"archive": [at], "files": pa.array([files], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return rows.select(F.col(path), F.col(content).cast("binary")).mapInArrow(run, "archive string, files long, bytes long")
