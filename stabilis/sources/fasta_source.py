"""A Spark data source ``fasta``: byte ranges of files read in parallel, writes that appear as a whole.

    spark.dataSource.register(FastaDataSource)
    spark.read.format("fasta").load(path)
    df.select("header", "seq").write.format("fasta").mode("append").save(path)

Rows are (file, pos, header, seq); ``pos`` is the byte at which a record begins, so it orders a file
whatever its ranges are (option ``split``, bytes of a range).  Paths are those that Arrow's file systems open:
local and shared ones, and object stores by their address; ``text.read_fasta`` reads whatever Spark can.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, pos bigint, header string, seq string"
SPLIT = 64 << 20
#: Bytes that are read at a time.
CHUNK = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    """Records whose ``>`` stands within these bytes of a file."""

    file: str
    begin: int
    end: int


def lines(stream, begin: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) from a byte on."""
    at, rest = begin, b""
    while chunk := stream.read(CHUNK):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


class FastaReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not any(x.startswith(("_", ".")) for x in f.path[len(path) :].split("/"))]
        return [Range(f.path, x, min(x + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for x in range(0, f.size, self.split)]

    def read(self, part: Range) -> Iterator[tuple]:
        system, _ = opened(self.path)
        with system.open_input_file(part.file) as stream:
            # from the byte before, to know whether the range begins with a line
            start = max(0, part.begin - 1)
            stream.seek(start)
            record = None
            for at, line in lines(stream, start):
                line = line.rstrip(b"\r")
                if at < part.begin:
                    continue
                if line.startswith(b">"):
                    if record:
                        yield self.row(part.file, *record)
                    if at >= part.end:
                        return
                    record = (at, line[1:].decode().strip(), [])
                elif record:
                    record[2].append(b"".join(line.split()))
                elif part.begin == 0 and line.strip():
                    raise ValueError(f"a text before a header: {part.file}")
            if record:
                yield self.row(part.file, *record)

    @staticmethod
    def row(file: str, at: int, header: str, parts: list[bytes]) -> tuple:
        seq = b"".join(parts).decode()
        if not seq:
            raise ValueError(f"empty sequence: {header}")
        return file, at, header, seq


@dataclass
class Written(WriterCommitMessage):
    name: str


class FastaWriter(DataSourceWriter):
    """Tasks write below a folder of the job; commit moves what the last attempts wrote, abort deletes it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        system, path = opened(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.fasta"
        system.create_dir(f"{path}/{self.job}", recursive=True)
        with system.open_output_stream(f"{path}/{self.job}/{name}") as out:
            for r in rows:
                if not r["seq"] or r["header"] is None or "\n" in r["header"]:
                    raise ValueError(f"a record without a header or sequence: {r['header']}")
                out.write(f">{r['header']}\n{r['seq']}\n".encode())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.is_file:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                system.move(f"{path}/{self.job}/{m.name}", f"{path}/{self.job[5:13]}-{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        if system.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.job}")


class FastaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        return FastaWriter(self.options["path"], overwrite)
