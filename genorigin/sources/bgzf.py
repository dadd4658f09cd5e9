"""Text files of block gzip (a chain of small gzip members that carry their own size), read and written by many tasks.

A partition is a range of compressed bytes. Its task looks for the first member that starts in the range, by its header and those of the members that follow, decompresses the members that start there,
and reads on behind the range to finish its last line; what precedes its first line break belongs to the task before. So one file is read by as many tasks as it has ranges, with the lines of the plain file.
With a region, a task of a sorted variant file looks at the first record of its range and of the next one, and reads nothing more if the region cannot lie between.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format: how a member begins, the place and size of its extra field, the empty member that ends a file, and the most text in a member.
MAGIC = b"\x1f\x8b\x08\x04"
HEADER = 18
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 0xFF00
#: Compressed bytes of a partition.
RANGE = 8 << 20


def member(text: bytes) -> bytes:
    """A member of up to ``MOST`` bytes of text."""
    squeezed = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = squeezed.compress(text) + squeezed.flush()
    head = MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(data) + HEADER + 8 - 1)
    return head + data + struct.pack("<II", zlib.crc32(text), len(text))


def member_size(head: bytes) -> int | None:
    """The whole size of a member from its first bytes; None if they are not those of one."""
    if len(head) < HEADER or head[:4] != MAGIC or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def _open(path: str) -> tuple[pa.NativeFile, int]:
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name), where.get_file_info(name).size


def is_block_gzip(path: str) -> bool:
    file, _ = _open(path)
    with file:
        return member_size(file.read_at(HEADER, 0)) is not None


class Members:
    """The members of a file from the first that starts at or behind a place on: (place, text)."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size

    def first(self, at: int) -> int:
        """Where that one starts; the size of the file if none does. A member is at most 64 KB, so it is near; its header must lead to others, up to three, or to the end."""
        if at == 0:
            return 0
        window = self.file.read_at(min(2 << 16, self.size - at), at)
        k = window.find(MAGIC)
        while k >= 0:
            place, chain = at + k, 0
            while chain < 3 and place < self.size and (n := member_size(self.file.read_at(HEADER, place))):
                place, chain = place + n, chain + 1
            if chain and (place == self.size or chain == 3):
                return at + k
            k = window.find(MAGIC, k + 1)
        return self.size

    def read(self, at: int) -> tuple[bytes, int]:
        """The text of the member at a place, and where the next one starts."""
        n = member_size(self.file.read_at(HEADER, at))
        if n is None:
            raise ValueError(f"No gzip block at byte {at}")
        return zlib.decompress(self.file.read_at(n, at)[HEADER:-8], -15), at + n


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    head: bool


class BlockGzipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["paths"].split("\n")
        self.range = int(options.get("range", RANGE))
        self.head = options.get("head", "false") == "true"
        region = options.get("region")
        self.region = None
        if region:
            chrom, _, span = region.rpartition(":")
            start, _, stop = span.partition("-")
            self.region = chrom, int(start), int(stop)

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            if self.head:
                out.append(Range(path, 0, 1, True))
                continue
            file, size = _open(path)
            file.close()
            out += [Range(path, at, min(size, at + self.range), False) for at in range(0, size, self.range)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        file, size = _open(part.path)
        with file:
            members = Members(file, size)
            if part.head:
                lines = self._leading(members)
            elif self.region and not self._overlaps(members, part):
                return
            else:
                lines = self._lines(members, part)
            for some in lines:
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(some), pa.string()), pa.array([x.rstrip(b"\r") for x in some], pa.binary()).cast(pa.string())], ["file", "value"])

    def _leading(self, members: Members) -> Iterator[list[bytes]]:
        """The lines at the start that begin with #."""
        at, rest = 0, b""
        while at < members.size:
            text, at = members.read(at)
            lines = (rest + text).split(b"\n")
            rest = lines.pop()
            k = next((k for k, x in enumerate(lines) if not x.startswith(b"#")), None)
            yield lines[:k]
            if k is not None:
                return
        yield [rest] if rest.startswith(b"#") else []

    def _lines(self, members: Members, part: Range) -> Iterator[list[bytes]]:
        """The lines that start in the members of the range, or right behind them, but for what comes before the first line break of a range that is not the first."""
        at, rest, skip = members.first(part.start), b"", part.start > 0
        while at < part.stop:
            text, at = members.read(at)
            if skip:
                k = text.find(b"\n")
                if k < 0:
                    continue
                text, skip = text[k + 1 :], False
            lines = (rest + text).split(b"\n")
            rest = lines.pop()
            yield lines
        if skip:
            return
        while at < members.size:  # the last line goes on, or the next starts right here: the range behind leaves it out
            text, at = members.read(at)
            k = text.find(b"\n")
            rest += text if k < 0 else text[:k]
            if k >= 0:
                break
        yield [rest] if rest else []

    def _overlaps(self, members: Members, part: Range) -> bool:
        """Whether records of the region may be in the range; where that cannot be told from the first records here and behind, they may."""
        here, behind = (self._record(members, at) for at in (part.start, part.stop))
        chrom, start, stop = self.region
        if here and here[0] == chrom and here[1] >= stop:
            return False
        if here and behind and here[0] == behind[0]:
            return here[0] == chrom and behind[1] >= start
        return True

    def _record(self, members: Members, at: int) -> tuple[str, int] | None:
        """Chromosome and position of the first whole record from a place on; None in the file's head or behind its last record."""
        if at == 0:
            return None
        at, text = members.first(at), b""
        while at < members.size:
            more, at = members.read(at)
            text += more
            lines = text.split(b"\n")
            if len(lines) > 2:
                fields = lines[1].split(b"\t", 2)
                return None if lines[1].startswith(b"#") or len(fields) < 3 else (fields[0].decode(), int(fields[1]))
        return None


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class BlockGzipWriter(DataSourceWriter):
    """Lines to files, a new one for each task and for each line that is the first of a variant file."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        where, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        where.create_dir(folder, recursive=True)
        out, held, names = None, b"", []
        for row in rows:
            line = row["value"].encode() + b"\n"
            if out is None or line.startswith(b"##fileformat"):
                held = self._finish(out, held)
                names.append(f"{folder}/part-{uuid.uuid4().hex}.vcf.gz")
                out = where.open_output_stream(names[-1], compression=None)
            held += line
            while len(held) >= MOST:
                out.write(member(held[:MOST]))
                held = held[MOST:]
        self._finish(out, held)
        return Written(names)

    @staticmethod
    def _finish(out, held: bytes) -> bytes:
        if out is not None:
            if held:
                out.write(member(held))
            out.write(END)
            out.close()
        return b""

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        where = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for m in messages:
            for name in m.paths if m else []:
                where.delete_file(name)


class BlockGzipText(DataSource):
    """``block_gzip_text``: file, value. Options to read: paths (one a line), range (compressed bytes of a partition), head (only the lines at the start that begin with #), region (chrom:start-stop)."""

    @classmethod
    def name(cls) -> str:
        return "block_gzip_text"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> BlockGzipReader:
        return BlockGzipReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockGzipWriter:
        return BlockGzipWriter(self.options)


def read_lines(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Lines (file, value) of block-gzip files."""
    spark.dataSource.register(BlockGzipText)
    return spark.read.format("block_gzip_text").options(paths="\n".join(paths), **options).load()


def write_lines(rows: DataFrame, path: str) -> None:
    """The lines (value) as block-gzip files in a folder."""
    rows.sparkSession.dataSource.register(BlockGzipText)
    rows.select("value").write.format("block_gzip_text").mode("append").option("path", path).save()
