"""Python data sources for files that Spark's own readers give to one task: block-gzipped text and archives.

A file is cut into ranges of bytes, each a partition. A range of a plain file
holds the lines that begin in it; a range of a block-gzipped file those that
begin in the blocks that begin in it, and its task finds the first one by its
magic number and the block behind it. A member of a zip archive is a partition
and is unpacked as a stream; gzip without blocks can't be entered in the middle and is one, too.
Lines go to Spark in Arrow batches of some 8,192; a task holds one batch, one block and one line.

Sources read by ``pyarrow.fs``, so a path is local (and shared by all executors)
or an address that pyarrow knows.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

RANGE_BYTES = 64 << 20
_PIECE = 1 << 20
_ROWS = 8192
_BLOCK = 1 << 16  # a gzip block's greatest size
_MAGIC = b"\x1f\x8b\x08\x04"


@dataclass
class Part(InputPartition):
    """A range of a file, or a member of an archive."""

    path: str
    kind: str
    start: int = 0
    end: int = 0
    member: str | None = None


def _open(path: str):
    fs, inner = (pafs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _files(path: str) -> list[tuple[str, int]]:
    """Files at a path, or right below it, with their sizes; names that begin with a dot or underscore are no data."""
    uri = "://" in path or path.startswith("file:")
    fs, inner = pafs.FileSystem.from_uri(path) if uri else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    below = sorted((i for i in fs.get_file_info(pafs.FileSelector(inner)) if i.type == pafs.FileType.File and i.base_name[0] not in "._"), key=lambda i: i.path)
    return [(f"{path.rstrip('/')}/{i.base_name}", i.size) for i in below]


def _block_size(head: bytes) -> int | None:
    """Size of the gzip block that these bytes begin; None where no block begins."""
    if len(head) < 18 or not head.startswith(_MAGIC):
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def _kind(path: str, file) -> str:
    if path.endswith(".zip"):
        return "zip"
    head = file.read(_BLOCK)
    if head[:2] != b"\x1f\x8b":
        return "plain"
    return "blocks" if _block_size(head) else "gzip"


def _first_block(file, at: int, size: int) -> int:
    """Where the first block from ``at`` on begins; the file's size if there is none."""
    while at < size:
        file.seek(at)
        window = file.read(3 * _BLOCK)
        found = window.find(_MAGIC)
        while 0 <= found < _BLOCK:
            length = _block_size(window[found:])
            behind = found + length if length else 0
            if length and (at + behind == size or _block_size(window[behind : behind + _BLOCK])):
                return at + found
            found = window.find(_MAGIC, found + 1)
        at += _BLOCK
    return size


def _pieces(file, part: Part) -> Iterator[tuple[bytes, bool]]:
    """Bytes from the part's beginning to the end of the file, and whether they are the part's own."""
    size = file.size()
    if part.kind == "plain":
        file.seek(part.start)
        at = part.start
        while at < size:
            own = at < part.end
            piece = file.read(min(_PIECE, part.end - at) if own else _BLOCK)
            if not piece:
                return
            yield piece, own
            at += len(piece)
        return
    at = _first_block(file, part.start, size)
    while at < size:
        file.seek(at)
        block = file.read(_BLOCK)
        length = _block_size(block)
        if length is None or length > len(block):
            raise ValueError(f"no whole gzip block at byte {at} of {part.path}")
        yield zlib.decompress(block[:length], 31), at < part.end
        at += length


def _ranged(file, part: Part) -> Iterator[list[bytes]]:
    """Lines that begin in the part. The one at its very beginning is the part before's, so each part ends with the line that begins behind it."""
    rest, skip, any_own = b"", part.start > 0, False
    for piece, own in _pieces(file, part):
        if not own:
            if not any_own or skip:
                return
            head, newline, _ = piece.partition(b"\n")
            rest += head
            if newline:
                yield [rest]
                return
            continue
        any_own = True
        if skip:
            _, newline, piece = piece.partition(b"\n")
            if not newline:
                continue
            skip = False
        *lines, rest = (rest + piece).split(b"\n")
        yield lines
    if any_own and not skip and rest:
        yield [rest]


def _streamed(stream) -> Iterator[list[bytes]]:
    rest = b""
    while piece := stream.read(_PIECE):
        *lines, rest = (rest + piece).split(b"\n")
        yield lines
    if rest:
        yield [rest]


def _lines(part: Part) -> Iterator[list[str]]:
    """The part's lines without their ends, some at a time; bytes that are no UTF-8 become the replacement character."""
    with _open(part.path) as file:
        if part.kind == "zip":
            with zipfile.ZipFile(file) as archive, archive.open(part.member) as stream:
                yield from _texts(_streamed(stream))
        elif part.kind == "gzip":
            import gzip

            with gzip.GzipFile(fileobj=file) as stream:
                yield from _texts(_streamed(stream))
        else:
            yield from _texts(_ranged(file, part))


def _texts(groups: Iterator[list[bytes]]) -> Iterator[list[str]]:
    held: list[str] = []
    for group in groups:
        held += [x.removesuffix(b"\r").decode("utf-8", "replace") for x in group]
        while len(held) >= _ROWS:
            yield held[:_ROWS]
            held = held[_ROWS:]
    if held:
        yield held


def plan(path: str, range_bytes: int = RANGE_BYTES, member: str | None = None) -> list[Part]:
    """The parts of all files at a path. Archives give a part for each member, or for the one named."""
    parts = []
    for name, size in _files(path):
        with _open(name) as file:
            kind = _kind(name, file)
            if kind == "zip":
                file.seek(0)
                with zipfile.ZipFile(file) as archive:
                    members = [m for m in archive.namelist() if not m.endswith("/")]
                if member is not None and member not in members:
                    raise ValueError(f"{name} has no member {member}")
                parts += [Part(name, kind, member=m) for m in members if member in (None, m)]
            elif kind == "gzip":
                parts.append(Part(name, kind, end=size))
            else:
                parts += [Part(name, kind, at, min(at + range_bytes, size)) for at in range(0, size, range_bytes)]
    return parts


def header(path: str, mark: str = "#") -> list[str]:
    """The lines that a file's text begins with as long as they begin with ``mark``; nothing behind them is read. Of several files the first one's."""
    out: list[str] = []
    parts = plan(path)
    for part in parts[:1]:
        whole = Part(part.path, part.kind, 0, 1 << 62, part.member)
        for lines in _lines(whole):
            for line in lines:
                if not line.startswith(mark):
                    return out
                out.append(line)
    return out


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.member = options["path"], options.get("member")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Part]:
        return plan(self.path, self.range_bytes, self.member) or [Part("", "none")]


class LineReader(_Reader):
    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.kind == "none":
            return
        for lines in _lines(part):
            have = {"path": [part.path] * len(lines), "member": [part.member] * len(lines), "value": lines}
            yield pa.record_batch([pa.array(have[n], pa.string()) for n in self.names], names=self.names)


class LineSource(DataSource):
    """Lines with the file and member that they come from."""

    @classmethod
    def name(cls) -> str:
        return "nadir_lines"

    def schema(self) -> str:
        return "path string, member string, value string"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(schema, self.options)


_SITE = ("chromosome", "position", "id", "ref", "alt", "quality", "filter", "info")
_COMPARED = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class SiteReader(_Reader):
    """Sites of VCF files. Filters on the locus are applied before a line is taken apart; columns that the schema leaves out aren't made."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        unknown = set(self.names) - set(_SITE)
        if unknown:
            raise ValueError(f"a site has no column {', '.join(sorted(unknown))}")
        self.locus: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _COMPARED and f.attribute in (("chromosome",), ("position",)):
                self.locus.append((_SITE.index(f.attribute[0]), type(f), f.value))
            else:
                yield f

    def _kept(self, at: tuple) -> bool:
        return all(at[i] is not None and _COMPARED[kind](at[i], value) for i, kind, value in self.locus)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.kind == "none":
            return
        for lines in _lines(part):
            rows = []
            for line in lines:
                if line.startswith("#"):
                    continue
                start = line.split("\t", 2)
                if len(start) < 3:
                    continue
                at = start[0].removeprefix("chr"), int(start[1]) if start[1].isascii() and start[1].isdigit() and len(start[1]) < 19 else None
                if not self._kept(at):
                    continue
                cells = start[2].split("\t", 6)
                if len(cells) >= 6:
                    rows.append((*at, *cells[:6]))
            if rows:
                columns = dict(zip(_SITE, zip(*rows, strict=True), strict=True))
                yield pa.record_batch([pa.array(columns[n], pa.int64() if n == "position" else pa.string()) for n in self.names], names=self.names)


class SiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nadir_sites"

    def schema(self) -> str:
        return ", ".join(f"{n} {'long' if n == 'position' else 'string'}" for n in _SITE)

    def reader(self, schema: StructType) -> SiteReader:
        return SiteReader(schema, self.options)


def lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, member: str | None = None) -> DataFrame:
    """(path, member, value): lines of plain, gzipped, block-gzipped and zipped files, by ranges. Line ends go, a carriage return before them too."""
    spark.dataSource.register(LineSource)
    reader = spark.read.format("nadir_lines").option("range_bytes", range_bytes)
    return (reader if member is None else reader.option("member", member)).load(path)


def sites(spark: SparkSession, path: str, columns: tuple[str, ...] = _SITE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Sites of VCF files by ranges, as text but for the position; lines of less than eight cells go, and a position that is no number is null.

    Filters on chromosome (without ``chr``) and position reach the source, for
    which the session's switch for filters of Python sources is set.
    """
    spark.dataSource.register(SiteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = ", ".join(f"{n} {'long' if n == 'position' else 'string'}" for n in columns)
    return spark.read.format("nadir_sites").schema(schema).option("range_bytes", range_bytes).load(path)
