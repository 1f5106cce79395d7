"""Container files: a reader for Spark (format "tessella-container") and a writer of the same documented layout.

    0    256 bytes of header: magic u32 0x44654653, version u16, flags u16, created i64, modified i64, metadata offset
         u64, metadata size u64, block offset u64, block count u32, the rest zero
    256  metadata: count u32, then for each tag u16, size u16, flags u8, reserved u8, bytes
    then blocks: id u32, type u8, flags u8, reserved u16, size u32, MD5 16 bytes, previous u32, next u32, time i64, data

All numbers are big-endian.
"""

from __future__ import annotations

import glob
import hashlib
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.errors import CorruptedError, InvalidValueError
from tessella.shipping import ship

MAGIC, VERSION, OLDEST, HEADER_SIZE = 0x44654653, 1, 1, 256
_HEADER = struct.Struct(">IHHqqQQQI")
_ENTRY = struct.Struct(">HHBB")
_BLOCK = struct.Struct(">IBBHI16sIIq")


def write(path: str, metadata: dict[int, bytes], blocks: Iterable[dict], created: int = 0, modified: int = 0, flags: int = 0) -> None:
    """blocks: dicts with id and data, and optionally type, flags, prev, next, ts."""
    entries = b"".join(_ENTRY.pack(tag, _short(value), 0, 0) + value for tag, value in sorted(metadata.items()))
    meta = struct.pack(">I", len(metadata)) + entries
    body, count = [], 0
    for b in blocks:
        data = b["data"]
        body.append(_BLOCK.pack(b["id"], b.get("type", 0), b.get("flags", 0), 0, len(data), hashlib.md5(data).digest(), b.get("prev", 0), b.get("next", 0), b.get("ts", 0)) + data)
        count += 1
    head = _HEADER.pack(MAGIC, VERSION, flags, created, modified, HEADER_SIZE, len(meta), HEADER_SIZE + len(meta), count)
    Path(path).write_bytes(head.ljust(HEADER_SIZE, b"\0") + meta + b"".join(body))


def _short(value: bytes) -> int:
    if len(value) > 0xFFFF:
        raise InvalidValueError("a metadata value has at most 65535 bytes")
    return len(value)


def header(data: bytes) -> dict[str, int]:
    if len(data) < HEADER_SIZE:
        raise CorruptedError("the header is cut off")
    names = ("magic", "version", "flags", "created", "modified", "metadata_offset", "metadata_size", "block_offset", "block_count")
    found = dict(zip(names, _HEADER.unpack_from(data), strict=True))
    if found["magic"] != MAGIC:
        raise CorruptedError("this is no container file")
    if not OLDEST <= found["version"] <= VERSION:
        raise CorruptedError(f"version {found['version']} isn't known")
    return found


def metadata(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = header(data)["metadata_offset"]
    (count,) = struct.unpack_from(">I", data, at)
    at += 4
    for _ in range(count):
        tag, size, _, _ = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        yield tag, data[at : at + size]
        at += size


def blocks(data: bytes, verify: bool = True) -> Iterator[tuple]:
    head = header(data)
    at = head["block_offset"]
    for _ in range(head["block_count"]):
        number, kind, flags, _, size, md5, prev, nxt, ts = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        body = data[at : at + size]
        if verify and (len(body) != size or hashlib.md5(body).digest() != md5):
            raise CorruptedError(f"block {number} doesn't match its checksum")
        at += size
        yield number, kind, flags, size, md5.hex(), prev, nxt, ts, body


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], what: str, verify: bool) -> None:
        self.paths, self.what, self.verify = paths, what, verify

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        data = Path(partition.path).read_bytes()
        if self.what == "files":
            h = header(data)
            yield (partition.path, h["version"], h["flags"], h["created"], h["modified"], h["block_count"])
        elif self.what == "metadata":
            for tag, value in metadata(data):
                yield partition.path, tag, value
        else:
            for row in blocks(data, self.verify):
                yield partition.path, *row


class ContainerSource(DataSource):
    """spark.read.format("tessella-container").option("what", "files" | "metadata" | "blocks").load(glob): one task a file."""

    SCHEMAS = {
        "files": "file_id string, version int, flags int, created long, modified long, block_count long",
        "metadata": "file_id string, tag int, value binary",
        "blocks": "file_id string, block_id long, type int, flags int, size long, checksum string, prev long, next long, ts long, data binary",
    }

    @classmethod
    def name(cls) -> str:
        return "tessella-container"

    def _what(self) -> str:
        what = self.options.get("what", "blocks")
        if what not in self.SCHEMAS:
            raise InvalidValueError(what)
        return what

    def schema(self) -> str:
        return self.SCHEMAS[self._what()]

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(path))
        if not found:
            raise InvalidValueError(f"no files at {path}")
        return _Reader(found, self._what(), self.options.get("verify", "true") == "true")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and its workers."""
    ship(spark)
    spark.dataSource.register(ContainerSource)
