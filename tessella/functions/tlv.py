"""TLV items: type, length class, little-endian length, value. Values are written in the smallest type that holds them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessella.errors import TlvError
from tessella.shipping import ship

NULL, STRING, BYTES, BOOL, ARRAY, MAP = 0, 11, 12, 13, 14, 15
_SIGNED = {1: "<b", 3: "<h", 5: "<i", 7: "<q"}
_UNSIGNED = {2: "<B", 4: "<H", 6: "<I", 8: "<Q"}
_FLOATS = {9: "<f", 10: "<d"}
_NUMBERS = _SIGNED | _UNSIGNED | _FLOATS
_LENGTHS = ("<B", "<H", "<I", "<Q")


class Unsigned(int):
    """An integer to be written with an unsigned type."""


def _item(kind: int, body: bytes) -> bytes:
    n = len(body)
    size = 0 if n < 1 << 8 else 1 if n < 1 << 16 else 2 if n < 1 << 32 else 3
    return bytes((kind, size)) + struct.pack(_LENGTHS[size], n) + body


def encode(value: Any) -> bytes:
    if value is None:
        return _item(NULL, b"")
    if isinstance(value, bool):
        return _item(BOOL, bytes((value,)))
    if isinstance(value, int):
        for kind, form in (_UNSIGNED if isinstance(value, Unsigned) else _SIGNED).items():
            try:
                return _item(kind, struct.pack(form, value))
            except struct.error:
                continue
        raise TlvError(f"{value} needs more than 64 bits")
    if isinstance(value, float):
        short = struct.pack("<f", value) if abs(value) <= 3.4028234663852886e38 or value != value or abs(value) == float("inf") else None
        lossless = short is not None and (struct.unpack("<f", short)[0] == value or value != value)
        return _item(9, short) if lossless else _item(10, struct.pack("<d", value))
    if isinstance(value, str):
        return _item(STRING, value.encode())
    if isinstance(value, (bytes, bytearray)):
        return _item(BYTES, bytes(value))
    if isinstance(value, (list, tuple)):
        return _item(ARRAY, b"".join(map(encode, value)))
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TlvError("keys of a map are strings")
        return _item(MAP, b"".join(encode(k) + encode(v) for k, v in value.items()))
    raise TlvError(f"no type for {type(value).__name__}")


def items(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Type and body of each item."""
    at = 0
    while at < len(data):
        if at + 2 > len(data) or data[at + 1] > 3:
            raise TlvError("bad header")
        form = _LENGTHS[data[at + 1]]
        start = at + 2 + struct.calcsize(form)
        if start > len(data):
            raise TlvError("the length is cut off")
        end = start + struct.unpack_from(form, data, at + 2)[0]
        if end > len(data):
            raise TlvError("the value is cut off")
        yield data[at], data[start:end]
        at = end


def _value(kind: int, body: bytes) -> Any:
    if kind in _NUMBERS:
        if len(body) != struct.calcsize(_NUMBERS[kind]):
            raise TlvError("wrong length of a number")
        return struct.unpack(_NUMBERS[kind], body)[0]
    if kind == NULL:
        return None
    if kind == STRING:
        return body.decode()
    if kind == BYTES:
        return body
    if kind == BOOL:
        if len(body) != 1:
            raise TlvError("wrong length of a bool")
        return body[0] != 0
    if kind == ARRAY:
        return [_value(k, b) for k, b in items(body)]
    if kind == MAP:
        flat = list(items(body))
        if len(flat) % 2 or any(k != STRING for k, _ in flat[::2]):
            raise TlvError("a map needs pairs of string and value")
        return {k.decode(): _value(*v) for (_, k), v in zip(flat[::2], flat[1::2], strict=True)}
    raise TlvError(f"unknown type {kind}")


def decode(data: bytes) -> Any:
    found = list(items(data))
    if len(found) != 1:
        raise TlvError("one item was expected")
    return _value(*found[0])


def _json_ready(x: Any) -> Any:
    if isinstance(x, bytes):
        return x.hex()
    if isinstance(x, list):
        return [_json_ready(v) for v in x]
    return {k: _json_ready(v) for k, v in x.items()} if isinstance(x, dict) else x


def to_json(data: Column) -> Column:
    """Decoded items as JSON text (bytes in hexadecimal), malformed ones null; parse_json makes it a variant."""
    import json

    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else json.dumps(_json_ready(decode(bytes(v))), ensure_ascii=False)
            except (TlvError, UnicodeDecodeError):
                return None

        return values.map(one)

    return run(data)


def from_text(value: Column) -> Column:
    """Strings as TLV items, in the JVM: the header is arithmetic on the length."""
    body = value.cast("binary")
    n = F.octet_length(body)
    little = lambda width: F.concat(*[F.unhex(F.lpad(F.hex(F.pmod(F.floor(n / 256**k), F.lit(256)).cast("int")), 2, "0")) for k in range(width)])
    head = F.when(n < 1 << 8, F.concat(F.lit(b"\x0b\x00"), little(1))).when(n < 1 << 16, F.concat(F.lit(b"\x0b\x01"), little(2))).otherwise(F.concat(F.lit(b"\x0b\x02"), little(4)))
    return F.concat(head, body)
