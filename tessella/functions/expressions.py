"""Scalar expressions of the storage model: hashes, paths, byte codecs, sizes. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USER_TAG, USER_MASK = 0x1000, 0x0FFF


def djb2(key: Column) -> Column:
    """The 32-bit key hash over the UTF-8 bytes."""
    data = key.cast("binary")
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("bigint"))
    used = F.slice(codes, F.lit(1), F.octet_length(data))
    return F.aggregate(used, F.lit(5381).cast("bigint"), lambda h, c: F.pmod(h * 33 + c, F.lit(1 << 32)))


def int64_be(value: Column) -> Column:
    """The first eight bytes as a signed big-endian number; 0 for shorter values."""
    return F.when(F.octet_length(value) >= 8, F.conv(F.hex(F.substring(value, 1, 8)), 16, -10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def encode_int64_be(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0"))


def float64_be(value: Column) -> Column:
    """The first eight bytes as a big-endian IEEE double, by arithmetic on its bits; 0 for shorter values."""
    bits = int64_be(value)
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(bits, 52).bitwiseAND(F.lit(0x7FF))
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    normal = sign * (1 + fraction / float(1 << 52)) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    tiny = sign * (fraction / float(1 << 52)) * F.pow(F.lit(2.0), F.lit(-1022.0))
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(F.octet_length(value) < 8, F.lit(0.0)).when(exponent == 0x7FF, special).when(exponent == 0, tiny).otherwise(normal)


def user_tag(number: Column) -> Column:
    return F.lit(USER_TAG) + number.bitwiseAND(F.lit(USER_MASK))


def is_system_tag(tag: Column) -> Column:
    return tag < 0x0100


def is_app_tag(tag: Column) -> Column:
    return tag.between(0x0100, 0x0FFF)


def is_user_tag(tag: Column) -> Column:
    return tag >= USER_TAG


def shard_of(number: Column, shards: int) -> Column:
    return F.pmod(number, F.lit(shards))


def block_path(number: Column) -> Column:
    """Two directory levels from the id, then the id in hexadecimal."""
    part = lambda c, width: F.lower(F.lpad(F.hex(c), width, "0"))
    return F.concat(part(F.pmod(number, F.lit(256)), 2), F.lit("/"), part(F.pmod(F.floor(number / 256), F.lit(256)), 2), F.lit("/"), part(number, 8), F.lit(".blk"))


def parent_path(path: Column) -> Column:
    parent = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(parent == "", "/").otherwise(parent)


def path_matches(pattern: Column, path: Column) -> Column:
    """Equal, *, below a pattern that ends in /*, or below the pattern itself."""
    star = pattern.endswith("/*") & F.startswith(path, F.substring(pattern, F.lit(1), F.length(pattern) - 1))
    return (pattern == path) | (pattern == "*") | star | F.startswith(path, F.concat(pattern, F.lit("/")))


def operation_matches(pattern: Column, operation: Column) -> Column:
    return (pattern == operation) | (pattern == "*")


def attributes_match(pattern: Column, attributes: Column) -> Column:
    """Every entry of the pattern map stands in the attributes; an absent attribute counts as empty."""
    return F.forall(F.map_entries(pattern), lambda e: F.coalesce(F.try_element_at(attributes, e["key"]), F.lit("")) == e["value"])


def byte_size(n: Column) -> Column:
    """Bytes in words, by powers of 1024."""
    power = F.greatest(F.lit(0), F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1024.0))))
    power = F.when(n >= F.pow(F.lit(1024.0), power + 1), power + 1).otherwise(power)
    unit = F.element_at(F.array(*[F.lit(u) for u in "KMGTPE"]), F.greatest(power, F.lit(1)).cast("int"))
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).otherwise(F.format_string("%.1f %sB", F.bround(n / F.pow(F.lit(1024.0), power), 1), unit))


def disk_blocks(size: Column) -> Column:
    return F.ceil(size / 512)


def read_range(data: Column, offset: int, size: int) -> Column:
    return F.substring(data, offset + 1, size)


def truncated(data: Column, size: int) -> Column:
    """Cut to the size, or filled up with zero bytes."""
    zero = F.lit(b"\x00")
    return F.when(F.octet_length(data) >= size, F.substring(data, 1, size)).otherwise(F.rpad(data, size, zero))


def write_range(data: Column, offset: int, new: bytes) -> Column:
    """Bytes written at an offset; a gap before it is filled with zeros."""
    filled = F.when(F.octet_length(data) >= offset, data).otherwise(truncated(data, offset))
    return F.concat(F.substring(filled, 1, offset), F.lit(new), F.substring(filled, offset + len(new) + 1, 2**31 - 1))
