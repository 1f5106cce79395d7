"""Encryption and signatures of block data. AES-GCM is the JVM's; HMAC, which SQL lacks, is a pandas UDF."""

from __future__ import annotations

import hashlib
import hmac
import secrets
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import AccessError, AlreadyExistsError, NotFoundError
from tessella.functions.expressions import encode_int64_be

ALGORITHMS = (
    ("AES-256-GCM", "symmetric", 256, True),
    ("AES-256-CTR", "symmetric", 256, True),
    ("ChaCha20-Poly1305", "symmetric", 256, True),
    ("RSA-2048-OAEP", "asymmetric", 2048, False),
    ("RSA-4096-OAEP", "asymmetric", 4096, False),
    ("ECIES-P256", "asymmetric", 256, False),
    ("HMAC-SHA256", "signature", 256, True),
    ("HMAC-SHA512", "signature", 512, True),
)


def algorithms(spark: SparkSession) -> DataFrame:
    """What is known, and what is implemented here; every symmetric name is AES-GCM underneath."""
    return spark.createDataFrame(ALGORITHMS, "name string, kind string, bits int, implemented boolean")


def block_aad(block_id: Column) -> Column:
    """The block id in four big-endian bytes: a ciphertext is bound to its block."""
    return F.substring(encode_int64_be(block_id), 5, 4)


def encrypt(data: Column, key: bytes, aad: Column | None = None) -> Column:
    """iv, ciphertext and tag together, by AES-GCM."""
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(b"") if aad is None else aad)


def decrypt(data: Column, key: bytes, aad: Column | None = None, strict: bool = True) -> Column:
    """strict: raise where the key, the data or the bound block is wrong; otherwise null."""
    call = F.aes_decrypt if strict else F.try_aes_decrypt
    return call(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"") if aad is None else aad)


def hmac_sign(data: Column, key: bytes, digest: str = "sha256") -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(key, bytes(v), getattr(hashlib, digest)).digest())

    return run(data)


def hmac_verify(data: Column, signature: Column, key: bytes, digest: str = "sha256") -> Column:
    return F.coalesce(hmac_sign(data, key, digest) == signature, F.lit(False))


@dataclass(frozen=True)
class Key:
    id: str
    material: bytes = field(repr=False)
    created: datetime
    expires: datetime | None = None
    replaced_by: str | None = None


class KeyStore:
    """Keys by name, on the driver. Rotation keeps the old key so that what it encrypted stays readable."""

    def __init__(self) -> None:
        self._keys: dict[str, Key] = {}

    def generate(self, key_id: str, bits: int = 256, expires: datetime | None = None) -> Key:
        return self.import_key(key_id, secrets.token_bytes(bits // 8), expires)

    def import_key(self, key_id: str, material: bytes, expires: datetime | None = None) -> Key:
        if key_id in self._keys:
            raise AlreadyExistsError(key_id)
        if len(material) not in (16, 24, 32, 64):
            raise AccessError("a key has 16, 24, 32 or 64 bytes")
        self._keys[key_id] = Key(key_id, material, datetime.now(UTC), expires)
        return self._keys[key_id]

    def get(self, key_id: str, now: datetime | None = None) -> Key:
        if key_id not in self._keys:
            raise NotFoundError(key_id)
        key = self._keys[key_id]
        if key.expires is not None and key.expires < (now or datetime.now(UTC)):
            raise AccessError(f"{key_id} has expired")
        return key

    def rotate(self, key_id: str) -> Key:
        old = self.get(key_id)
        k = 1 + sum(x.startswith(f"{key_id}.v") for x in self._keys)
        new = self.generate(f"{key_id}.v{k}", len(old.material) * 8)
        self._keys[key_id] = replace(old, replaced_by=new.id)
        return new

    def export(self, key_id: str) -> bytes:
        return self.get(key_id).material

    def delete(self, key_id: str) -> None:
        if self._keys.pop(key_id, None) is None:
            raise NotFoundError(key_id)

    def list(self) -> list[str]:
        return sorted(self._keys)


def encrypt_blocks(blocks: DataFrame, key: Key | None) -> DataFrame:
    """blocks with data encrypted and flag 0x02 set; without a key, as they are."""
    if key is None:
        return blocks
    return blocks.withColumn("data", encrypt(F.col("data"), key.material, block_aad(F.col("block_id")))).withColumn("flags", F.col("flags").bitwiseOR(F.lit(2)).cast("smallint"))


def decrypt_blocks(blocks: DataFrame, key: Key | None) -> DataFrame:
    if key is None:
        return blocks
    plain = decrypt(F.col("data"), key.material, block_aad(F.col("block_id")))
    marked = F.col("flags").bitwiseAND(F.lit(2)) != 0
    return blocks.withColumn("data", F.when(marked, plain).otherwise(F.col("data"))).withColumn("flags", F.col("flags").bitwiseAND(F.lit(~2)).cast("smallint"))
