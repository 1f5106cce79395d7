"""Token counts with a digest cache.

Each distinct text is known by the SHA-256 of its content (null counts as empty) and each tokenizer by the SHA-256
of its file. Texts join the cache on both digests; only one row of each digest that the cache lacks is encoded, and
its count is appended to the cache, a Parquet folder partitioned by nothing and written by atomic task commits.

Defined results: null or empty text counts 0 tokens and 0 bytes; repeated rows each keep their row; a null doc_id
stays null; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import shared_dir, small_side, stored
from tessella.shipping import map_arrow

#: Distinct chunks remembered by a Python worker; beyond it the memo starts anew. It bounds memory, never results.
MEMO_ENTRIES = 300_000
_TWO_SPACES = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Characters on whose class every Unicode version agrees; a text with others is given to the library whole.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ‐-‧‰-⁞€]*").fullmatch


def chunks(text: str) -> list[str]:
    """Cuts before every single space between two non-spaces. Byte-level pre-tokenizers always start a piece there,
    so the pieces of the chunks are the pieces of the text."""
    return _SINGLE_SPACE.split(text) if _TWO_SPACES.search(text) or text[:1].isspace() or text[-1:].isspace() else text.split(" ")


class _Counts(dict):
    """Chunk -> tokens of it with its leading space; missing ones are encoded."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        n = self.encode(" " + chunk)
        if len(chunk) <= 64:
            self[chunk] = n
        return n


def _by_ranks(spec: dict):
    """A quicker count of a chunk's tokens for vocabularies whose merges stand in the order of their ids, when the
    merges say the same as ranks of byte strings do; None for others."""
    model = spec.get("model", {})
    vocab, merges = model.get("vocab", {}), model.get("merges", ())
    if model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    made = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in merges]
    ids = [vocab.get(m, -1) for m in made]
    if ids != sorted(set(ids)) or ids[:1] == [-1]:
        return None
    import public_tokenizers
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    single = {c: vocab.get(c, -1) for c in byte_of}
    if min(single.values()) < 0 or max(single.values()) > ids[0]:
        return None
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in [*single.items(), *zip(made, ids, strict=True)]}
    encode = tiktoken.Encoding("ranks of a tokenizer file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda chunk: len(encode(chunk))


class Counter:
    """Counts a text's tokens as the library of the file gives them, without added special tokens."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda text: len(model.encode(text))
            self._memo, self._special = None, ()
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        spec = json.loads(Path(path).read_text())
        pre = spec.get("pre_tokenizer") or {}
        local = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self._memo = _Counts(_by_ranks(spec) or self._whole) if local else None
        self._special = tuple(t["content"] for t in spec.get("added_tokens", ()))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self._memo is None or not _PLAIN(text) or any(s in text for s in self._special):
            return self._whole(text)
        first, *rest = chunks(text)
        return self._whole(first) + sum(map(self._memo.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def encode_misses(rows: DataFrame, path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return map_arrow(rows, run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, *, tokenizer_path: str | None = None, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``cache_path`` names a cache to use and extend; without it one starts empty."""
    spark = docs.sparkSession
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    version = tokenizer_digest(path)
    cache_path = cache_path or f"{shared_dir(spark)}/tessella-token-cache-{uuid.uuid4().hex}"
    schema = "digest binary, tokenizer string, n_tokens long"

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    ids = stored(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")

    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    known = spark.read.schema(schema).parquet(cache_path).where(F.col("tokenizer") == version).select("digest").distinct()
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    misses = first.join(known, "digest", "left_anti").withColumn("miss", F.lit(True))
    # Rows that needn't be encoded are named, not texts moved: a copy of another row, or one whose digest is known.
    skip = stored(ids.join(misses, "digest", "left").where(F.col("miss").isNull() | ~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "digest"), "known")
    r, k = rows.alias("r"), small_side(skip).alias("k")
    fresh = r.join(k, F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.digest") == F.col("k.digest")), "left_anti").select("r.digest", "r.text")
    encode_misses(fresh, path).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)

    counts = spark.read.schema(schema).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return ids.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
