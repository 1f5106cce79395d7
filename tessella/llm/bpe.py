"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each adjacent pair whose bytes are a token waits in the bucket of its rank;
a bitmap over the ranks, with a summary bitmap over its words, tells which buckets hold something, and find-first-set
picks the lowest rank. A bucket keeps positions; one that no longer starts a pair of this rank is stale and skipped.
Every merge costs a few word operations, so a pre-token of n bytes takes O(n) queue steps, where rescanning takes
O(n^2). Every pre-token that is no whole token goes through the queue, whatever its length. Those that a group of texts
has for the first time go through one queue together: walls part them, merges in one say nothing of another, and the
lowest rank of all is the lowest of its pre-token, so each gets the ids that it would get alone.

Defined results: null or empty text has no ids and decodes to no bytes; repeated rows each keep their row; a null
doc_id stays null; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.token_counts import MEMO_ENTRIES, chunks
from tessella.shipping import map_arrow

#: Ranks under one word of the bitmap; its summary has a bit for each word.
WORD = 256
_BIT = [1 << k for k in range(1 << 12)]
#: Characters of the texts that are encoded together, and bytes of the pre-tokens that are merged together.
GROUP, TOGETHER = 1 << 17, 1 << 14


class Codec:
    """Encodes and decodes by a file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.leaf = [0] * (max(self.tokens) // WORD + 1)  # the bitmap's words, all clear between pieces
        self._wall = max(self.tokens) + 1  # no token, so no pair with it is one
        self._bytes = [self.ranks.get(bytes([b]), self._wall) for b in range(256)]
        # By a token's rank, what rank a pair of it and the token on its right, or on its left, has.
        none: dict[int, int] = {}
        self._right, self._left = [none] * (self._wall + 1), [none] * (self._wall + 1)
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    for side, x, y in ((self._right, a, b), (self._left, b, a)):
                        if side[x] is none:
                            side[x] = {}
                        side[x][y] = rank
        self._text_of_id = {rank: str(rank) for rank in self.tokens}
        self._text_of_chunk, self._text_of_piece = _Memo(), _Memo()
        self._token_of_text = {str(rank): token for rank, token in self.tokens.items()}

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        return self._merge_all([piece])[0]

    def _merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each."""
        right, left, leaf = self._right, self._left, self.leaf
        part: list[int] = []  # the rank of what starts at each place; one merged away is stale
        walls: list[int] = []
        for piece in pieces:
            part += map(self._bytes.__getitem__, piece)
            walls.append(len(part))
            part.append(self._wall)
        n = len(part)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))  # before the first place is -1, the last wall
        waiting = [*(right[a].get(b, -1) for a, b in pairwise(part)), -1]  # the rank of the pair that starts here
        buckets = _Buckets(leaf)
        for i, rank in enumerate(waiting):
            if rank >= 0:
                buckets[rank].append(i)
        while top := buckets.top:
            low = top & -top
            word = low.bit_length() - 1
            bits = leaf[word]
            first = bits & -bits
            leaf[word] = bits ^ first
            if bits == first:
                buckets.top = top ^ low
            rank = word * WORD + first.bit_length() - 1
            places = buckets.pop(rank)
            if len(places) > 1:
                places.sort()
            on_right, on_left, stop = right[rank].get, left[rank].get, -1
            for i in places:
                if waiting[i] != rank:
                    continue  # stale: merged away, or its pair has changed
                if i < stop:
                    buckets[rank].append(i)
                    continue
                j = nxt[i]
                waiting[j] = -1
                nxt[i] = after = nxt[j]
                prv[after] = i
                part[i] = rank
                waiting[i] = r = on_right(part[after], -1)
                if r >= 0:
                    buckets[r].append(i)
                before = prv[i]
                waiting[before] = q = on_left(part[before], -1)
                if q >= 0:
                    buckets[q].append(before)
                if -1 < r < rank or -1 < q < rank:  # a lower rank came up: the rest of this piece waits its turn
                    stop = walls[bisect(walls, i)]
        out, start = [], 0
        for wall in walls:
            found, i = [], start
            while i < wall:
                found.append(part[i])
                i = nxt[i]
            out.append(found)
            start = wall + 1
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _texts_of(self, pieces: list[str]) -> Iterator[tuple[str, str]]:
        """Each piece with the text of its ids."""
        text_of, block, size = self._text_of_id.__getitem__, [], 0
        for last, piece in enumerate(pieces, 1 - len(pieces)):
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                yield piece, text_of(whole)
            else:
                block.append((piece, data))
                size += len(data)
            if block and (size >= TOGETHER or not last):
                for (one, _), found in zip(block, self._merge_all([d for _, d in block]), strict=True):
                    yield one, ",".join(map(text_of, found))
                block, size = [], 0

    def _of_group(self, texts: list[str]) -> list[str]:
        of_chunk, of_piece = self._text_of_chunk, self._text_of_piece
        cut = [chunks(t) if t else [] for t in texts]
        heads = [self.pieces(c.pop(0)) if c else [] for c in cut]
        new = {chunk: self.pieces(" " + chunk) for chunk in of_chunk.unknown(set().union(*cut))}
        pieces = of_piece.unknown(set(chain.from_iterable(chain(heads, new.values()))))
        of_piece.update(self._texts_of(pieces))
        of_chunk.update((chunk, ",".join(map(of_piece.__getitem__, found))) for chunk, found in new.items())
        out = [",".join([*map(of_piece.__getitem__, head), *map(of_chunk.__getitem__, rest)]) for head, rest in zip(heads, cut, strict=True)]
        of_chunk.forget(new)
        of_piece.forget(pieces)
        return out

    def ids_texts(self, texts: Iterable[str]) -> Iterator[str]:
        """Of each text the decimal ids joined by commas."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._of_group(group)
                group, size = [], 0
        yield from self._of_group(group)

    def ids_text(self, text: str) -> str:
        return self._of_group([text])[0]

    def decode_ids_text(self, ids: str) -> bytes:
        return b"".join(map(self._token_of_text.__getitem__, ids.split(","))) if ids else b""


class _Buckets(dict):
    """Rank -> places. A rank that comes up gets its bits in the bitmap's words and in ``top``, the summary."""

    def __init__(self, leaf: list[int]) -> None:
        self.leaf, self.top = leaf, 0

    def __missing__(self, rank: int) -> list[int]:
        self.leaf[rank // WORD] |= _BIT[rank % WORD]
        self.top |= _BIT[rank // WORD]
        self[rank] = places = []
        return places


class _Memo(dict):
    """Remembers short keys in two generations of about MEMO_ENTRIES, a group's own beyond it: the older one is dropped
    when the younger is full, and what is asked for again moves to the younger, so frequent keys stay."""

    def __init__(self) -> None:
        self.older: dict[str, str] = {}

    def unknown(self, keys: set[str]) -> list[str]:
        """Those of the keys that neither generation has; all others are in the younger one after it."""
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        older, out = self.older, []
        for key in [k for k in keys if k not in self]:  # set.difference would go through all of this memo
            value = older.get(key)
            if value is None:
                out.append(key)
            else:
                self[key] = value
        return out

    def forget(self, keys: Iterable[str]) -> None:
        """Long ones among the keys go."""
        for key in keys:
            if len(key) > 64:
                del self[key]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, *, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: every whole text encoded."""
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [[int(i) for i in s.split(",")] if s else [] for s in c.ids_texts(t.as_py() or "" for t in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, *, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, bytes binary: the decoded ids."""
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    rows = encoded.select("doc_id", "ids")
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, *, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes those ids, and returns digests of both."""
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for ids in c.ids_texts(t.as_py() or "" for t in batch.column(1)):
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(c.decode_ids_text(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
