from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessella.llm import bpe, token_counts

random.seed(5)
TEXTS = [
    *("", " ", "  a", "a  ", "\n\n x", " x", "x ", "it's 12 ... ² 中文 x\x1cy", "<|endoftext|> hi", "é" * 700, "ab" * 2000, "!" * 999, "a\r\nb", "tab\tb", "zero​width", "ǅ ⅷ ٣"),
    *("".join(random.choice("ab \n1.é中'") for _ in range(random.randint(1, 80))) for _ in range(200)),
]


@pytest.fixture(scope="module")
def reference():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_library(reference):
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for text in TEXTS:
        ids = reference.encode_ordinary(text)
        assert codec.encode(text) == ids
        assert codec.ids_text(text) == ",".join(map(str, ids))
        assert codec.decode(ids) == codec.decode_ids_text(codec.ids_text(text)) == text.encode()
        assert not any(codec.leaf)


def test_queue_takes_every_pre_token_that_is_no_token(reference, monkeypatch):
    """Short and very long ones alike; merges against rescanning for the lowest rank, leftmost first."""
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    merged = []
    real = codec._merge
    monkeypatch.setattr(codec, "_merge", lambda piece: merged.append(piece) or real(piece))
    r = random.Random(2)
    pieces = {bytes(r.choice(b"abinthe\xc3\xa9") for _ in range(n)) for n in [2, 3, 5, 9, 20, 33, 64] * 60} | {b"ab" * 700}
    for piece in pieces:
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while found := [(codec.ranks[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in codec.ranks]:
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert codec.encode_piece(piece) == [codec.ranks[x] for x in parts]
    assert sorted(merged) == sorted(p for p in pieces if p not in codec.ranks)
    text = "".join(r.choice("abcdeinth") for _ in range(300_000))
    assert codec.encode(text) == reference.encode_ordinary(text)


def test_round_trip_query(spark, reference):
    rows = [(k, t, "clash") for k, t in enumerate([None, *TEXTS])] + [(None, "x", "clash"), (0, None, "clash")]
    found = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    want = []
    for doc, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    encoded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"))
    assert {(r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded).collect()} == {(d, (t or "").encode()) for d, t, _ in rows}


def test_counts_equal_library(spark, tmp_path):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(k, t, "clash") for k, t in enumerate([None, *TEXTS, TEXTS[5], "w " * 3000])] + [(None, TEXTS[5], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted(((d, len((t or "").encode()), n := count(t), n > 1024) for d, t, _ in rows), key=str)
    cache = str(tmp_path / "cache")
    assert sorted(map(tuple, token_counts.token_counts(docs, cache_path=cache).collect()), key=str) == want
    known = spark.read.parquet(cache)
    assert known.count() == len({t or "" for _, t, _ in rows})
    again = token_counts.token_counts(docs.union(spark.createDataFrame([(999, "fresh text", "")], docs.schema)), cache_path=cache)
    assert sorted((tuple(r) for r in again.collect() if r.doc_id != 999), key=str) == want
    assert spark.read.parquet(cache).count() == known.count() + 1  # only the miss was encoded


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = P.path(name)
    counter = token_counts.Counter(path)
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        library.no_truncation()
        want = [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(TEXTS)]
    assert [counter(t) for t in TEXTS] == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs).collect() == []
    assert bpe.round_trip(docs).collect() == []


def test_new_pieces_of_a_group_share_a_queue(monkeypatch):
    """Pieces that are merged together get the ids that each gets alone, and a group of texts asks for them at once."""
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    r = random.Random(5)
    pieces = [bytes(r.choice(b"abcdeothen r") for _ in range(r.randint(1, 40))) for _ in range(300)] + [b"a" * 999, "é世".encode() * 50, b"\x80\xff" * 9, b" " * 300]
    assert codec._merge_all(pieces) == [codec._merge(p) for p in pieces] and not any(codec.leaf)
    calls = []
    real = codec._merge_all
    monkeypatch.setattr(codec, "_merge_all", lambda block: calls.append(len(block)) or real(block))
    texts = [" ".join("".join(r.choice("qxzjkv") for _ in range(9)) for _ in range(20)) for _ in range(30)] + ["", "z" * 80]
    reference = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert list(codec.ids_texts(texts)) == [",".join(map(str, reference.encode_ordinary(t))) for t in texts]
    assert len(calls) == 1 and calls[0] > 500
