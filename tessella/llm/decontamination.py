"""Benchmark decontamination: rare n-gram seeds join texts to test items, Smith-Waterman scores what they seed.

Every n-gram of the test items is counted over all texts (by documents that hold it); one that no document holds is
no seed. Two words that follow each other in the item also count as held with one word between them in the text. An
alignment that reaches the threshold holds at least ``least_hits`` of an item's pairs, so the rarest are its seeds, as
many as leave fewer than that out: every such alignment meets a seed, however often edited copies have leaked. A
document that holds a seed of an item is aligned with it: Smith-Waterman over words, on the stretch around each bundle
of seed hits. A pair is contaminated if the alignment's share of a perfect score reaches the threshold. Items of under
four words, and n other than 2, need one whole n-gram instead.

Test items are taken in blocks of a bounded number of n-grams; a block is sent to all tasks, and each block is one
pass over the texts. Texts themselves never travel.

Defined results: null and empty texts and items match nothing; items with fewer words than an n-gram are matched by
their whole sequence; repeated rows give repeated pairs only once per doc_id and item; a null doc_id gives pairs with
a null doc_id; without items or texts there are no pairs; extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import small_side, stored
from tessella.shipping import map_arrow

NGRAM = 2
#: n-grams of a block of items, at most; a block is a set of so many entries in each Python worker.
BLOCK_NGRAMS = 200_000
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.45
_WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str], n: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else [tuple(words)] if words else []


def align(item: list[str], text: list[str]) -> tuple[int, int, int, int]:
    """Smith-Waterman: score, words matched, start and end in text of the best local alignment."""
    width = len(text)
    score, count, origin = [0] * (width + 1), [0] * (width + 1), list(range(width + 1))
    best = (0, 0, 0, 0)
    for a in item:
        diag_s, diag_c, diag_o = 0, 0, 0
        left_s, left_c, left_o = 0, 0, 0
        for j in range(1, width + 1):
            up_s, up_c, up_o = score[j], count[j], origin[j]
            if text[j - 1] == a:
                s, c, o = diag_s + MATCH, diag_c + 1, diag_o if diag_s else j - 1
            else:
                s, c, o = diag_s + MISMATCH, diag_c, diag_o
            if up_s + GAP > s:
                s, c, o = up_s + GAP, up_c, up_o
            if left_s + GAP > s:
                s, c, o = left_s + GAP, left_c, left_o
            if s <= 0:
                s, c, o = 0, 0, j
            diag_s, diag_c, diag_o = up_s, up_c, up_o
            score[j], count[j], origin[j] = s, c, o
            left_s, left_c, left_o = s, c, o
            if s > best[0]:
                best = (s, c, o, j)
    return best


def least_hits(size: int, n: int, threshold: float) -> int:
    """How many of an item's ``size`` - 1 pairs an alignment of the threshold holds, at most one word between the two.

    Of m matches with m - 1 steps between them, h are such pairs, b pass over words of the item (at least 1 off, and
    m + b <= size) and the others over two words of the text (2 off). So the score is at most 2 h + b + 2, which is at
    most 1.5 h + size / 2 + 1.5, and must reach 2 threshold size."""
    return max(1, math.ceil((4 * threshold - 1) * size / 3 - 1 - 1e-9)) if n == 2 else 1


def stretches(places: list[int], size: int, length: int, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Parts of a text around the places, as far to both sides as an alignment may reach, merged where they touch."""
    # an item's words, and as many others as a perfect score can lose
    reach, out = size + math.ceil((MATCH - MATCH * threshold) * size) + 4, []
    for p in sorted(places):
        a, b = max(0, p - reach), min(length, p + reach)
        if out and a <= out[-1][1] and b - out[-1][0] <= 8 * reach:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _hit_counts(docs: DataFrame, wanted: frozenset, n: int, short: int) -> dict[tuple[str, ...], int]:
    """How many documents hold each wanted n-gram; at most BLOCK_NGRAMS rows reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value, defaultdict(int)
        for batch in batches:
            for value in batch.column(0):
                for g in held(known, tokens(value.as_py() or ""), n, short):
                    counts[g] += 1
        yield pa.RecordBatch.from_arrays([pa.array(["\x1f".join(g) for g in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    rows = map_arrow(docs.select("text"), run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {tuple(r["gram"].split("\x1f")): r["n"] for r in rows}


def held(known: frozenset, words: list[str], n: int, short: int) -> frozenset:
    """The known n-grams among the words, pairs also around a word; ``short``: length of the shortest known one."""
    found = known.intersection(zip(*(words[k:] for k in range(n)), strict=False))
    if n == 2:
        found |= known.intersection(zip(words, words[2:], strict=False))
    for k in range(short, n):
        found |= known.intersection(zip(*(words[j:] for j in range(k)), strict=False))
    return found


def _blocks(items: list[tuple[object, list[str]]], n: int) -> Iterator[list[tuple[object, list[str]]]]:
    block, size = [], 0
    for item in items:
        more = max(1, len(item[1]))
        if block and size + more > BLOCK_NGRAMS:
            yield block
            block, size = [], 0
        block.append(item)
        size += more
    if block:
        yield block


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, *, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score (share of a perfect alignment), n_match, start_word, end_word of the best one."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    id_type, item_type = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    key_types = [to_arrow_type(rows.schema["doc_id"].dataType), to_arrow_type(items.schema["item_id"].dataType)]
    schema = f"doc_id {id_type}, item_id {item_type}, score double, n_match int, start_word int, end_word int"

    found = []
    # Items arrive one partition at a time, never all at once; each block is a pass over the texts.
    listed = ((r["item_id"], w) for r in items.orderBy("item_id", "text").toLocalIterator() if (w := tokens(r["text"])))
    for block in _blocks(listed, n):
        of_item = [Counter(grams(w, n)) for _, w in block]
        every = frozenset(g for gs in of_item for g in gs)
        short = min(map(len, every))
        counts = _hit_counts(rows, every, n, short)
        seeds: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for k, gs in enumerate(of_item):
            spare = least_hits(len(block[k][1]), n, threshold) - 1  # pairs that need not be seeds: the most frequent
            for g in sorted((g for g in gs if g in counts), key=lambda g: (counts[g], g), reverse=True):
                spare -= gs[g]
                if spare < 0:
                    seeds[g].append(k)
        shared = spark.sparkContext.broadcast((block, of_item, dict(seeds), short))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, of_item, seeds, short = shared.value
            known = frozenset(g for gs in of_item for g in gs)
            bags = [frozenset(w) for _, w in block]
            for batch in batches:
                out: list[list] = [[] for _ in range(6)]
                ids = batch.column(0)
                for row, value in enumerate(batch.column(1)):
                    words = tokens(value.as_py() or "")
                    hit = held(known, words, n, short)
                    if not hit:
                        continue
                    for k, best in scored(block, of_item, bags, seeds, hit, words, n, short, threshold).items():
                        for column, x in zip(out, (ids[row].as_py(), block[k][0], *best), strict=True):
                            column.append(x)
                types = [*key_types, pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "item_id", "score", "n_match", "start_word", "end_word"])

        found.append(stored(map_arrow(rows, run, schema), "contaminated"))
    if not found:
        return spark.createDataFrame([], schema)
    every_pair = found[0]
    for part in found[1:]:
        every_pair = every_pair.unionByName(part)
    return every_pair.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "n_match", "start_word", "end_word")).alias("best")).select("doc_id", "item_id", "best.*")


def scored(block, of_item, bags, seeds, hit, words, n, short, threshold) -> dict[int, tuple[float, int, int, int]]:
    """Item of the block -> (score, words matched, start, end) for those that reach the threshold."""
    near = {k for g in hit for k in seeds.get(g, ())}
    near = {k for k in near if sum(m for g, m in of_item[k].items() if g in hit) >= least_hits(len(block[k][1]), n, threshold)}
    if not near:
        return {}
    places: dict[int, list[int]] = defaultdict(list)
    runs = [zip(*(words[k:] for k in range(size)), strict=False) for size in range(short, n + 1)]
    if n == 2:
        runs.append(zip(words, words[2:], strict=False))
    for run in runs:
        for at, g in enumerate(run):
            if g in hit:
                for k in seeds.get(g, ()):
                    if k in near:
                        places[k].append(at)
    out = {}
    for k, ats in places.items():
        item = block[k][1]
        perfect = MATCH * len(item)
        best = (0, 0, 0, 0)
        for a, b in stretches(ats, len(item), len(words), threshold):
            part = words[a:b]
            there = set(part)
            # the alignment can't match more words of the item than stand in the stretch
            if MATCH * sum(w in bags[k] for w in part) < threshold * perfect or MATCH * sum(w in there for w in item) < threshold * perfect:
                continue
            s, c, x, y = align(item, part)
            best = max(best, (s, c, a + x, a + y))
        if best[0] >= threshold * perfect:
            out[k] = (best[0] / perfect, best[1], best[2], best[3])
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a contaminated passage; all columns as they are. Rows without doc_id stay."""
    bad = stored(contaminated_pairs(docs, benchmark, **options).select("doc_id").where("doc_id is not null").distinct(), "leaks")
    return docs.join(small_side(bad), "doc_id", "left_anti").select(docs.columns)
