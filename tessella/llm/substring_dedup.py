"""Removal of repeated lines, paragraphs and sentences within them, by digests grouped over the whole corpus.

A text is cut into lines (or paragraphs), and those into sentences, which end with a run of .!? and the white space
behind it. Each line and each sentence of a line of several is a unit, so a passage is found where it fills a line
and where it stands inside one that is otherwise different. A unit of enough words is known by the digest of its
normalised form: its words in lower case, joined by single spaces. The earliest occurrence of a digest, by (doc_id,
start), stays where it is; every other one is removed, with its offsets in the original text kept. A sentence's
earliest occurrence always stays: what would remove the line around it holds the sentence earlier still. A line that
loses everything goes with its line break.

Digests are grouped, not texts: the earliest occurrence is a minimum that is aggregated before the shuffle, so a unit
that stands in a third of all rows is one value from each task, and the join back to its occurrences is one that AQE
splits where it is skewed. Nothing is broadcast.

Defined results: null text counts as empty and stays empty; repeated rows share doc_id and positions, so their units
are one occurrence and stay in each of them; a row with a null doc_id ranks after all others; an empty table gives no
rows; extra columns of the input are ignored, whatever their names.

Passages (passage_dedup) are found wherever they begin and end, with or without lines and sentences. Words are divided by
ASCII white space; in scripts without spaces each character is a word. Every run of PASSAGE_WORDS words, in lower case,
is a unit. Its earliest occurrence, by (doc_id, start), stays; every other one goes that is in another document, or in
the same one behind the end of the earliest. Units overlap, so what goes are the longest runs of words that are covered
by units that go. Each of these words stays in an earlier place, though not always with the same neighbours: where a
document holds a passage that overlaps with one of an earlier document, it keeps what the overlap leaves. The white
space behind a word goes with it.

Not all runs are shuffled: each is marked by the least of the hashes of the shorter runs in it, equal runs by equal
marks, and neighbours of one mark are one row, a stretch; there are about a thirteenth as many as runs. A mark that
stands once in the corpus has no repeat. Where all stretches of a mark are alike (64-bit mark and 64-bit hash of the
words), each is compared as a whole, since its runs have the same places in all of them. The runs of other stretches are
compared by 128-bit digests, for which texts meet them by a join; so texts are shuffled twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, stored
from tessella.shipping import map_arrow

#: Units of fewer words stay: headings, phrases and short sentences recur by themselves.
LEAST_WORDS = 16
GAPS = {"line": "\n", "paragraph": "\n\n"}
#: Tiles a line: sentences with the white space behind them, and what is left without an end.
SENTENCE = "[^.!?]*[.!?]+[\\x09-\\x0D\\x20]*|[^.!?]+"
_SENTENCE = re.compile(SENTENCE)
#: A passage is "over 50 words".
PASSAGE_WORDS = 51
SPACE = "\\x09-\\x0D\\x20"
#: Thai, Lao, Burmese, Khmer, kana, Han: characters of scripts without spaces.
_APART = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Tiles a text behind its leading white space: words with the white space behind them.
WORD = f"(?:[{_APART}]|[^{SPACE}{_APART}]+)[{SPACE}]*"
_WORD, _HAS_APART = re.compile(WORD), re.compile(f"[{_APART}]")
_APART_RANGES = [(ord(a), ord(b)) for a, b in re.findall("(.)-(.)", _APART)]
_MEMO_WORDS = 200_000


def digest_of(part: str, least_words: int) -> bytes | None:
    """Digest of a unit's normalised form; None if it has too few words."""
    norm = part.lower().split()
    return hashlib.blake2b(" ".join(norm).encode(), digest_size=16).digest() if len(norm) >= least_words else None


def spans_of(text: str, gap: str, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    """start, end and digest of each unit."""
    here = 0
    for part in text.split(gap):
        whole = digest_of(part, least_words)
        if whole:  # a part of too few words has no sentence of enough
            yield here, here + len(part), whole
            sentences = list(_SENTENCE.finditer(part))
            if len(sentences) > 1:
                for m in sentences:
                    own = digest_of(m.group(), least_words)
                    if own:
                        yield here + m.start(), here + m.end(), own
        here += len(part) + len(gap)


def without(text: str, gap: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, and without the parts of which nothing is left."""
    out, here = [], 0
    waiting = sorted(spans)
    for part in text.split(gap):
        end = here + len(part)
        kept, at, cut = [], here, False
        while waiting and waiting[0][0] < end:
            a, b = waiting.pop(0)
            kept.append(text[at:a])
            at, cut = b, True
        kept.append(text[at:end])
        left = "".join(kept)
        if left.strip() or not cut:
            out.append(left)
        here = end + len(gap)
    return gap.join(out)


def units(docs: DataFrame, *, unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, td, text) -> doc_id, td, start, end, digest: every unit of enough words. td: hash of the whole text."""
    gap = GAPS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, end, digest = [], [], [], []
            for row, value in enumerate(batch.column(2)):
                for a, b, d in spans_of(value.as_py(), gap, least_words):
                    rows.append(row)
                    start.append(a)
                    end.append(b)
                    digest.append(d)
            own = pa.array(rows, pa.int32())
            columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "td", "start", "end", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "td", "text"), run, f"doc_id {kind}, td long, start int, end int, digest binary")


class _Values(dict):
    """Digests of words, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        self[word] = value = hashlib.blake2b(word, digest_size=16).digest()
        return value


_VALUES = _Values()


def _word_values(text: str) -> np.ndarray:
    """Two rows with a value of each word."""
    lower = text.lower()
    found = [w.rstrip().encode() for w in _WORD.findall(lower)] if _HAS_APART.search(lower) else lower.encode().split()
    values = np.frombuffer(b"".join(map(_VALUES.__getitem__, found)), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(values.T)


def _places(text: str) -> np.ndarray:
    """Start of each word, and the text's length."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = (codes == 32) | (codes - np.uint32(9) < 5)
    begins = ~space
    begins[1:] &= space[:-1]
    if len(codes) and codes.max() >= _APART_RANGES[0][0]:
        apart = np.zeros(len(codes), bool)
        for a, b in _APART_RANGES:
            apart |= (codes >= a) & (codes <= b)
        begins |= apart
        begins[1:] |= apart[:-1] & ~space[1:]
    return np.r_[np.flatnonzero(begins), len(codes)].astype(np.int32)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs from those of their halves."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _rolled(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n values, by doubling."""
    out, size, h, m = None, 0, values, 1
    while True:
        if n & m:
            out, size = h if out is None else _joined(out[: len(h) - size], h[size:]), size + m
        if size == n:
            return out
        h, m = _joined(h[:-m], h[m:]), 2 * m


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours, by doubling."""
    m = 1
    while 2 * m <= n:
        values, m = np.minimum(values[:-m], values[m:]), 2 * m
    return values if m == n else np.minimum(values[: m - n], values[n - m :])


def marks_of(text: str, words: int) -> list[np.ndarray]:
    """Stretches of runs of so many words that have one mark: mark, hash of the stretch, index of its first run, number of
    runs, start and end of the first, end of the last; white space behind a run is part of it."""
    values = _word_values(text) if len(text) >= words else np.empty((2, 0))
    if values.shape[1] < words:
        return [np.empty(0, kind) for kind in (np.int64, np.int64, *[np.int32] * 5)]
    part = (words + 1) // 2
    marks, whole, places = _least(_rolled(values[0], part), words - part + 1), _rolled(values[1], words), _places(text)
    first = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
    n = np.diff(np.r_[first, len(marks)])
    # The first and the last run hold all words of a stretch whose runs share a short run
    alike = _joined(_joined(whole[first], whole[first + n - 1]), n.astype(np.uint64))
    return [marks[first].view(np.int64), alike.view(np.int64), first.astype(np.int32), n.astype(np.int32), places[first], places[first + words], places[first + n - 1 + words]]


def passages_of(text: str, words: int, stretches: list[dict]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """start, end and digest of the runs in stretches."""
    places = _places(text)
    runs = np.concatenate([np.arange(x["first"], x["first"] + x["n"]) for x in stretches])
    digests = np.stack([_rolled(v, words)[runs] for v in _word_values(text)], 1).tobytes()
    return places[runs], places[runs + words], [digests[k : k + 16] for k in range(0, len(digests), 16)]


def _stretches(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, td, text) -> stretches whose mark stands again: doc_id, td, first, n, start, end, stop, and the earliest
    place of the mark if all of its stretches are alike."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["mark", "alike", "first", "n", "start", "end", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [marks_of(value.as_py(), words) for value in batch.column(2)]
                own = pa.array(np.repeat(np.arange(len(found), dtype=np.int32), [len(x[0]) for x in found]))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *columns], ["doc_id", "td", *names])

    marks = stored(map_arrow(rows.select("doc_id", "td", "text"), run, f"doc_id {kind}, td long, mark long, alike long, first int, n int, start int, end int, stop int"), "marks")
    # More neighbours than can share one short run: that short run stands there twice
    most = words - (words + 1) // 2 + 1
    again = marks.groupBy("mark").agg(F.sum(F.when(F.col("n") > most, 2).otherwise(1)).alias("times"), F.min("alike").alias("lo"), F.max("alike").alias("hi"), F.max("n").alias("n_most"), F.min(_place()).alias("earliest"))
    same = (F.col("lo") == F.col("hi")) & (F.col("n_most") <= most)
    again = again.where("times > 1").select("mark", F.when(same, F.col("earliest")).alias("earliest"))
    found = stored(marks.join(again, "mark").select("doc_id", "td", *names[2:], "earliest"), "stretches")
    discard(marks)
    return found


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), "td", "start", "end")


def _runs(rows: DataFrame, stretches: DataFrame, words: int) -> DataFrame:
    """doc_id, td, start, end, digest of every run in stretches."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    spots = stretches.groupBy(F.col("doc_id").alias("r_id"), F.col("td").alias("r_td")).agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("stretches"))
    joined = rows.join(spots, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("td") == F.col("r_td"))).select("doc_id", "td", "text", "stretches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, end, digest = passages_of(batch.column(2)[row].as_py(), words, batch.column(3)[row].as_py())
                own = pa.array(np.full(len(start), row, np.int32))
                columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(start), pa.array(end), pa.array(digest, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "td", "start", "end", "digest"])

    found = stored(map_arrow(joined, run, f"doc_id {kind}, td long, start int, end int, digest binary"), "runs")
    rows.sparkSession.sparkContext._jvm.System.gc()  # shuffle files that nothing reads any more go with the driver's garbage
    return found


def passage_dedup(docs: DataFrame, *, words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As substring_dedup, for passages: the longest runs of words that go; first_doc_id and first_start are where the
    first unit of such a run stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("td"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    stretches = _stretches(rows, words)
    runs = _runs(rows, stretches.where("earliest IS NULL"), words)
    firsts = runs.groupBy("digest").agg(F.count("*").alias("n"), F.min(_place()).alias("earliest")).where("n > 1").drop("n")
    columns = ["doc_id", "td", "start", "end", "stop", "earliest"]
    units = stretches.where("earliest IS NOT NULL").select(columns).unionByName(runs.join(firsts, "digest").withColumn("stop", F.col("end")).select(columns))
    own = F.col("doc_id").eqNullSafe(F.col("earliest.doc_id")) & (F.col("td") == F.col("earliest.td"))
    again = units.where(~own | (F.col("start") >= F.col("earliest.end")))
    # At most one row a word of the document itself is gathered here
    gone = F.sort_array(F.collect_set(F.struct("start", F.col("stop").alias("end"), F.col("earliest.doc_id").alias("first_doc_id"), F.col("earliest.start").alias("first_start"))))
    removed = again.groupBy(F.col("doc_id").alias("r_id"), F.col("td").alias("r_td")).agg(gone.alias("gone"))
    joined = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("td") == F.col("r_td")), "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = [], []
            for value, found_spans in zip(batch.column(1), batch.column(2), strict=True):
                spans = []
                for g in found_spans.as_py() or ():
                    if spans and g["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], g["end"])
                    else:
                        spans.append(g)
                whole, left, at = value.as_py(), [], 0
                for s in spans:
                    left.append(whole[at : s["start"]])
                    at = s["end"]
                texts.append("".join(left) + whole[at:])
                lists.append(spans)
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc_id", batch.schema.field("doc_id").type), ("first_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, lists)), pa.int64()), pa.array(lists, kinds)], ["doc_id", "text", "n_removed", "removed"])

    return map_arrow(joined, run, f"doc_id {kind}, text string, n_removed long, removed array<struct<start:int,end:int,first_doc_id:{kind},first_start:int>>")


def substring_dedup(docs: DataFrame, *, unit: str = "line", least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what stays), n_removed, removed array<struct<start, end, first_doc_id, first_start>> in code points
    of the original text, end exclusive, ordered by start; sentences of a removed line aren't listed beside it."""
    gap = GAPS[unit]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("td"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = stored(units(rows, unit=unit, least_words=least_words), "units")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), "td", "start", "end")
    firsts = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    again = found.join(firsts, "digest").where(~place.eqNullSafe(F.col("first")))
    # At most one row a unit of the document itself is gathered here
    gone = F.sort_array(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))))
    removed = again.groupBy(F.col("doc_id").alias("r_id"), F.col("td").alias("r_td")).agg(gone.alias("gone"))
    joined = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("td") == F.col("r_td")), "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = [], []
            for value, found_spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                outer, free = [], 0
                for g in found_spans or ():  # by start, the longer one first: those inside a span taken are no others
                    if -g["back"] > free:
                        outer.append({"start": g["start"], "end": -g["back"], "first_doc_id": g["first_doc_id"], "first_start": g["first_start"]})
                        free = -g["back"]
                whole = value.as_py()
                texts.append(without(whole, gap, [(s["start"], s["end"]) for s in outer]) if outer else whole)
                lists.append(outer)
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc_id", batch.schema.field("doc_id").type), ("first_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, lists)), pa.int64()), pa.array(lists, kinds)], ["doc_id", "text", "n_removed", "removed"])

    return map_arrow(joined, run, f"doc_id {kind}, text string, n_removed long, removed array<struct<start:int,end:int,first_doc_id:{kind},first_start:int>>")


ORACLE = f"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents
), lines AS (
  SELECT doc_id, k, part, (sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(part) - 1)::BIGINT AS a, regexp_extract_all(part, '{SENTENCE}') AS ss FROM parts
), tiles AS (
  SELECT doc_id, k, a, ss, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS j FROM lines WHERE len(ss) > 0
), sentences AS (
  SELECT doc_id, k, j, s, len(ss) > 1 AS several, (a + sum(length(s)) OVER (PARTITION BY doc_id, k ORDER BY j) - length(s))::BIGINT AS a FROM tiles
), units AS (
  SELECT doc_id, k, -1 AS j, a, a + length(part) AS b, list_filter(string_split_regex(lower(part), '\\s+'), lambda w: w <> '') AS w FROM lines
  UNION ALL SELECT doc_id, k, j, a, a + length(s), list_filter(string_split_regex(lower(s), '\\s+'), lambda w: w <> '') FROM sentences WHERE several
), named AS (
  SELECT doc_id, k, j, a, b, array_to_string(w, ' ') AS n FROM units WHERE len(w) >= {LEAST_WORDS}
), firsts AS (
  SELECT n, min((doc_id, a, b)) AS f FROM named GROUP BY n
), gone AS (
  SELECT u.doc_id, u.k, u.j, u.a, u.b, f.f[1] AS first_doc, f.f[2] AS first_a FROM named u JOIN firsts f USING (n) WHERE f.f <> (u.doc_id, u.a, u.b)
), outer_ones AS (
  SELECT g.* FROM gone g WHERE g.j = -1 OR NOT EXISTS (SELECT 1 FROM gone o WHERE o.doc_id = g.doc_id AND o.k = g.k AND o.j = -1)
), kept AS (
  SELECT s.doc_id, s.k, coalesce(string_agg(s.s, '' ORDER BY s.j) FILTER (WHERE g.j IS NULL), '') AS t FROM sentences s LEFT JOIN outer_ones g ON g.doc_id = s.doc_id AND g.k = s.k AND (g.j = s.j OR g.j = -1) GROUP BY s.doc_id, s.k
), cut AS (
  SELECT DISTINCT doc_id, k FROM outer_ones
), left_lines AS (
  SELECT l.doc_id, l.k, CASE WHEN c.k IS NULL THEN l.part ELSE t.t END AS t FROM lines l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.k = l.k LEFT JOIN kept t ON t.doc_id = l.doc_id AND t.k = l.k
  WHERE c.k IS NULL OR trim(t.t) <> ''
), texts AS (
  SELECT doc_id, string_agg(t, chr(10) ORDER BY k) AS text FROM left_lines GROUP BY doc_id
), spans AS (
  SELECT doc_id, count(*) AS n, string_agg(a || ':' || b || ':' || first_doc || ':' || first_a, ',' ORDER BY a) AS spans FROM outer_ones GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.text, '') AS text, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(s.spans, '') AS spans
FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id
"""

PASSAGE_ORACLE = f"""
WITH tiles AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), words AS (
  SELECT doc_id, length(text) AS n_all, list_transform(ws, lambda w: lower(regexp_extract(w, '^[^{SPACE}]+'))) AS names, list_transform(ws, lambda w: length(w)) AS sizes FROM tiles WHERE len(ws) >= {PASSAGE_WORDS}
), lengths AS (
  SELECT doc_id, n_all - list_sum(sizes) AS lead, unnest(sizes) AS size, generate_subscripts(sizes, 1) AS p FROM words
), starts AS (
  SELECT doc_id, p, size, (lead + sum(size) OVER (PARTITION BY doc_id ORDER BY p) - size)::BIGINT AS a FROM lengths
), units AS (
  SELECT doc_id, list_transform(range(1, len(names) - {PASSAGE_WORDS - 2}), lambda k: array_to_string(names[k : k + {PASSAGE_WORDS - 1}], ' ')) AS ns FROM words
), numbered AS (
  SELECT doc_id, unnest(ns) AS n, generate_subscripts(ns, 1) AS p FROM units
), named AS (
  SELECT u.doc_id, u.p, s.a, u.n FROM numbered u JOIN starts s ON s.doc_id = u.doc_id AND s.p = u.p
), firsts AS (
  SELECT n, min((doc_id, p, a)) AS f FROM named GROUP BY n
), gone AS (
  SELECT u.doc_id, u.p, f.f[1] AS first_doc, f.f[3] AS first_a FROM named u JOIN firsts f USING (n) WHERE f.f[1] <> u.doc_id OR u.p >= f.f[2] + {PASSAGE_WORDS}
), heads AS (
  SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > {PASSAGE_WORDS}, true) AS head FROM gone
), islands AS (
  SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM heads
), runs AS (
  SELECT doc_id, k, min(p) AS p, max(p) + {PASSAGE_WORDS - 1} AS q, first(first_doc ORDER BY p) AS first_doc, first(first_a ORDER BY p) AS first_a FROM islands GROUP BY doc_id, k
), spans AS (
  SELECT r.doc_id, count(*) AS n, string_agg(x.a || ':' || (y.a + y.size) || ':' || r.first_doc || ':' || r.first_a, ',' ORDER BY r.p) AS spans
  FROM runs r JOIN starts x ON x.doc_id = r.doc_id AND x.p = r.p JOIN starts y ON y.doc_id = r.doc_id AND y.p = r.q GROUP BY r.doc_id
), leads AS (
  SELECT doc_id, text, ws, length(text) - coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS lead FROM tiles
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(t.w, '' ORDER BY t.p) FILTER (WHERE r.doc_id IS NULL), '') AS t
  FROM leads l JOIN (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM leads WHERE doc_id IN (SELECT doc_id FROM spans)) t ON t.doc_id = l.doc_id
  LEFT JOIN runs r ON r.doc_id = t.doc_id AND t.p BETWEEN r.p AND r.q GROUP BY l.doc_id
)
SELECT l.doc_id, CASE WHEN s.n IS NULL THEN l.text ELSE left(l.text, l.lead::BIGINT) || k.t END AS text, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(s.spans, '') AS spans
FROM leads l LEFT JOIN spans s ON s.doc_id = l.doc_id LEFT JOIN kept k ON k.doc_id = l.doc_id
"""
