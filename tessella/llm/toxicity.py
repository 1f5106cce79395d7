"""Toxicity of texts whose words may be disguised: a noisy-channel decoder restores them, then a lexicon scores them.

A token that looks disguised (symbols or digits among letters, letters repeated three times or more), and three or
more single letters spaced out, span a lattice of characters: look-alikes stand for letters, runs shrink to one or two,
separators and spaces vanish or are borders of words. Viterbi takes the path that a character trigram model and the
channel's costs like best, over any length, and what it restores is scored word by word. Neighbouring tokens
that are a lexicon word when put together ("id iot"), as they are or, where one mixes letters with other signs, decoded
("1d 10t"), count as that word. Words and word
beginnings that labelled toxic documents use far more than others form the lexicon; a logistic model over how strong
and how many a text's hits are gives the score.

Labels are learned from only where crc32(doc_id as text) mod 5 is not 0, from at most ``train_rows`` labelled rows,
chosen by a hash; that bound concerns the lexicon and the logistic fit alone, and is the only one: every feature of
those rows may enter the lexicon. The character model counts the words of
all texts, and every row of the input is scored.

Defined results: null or empty text gets the score of a text without hits; repeated rows each keep their row; a null
doc_id is not held out and not learned from; without labels of both kinds every score is 0; an empty table gives no
rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_side, stored
from tessella.shipping import map_arrow

TRAIN_ROWS = 20_000
MEMO_ENTRIES = 250_000
PREFIXES = (3, 4, 5, 6)

LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
SEPARATORS = frozenset(".-_*~^'`,/\\")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—·"
_RUN = re.compile(r"(.)\1\1")
_LONG_RUN = re.compile(r"(.)\1{3,}")
_SPACED_SIGN = re.compile(r"(?<!\S)[\w@$!](?:[ ._*-][\w@$!]){2,}(?!\S)")
_WIDE = re.compile("[\u2e80-\U0010ffff]")
_START, _END = "^", "$"


def _folded(text: str) -> str:
    """Ideographs and syllables as one character, so that the table of trigrams stays one of alphabets."""
    return text if text.isascii() else _WIDE.sub("\u4e00", text)


def trigrams_of(words: dict[str, int]) -> Counter[str]:
    out: Counter[str] = Counter()
    for word, n in words.items():
        s = _START + _START + _folded(word) + _END
        for k in range(2, len(s)):
            out[s[k - 2 : k + 1]] += n
    return out


class CharModel:
    """Character trigrams with interpolation, learned from words and their counts, and from trigrams and theirs."""

    def __init__(self, words: dict[str, int], trigrams: dict[str, int] | None = None) -> None:
        self.tri: Counter[str] = trigrams_of(words)
        self.tri.update(trigrams or {})
        self.bi: Counter[str] = Counter()
        self.uni: Counter[str] = Counter()
        for s, n in self.tri.items():
            self.bi[s[:2]] += n
            self.uni[s[2]] += n
        self.total = sum(self.uni.values()) or 1
        self.memo: dict[str, float] = {}

    def cost(self, before: str, char: str) -> float:
        """-log of the probability of char after two characters."""
        key = before + char
        found = self.memo.get(key)
        if found is None:
            s = _folded(key)
            low = (self.uni[s[2]] + 0.5) / (self.total + 60)
            found = self.memo[key] = -math.log((self.tri[s] + 5 * low) / (self.bi[s[:2]] + 5))
        return found


def disguised(token: str) -> bool:
    """Whether a token, its edges stripped of punctuation, needs decoding."""
    return bool(_RUN.search(token)) or not token.isalpha()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place the strings that may stand there and what they cost in the channel; '' drops the place, a
    space is a border of words."""
    out = []
    run = 0
    for k, c in enumerate(token):
        run = run + 1 if k and token[k - 1] == c else 1
        if c.isalpha():
            # the second letter of a run may be dropped, further ones are
            again = [(c, 0.2), ("", 1.0)] if run == 2 else [("", 0.1)]
            out.append([(c, 0.0)] if run == 1 else again)
            continue
        ways = [(x, 0.7) for x in LOOKALIKES.get(c, "")]
        if not c.isalnum() and (c in SEPARATORS or not ways):
            ways.append((" ", 0.5))
        if c in SEPARATORS or run > 1 or not ways or ways[-1][0] == " ":
            ways.append(("", 0.5))
        out.append(ways)
    return out


def restore(token: str, model: CharModel) -> str:
    """Viterbi over the lattice: state, the last two characters; linear in the token. Words with single spaces between."""
    fresh = _START + _START
    best: dict[str, tuple[float, tuple | None]] = {fresh: (0.0, None)}  # the path as (path before, character)
    for ways in lattice(_LONG_RUN.sub(r"\1\1\1", token)):
        step: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, path) in best.items():
            for char, price in ways:
                new, to, way = cost + price, state, path
                if char == " ":
                    if state != fresh:
                        new, to, way = new + model.cost(state, _END), fresh, (path, char)
                elif char:
                    new, to, way = new + model.cost(state, char), (state + char)[-2:], (path, char)
                if to not in step or new < step[to][0]:
                    step[to] = (new, way)
        best = step
    path = min(((cost + (model.cost(state, _END) if state != fresh else 0.0), state) for state, (cost, _) in best.items()))[1]
    out, path = [], best[path][1]
    while path:
        path, char = path
        out.append(char)
    return "".join(reversed(out)).strip()


class Model(NamedTuple):
    lexicon: dict[str, float]  # a word, or a beginning with "*" behind it -> log-odds of toxic documents
    words: dict[str, int]  # those of the lexicon, for the character model
    trigrams: dict[str, int]  # of all texts' words, each once a text
    weights: tuple[float, float, float, float] | None  # None: nothing to learn from


class _Scores(dict):
    """Token -> log-odds of each toxic word of its restored form; none if it's in no way toxic."""

    def __init__(self, model: Model) -> None:
        self.lexicon, self.chars = model.lexicon, CharModel(model.words, model.trigrams)
        self.whole = {w: s for w, s in model.lexicon.items() if not w.endswith("*")}
        self.longest = max(map(len, self.whole), default=0)
        self.beginnings = {w[:n] for w in self.whole for n in range(1, len(w))}
        self.pieces = _Pieces(self)

    def of_word(self, word: str) -> float:
        get = self.lexicon.get
        return max([get(word, 0.0), *(get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) > n)])

    def of_restored(self, token: str) -> tuple[float, ...]:
        return tuple(s for w in restore(token, self.chars).split() if (s := self.of_word(w)))

    def of_token(self, token: str) -> tuple[float, ...]:
        bare = token.strip(_EDGE)
        if not bare:
            return ()
        score = self.of_word(bare) if bare.isalpha() else self.whole.get(bare, 0.0)
        if score:
            return (score,)
        found: tuple[float, ...] = ()
        if disguised(bare) and any(map(str.isalpha, bare)):
            found = self.of_restored(bare) or tuple(filter(None, [self.of_word(bare)]))
        if not found and bare != token and token[:1] in "$@!":
            found = self.of_restored(token.rstrip(_EDGE))
        return found

    def of_spaced(self, span: str) -> tuple[float, ...]:
        """Single characters spaced out: put together, or what the lattice with its spaces restores."""
        score = self.whole.get("".join(c for c in span if c not in " ._*-"), 0.0)
        return (score,) if score else self.of_restored(span)

    def of_pieces(self, tokens: list[str]) -> list[float]:
        """Lexicon words that stand over two tokens or more, none of which is toxic by itself."""
        kinds = list(map(self.pieces.__getitem__, tokens))
        out, free = [], 0
        for k in [k for k, kind in enumerate(kinds) if kind]:
            if k < free:
                continue
            start = tokens[k].strip(_EDGE)
            glued = start
            if kinds[k] & START:
                for m in range(k + 1, len(tokens)):
                    more = tokens[m].strip(_EDGE)
                    glued += more
                    if not more or len(glued) > self.longest or self[tokens[m]]:
                        break
                    if glued in self.whole and (m - k > 1 or len(start) > 1 or len(more) > 1):
                        out.append(self.whole[glued])
                        free = m + 1
                        break
                    if glued not in self.beginnings:
                        break
            if k >= free and kinds[k] & MIXED:
                for a, b in ((k, k + 1), (k - 1, k)):
                    if free <= a and 0 <= a and b < len(tokens):
                        both = [tokens[x].strip(_EDGE) for x in (a, b)]
                        if min(map(len, both)) > 1 and sum(map(len, both)) <= 2 * self.longest and not self[tokens[a]] and not self[tokens[b]]:
                            score = self.whole.get(restore("".join(both), self.chars), 0.0)
                            if score:
                                out.append(score)
                                free = b + 1
                                break
        return out

    def __missing__(self, token: str) -> tuple[float, ...]:
        found = self.of_token(token)
        if len(token) <= 64:  # longer ones are scored each time
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[token] = found
        return found


START, MIXED = 1, 2


class _Pieces(dict):
    """Token -> whether a lexicon word may begin with it, and whether it mixes letters with signs that stand for them;
    0 for tokens that are toxic by themselves."""

    def __init__(self, scores: _Scores) -> None:
        self.scores = scores

    def __missing__(self, token: str) -> int:
        bare = token.strip(_EDGE)
        kind = 0
        if bare and not self.scores[token]:
            mixed = 1 < len(bare) <= self.scores.longest and not bare.isalpha() and any(map(str.isalpha, bare)) and any(c in LOOKALIKES for c in bare)
            kind = START * (bare in self.scores.beginnings) | MIXED * mixed
        if len(token) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[token] = kind
        return kind


def hits(text: str, scores: _Scores) -> tuple[float, float, float]:
    """Strongest hit, log of 1 + their sum, log of 1 + how many a hundred words."""
    low = text.lower()
    tokens = low.split()
    found = [s for t in tokens for s in scores[t]]
    spaced = [m.span() for m in _SPACED_SIGN.finditer(low)]
    for a, b in spaced:
        found += scores.of_spaced(low[a:b])
    parts = [low[a:b] for a, b in zip([0, *(b for _, b in spaced)], [*(a for a, _ in spaced), len(low)], strict=True)] if spaced else [low]
    for part in parts:
        found += scores.of_pieces(part.split() if spaced else tokens)
    if not found:
        return 0.0, 0.0, 0.0
    return max(found), math.log1p(sum(found)), math.log1p(100 * len(found) / max(1, len(tokens)))


def features_of(text: str) -> set[str]:
    """Words and word beginnings of a text, for the lexicon."""
    out: set[str] = set()
    for token in set(text.lower().split()):
        word = token.strip(_EDGE)
        if word.isalpha():
            out.add(word)
            out.update(word[:n] + "*" for n in PREFIXES if len(word) > n)
    return out


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def logistic(rows: list[tuple[tuple[float, ...], int]], steps: int = 400) -> tuple[float, ...]:
    """Bias and weights by Newton's method with a small ridge."""
    import numpy as np

    x = np.array([(1.0, *r) for r, _ in rows])
    y = np.array([float(v) for _, v in rows])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.5
    for _ in range(min(steps, 25)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
    return tuple(map(float, w))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def char_counts(docs: DataFrame) -> dict[str, int]:
    """How often each character trigram stands in the words of all texts, a word once a text; "": how many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            words: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                words.update({w for t in set((text or "").lower().split()) if (w := t.strip(_EDGE)).isalpha()})
            counts.update(trigrams_of(words))
            counts[""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["s", "n"])

    rows = map_arrow(docs.select("text"), run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {r["s"]: r["n"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = stored(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labelled")
    sample = stored(docs.join(small_side(chosen, max(train_rows, 1)), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic"), "sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Model({}, {}, {}, None)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(features_of(text or ""))
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["f", "a", "b"])

    counts = stored(map_arrow(sample, emit, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "features")
    at, bt = totals[1], totals[0]
    ratio = F.log((F.col("a") + 0.1) / (at + 1)) - F.log((F.col("b") + 0.5) / (bt + 1))
    sure = ratio - 1.0 * F.sqrt(1 / (F.col("a") + 0.1) + 1 / (F.col("b") + 2.0))
    strong = counts.where(F.col("a") >= max(5, 0.004 * at)).withColumn("s", sure).where("s > 2.0")
    # a feature stands in 1 of 250 of the toxic rows at least, so their number is bounded by how many a text has
    lexicon = {r["f"]: float(r["s"]) for r in strong.collect()}
    trigrams = char_counts(docs)
    texts = trigrams.pop("", 0)
    words: dict[str, int] = {}
    # a lexicon word must be likely enough to be restored, however rare it is among all words
    for f in lexicon:
        if not f.endswith("*"):
            words[f] = max(50, texts // 20)

    unfitted = Model(lexicon, words, trigrams, None)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(unfitted)
        for batch in batches:
            rows = [hits(t or "", scores) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.float64()) for k in range(3)), batch.column(1)], ["x0", "x1", "x2", "toxic"])

    rows = map_arrow(sample, seen, "x0 double, x1 double, x2 double, toxic int").collect()
    return Model(lexicon, words, trigrams, logistic([((r["x0"], r["x1"], r["x2"]), r["toxic"]) for r in rows]))


def toxicity(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(rows, labels.select(F.col(id_col).alias("doc_id"), "toxic"), train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the fit's bounded rows, and the trigrams of alphabets

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        scores = _Scores(fitted)
        for batch in batches:
            out = []
            for value in batch.column(1):
                if fitted.weights is None:
                    out.append(0.0)
                    continue
                x = hits(value.as_py() or "", scores)
                out.append(sigmoid(sum(a * b for a, b in zip(fitted.weights, (1.0, *x), strict=True))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = map_arrow(rows, score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
