"""Personal data found by labelers that vote, weighed by EM, and a span classifier trained on what they agree on.

Fixed patterns give the base spans, which always stay. Beside them, candidate spans (long digit runs, phones without a
plus sign, mails written out, secrets behind a key word, key-like tokens, titled or introduced names, names whose first
one the gazetteer knows, street addresses) are voted on by regex, gazetteer and context labelers; a labeler votes yes,
no or abstains. EM over the votes of all documents estimates the labelers' reliabilities and each vote pattern's
posterior. These posteriors train a logistic span classifier, which sees the votes and, beyond them, the span itself
(length, share of digits) and its context (what kind of word stands before it, whether it begins a line), so that it
tells apart spans on which the labelers agree alike. Votes and features are counted by pattern over all documents, a
bounded number of patterns. Candidates that it accepts are added unless they overlap a base span.

Defined results: null or empty text has no spans; repeated rows each keep their row; a null doc_id stays null; an
empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored
from tessella.shipping import map_arrow

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("tel", "mail", "number", "secret", "key", "name", "street")  # of equal spans the first kind counts
KINDS = BASE_KINDS + ADDED_KINDS

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){8,18}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?i)\b(password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s*[:=]\s*([\"']?)([^\s\"']{8,})")
_KEY = re.compile(r"(?<![0-9A-Za-z_/+-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{16,}|[0-9a-f]{32,64})(?![0-9A-Za-z_])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|name is|my name)\.? ((?:[A-Z][a-zà-ÿ]+ ?){1,3})(?<! )")
_STREET = re.compile(r"\b[0-9]{1,5} (?:[A-Z][a-zà-ÿ]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr)\b")
_TEL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_PREFIX = re.compile(r"\+[0-9]{1,3}[ .-]?$")  # what stands behind it is a base phone
_MAIL = re.compile(r"(?i)\b[a-z0-9][a-z0-9._%+-]* ?[\[({] ?at ?[\])}] ?[a-z0-9-]+(?: ?(?:[\[({] ?dot ?[\])}]|\.| dot ) ?[a-z0-9-]+)+")
_INTRO = re.compile(r"Mr|Mrs|Ms\b|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|name")

_NEAR = {
    "number": re.compile(r"(?i)\b(?:card|account|konto|iban|ssn|social|tel|phone|passport|id)\b"),
    "secret": re.compile(r"[0-9]"),
    "key": re.compile(r"(?i)\b(?:token|key|secret|password|aws|bearer|auth)\b"),
    "name": re.compile(r"(?i)\b(?:name|born|lives?|called|contact)\b"),
    "tel": re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono)\b"),
    "mail": re.compile(r"(?i)\b(?:mail|email|e-mail|contact|write|reach|courriel|correo)\b"),
    "street": re.compile(r"(?i)\b(?:address|lives?|street|home|wohnt|habite)\b"),
}
#: First names and place words that support a name or a street; a first name before another capitalised word proposes one.
FIRST_NAMES = frozenset(
    "James Mary John Anna Maria Robert Michael Peter Paul Laura Julia Thomas Sarah David Jean Pierre Marie Sophie Hans Klaus Jürgen Sabine José Carmen Juan Luis Ana Carlos "
    "Patricia Jennifer Linda Elizabeth William Richard Joseph Charles Christopher Daniel Matthew Anthony Steven Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Raymond Jack Dennis "
    "Barbara Susan Jessica Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Emma Nicole Helen Samantha Katherine Christine Rachel Carolyn Janet Catherine Heather Diane Olivia Julie Joyce Victoria "
    "Wolfgang Dieter Günter Werner Horst Helmut Manfred Uwe Jörg Stefan Andreas Markus Matthias Florian Tobias Lukas Jonas Ursula Monika Petra Renate Karin Brigitte Ingrid Heike Gabriele Susanne Katharina Anja Birgit "
    "François Philippe Alain Bernard Michel Jacques Gérard Nicolas Christophe Laurent Julien Mathieu Antoine Isabelle Nathalie Catherine Sylvie Martine Françoise Monique Valérie Sandrine Céline Camille Chloé Élodie Manon "
    "Antonio Manuel Francisco Javier Miguel Alejandro Rafael Pedro Ángel Sergio Pablo Fernando Jorge Alberto Álvaro Diego Adrián Isabel Dolores Pilar Teresa Rosa Cristina Lucía Marta Elena Raquel Beatriz Silvia Patricia Mercedes".split()
)
GAZETTEER = FIRST_NAMES | frozenset("Main Oak Park High Church Elm Maple Cedar Pine Lake Hill Station Mill School".split())
_KNOWN_NAME = re.compile(r"\b(?:" + "|".join(sorted(FIRST_NAMES, key=len, reverse=True)) + r") [A-Z][a-zà-ÿ]+(?:-[A-Z][a-zà-ÿ]+)?\b")
_CAPITALS = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]+ [A-ZÀ-Þ][a-zà-ÿ]")
LABELERS = ("shape", "context", "gazetteer", "entropy", "alone")
YES, ABSTAIN, NO = 2, 1, 0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the pattern, found from the @ signs, so that text without any costs nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_LEFT:
            start -= 1
        right = _EMAIL_RIGHT.match(text, at) if start < at else None
        if right:
            out.append((start, right.end()))
            free = right.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end, ordered by start, then kind as listed."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(spans, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def _entropy(s: str) -> float:
    return -sum((n := s.count(c) / len(s)) * math.log2(n) for c in set(s))


def _votes(kind: str, value: str, text: str, a: int, b: int) -> tuple[int, ...]:
    digits = sum(c.isdigit() for c in value)
    shape = {
        "number": YES if digits in (9, 16) else ABSTAIN,
        "secret": YES if digits >= 2 and len(value) >= 12 else NO if not digits else ABSTAIN,
        "key": YES if value.startswith(("AKIA", "gh", "sk-")) or digits >= 6 else NO,
        "name": YES if " " in value else ABSTAIN,
        "street": YES,
        "tel": YES if value[0] == "(" or len(set(value) & set(" .-")) == 1 else ABSTAIN,
        "mail": YES if re.search(r"(?i)\b(?:com|org|net|edu|de|fr|es|io)\b", value) else ABSTAIN,
    }[kind]
    around = text[max(0, a - 40) : a] + " " + (value if kind == "secret" else "") + " " + text[b : b + 20]
    context = YES if _NEAR[kind].search(around) else ABSTAIN
    known = any(w in GAZETTEER for w in value.split())
    gazetteer = (YES if known else NO) if kind in ("name", "street") else ABSTAIN
    e = _entropy(value)
    entropy = ABSTAIN if kind in ("name", "street", "mail") else YES if e >= 2.2 else NO if e < 1.5 else ABSTAIN
    left, right = text[a - 1 : a], text[b : b + 1]
    alone = YES if (not left or not left.isalnum()) and (not right or not right.isalnum()) else NO
    return shape, context, gazetteer, entropy, alone


#: Features beyond the votes, each with its number of values.
FEATURES = {"length": 4, "digits": 3, "before": 4, "line_start": 2}
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\s:=\"'(]*$")
_LINKING = frozenset("is by from of to at the a an and or mit von bei der die das und est de la le les et es el los y con por".split())


def _features(kind: str, value: str, text: str, a: int) -> tuple[int, ...]:
    digits = sum(c.isdigit() for c in value) / len(value)
    left = text[max(0, a - 30) : a]
    word = _WORD_BEFORE.search(left)
    before = 0 if not word else 3 if _NEAR[kind].search(word[1]) or _INTRO.search(word[1]) else 2 if word[1].lower() in _LINKING else 1
    return min(3, len(value) // 8), 0 if not digits else 1 if digits < 0.6 else 2, before, int(not left.rpartition("\n")[2].strip())


def candidates(text: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """kind, start, end, and votes with features, of spans beyond the base ones; not yet decided."""
    found: list[tuple[str, int, int]] = []
    low = None
    if _DIGIT.search(text):
        found += [("number", m.start(), m.end()) for m in _NUMBER.finditer(text)]
        found += [("key", m.start(), m.end()) for m in _KEY.finditer(text)]
        found += [("street", m.start(), m.end()) for m in _STREET.finditer(text)]
        found += [("tel", m.start(), m.end()) for m in _TEL.finditer(text) if not _PREFIX.search(text[max(0, m.start() - 5) : m.start()])]
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in ("passw", "pwd", "token", "secret", "api")):
            found += [("secret", m.start(3), m.end(3)) for m in _SECRET.finditer(text)]
    if any(c in text for c in "[({") and re.search(r"(?i)[\[({] ?at ?[\])}]", text):
        found += [("mail", m.start(), m.end()) for m in _MAIL.finditer(text)]
    if _INTRO.search(text):
        found += [("name", m.start(1), m.end(1)) for m in _NAME.finditer(text)]
    if _CAPITALS.search(text):
        found += [("name", m.start(), m.end()) for m in _KNOWN_NAME.finditer(text)]
    return [(k, a, b, _votes(k, text[a:b], text, a, b) + _features(k, text[a:b], text, a)) for k, a, b in dict.fromkeys(found)]


def code(kind: str, seen: tuple[int, ...]) -> int:
    """A pattern of kind, votes and features as a number."""
    n = ADDED_KINDS.index(kind)
    for v, size in zip(seen, (*(3 for _ in LABELERS), *FEATURES.values()), strict=True):
        n = n * size + v
    return n


def uncode(n: int) -> tuple[str, tuple[int, ...]]:
    seen = []
    for size in reversed((*(3 for _ in LABELERS), *FEATURES.values())):
        n, v = divmod(n, size)
        seen.append(v)
    return ADDED_KINDS[n], tuple(reversed(seen))


def reliabilities(counts: dict[int, int], iterations: int = 30) -> dict[int, float]:
    """Pattern -> posterior of being personal data; EM over counts of votes, labelers independent given the truth."""
    votes_of = {c: (kind, seen[: len(LABELERS)]) for c in counts for kind, seen in [uncode(c)]}
    summed: dict[tuple, int] = {}
    for c in sorted(counts):
        summed[votes_of[c]] = summed.get(votes_of[c], 0) + counts[c]
    patterns = list(summed.items())
    prior = dict.fromkeys(ADDED_KINDS, 0.6)
    p = {True: [[0.05, 0.35, 0.6] for _ in LABELERS], False: [[0.5, 0.4, 0.1] for _ in LABELERS]}
    post: list[float] = []
    for _ in range(iterations):
        post = []
        for (kind, votes), _n in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(p[True][r][v] / p[False][r][v]) for r, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-odds)))
        for truth in (True, False):
            weights = [(n * (q if truth else 1 - q)) for (_, n), q in zip(patterns, post, strict=True)]
            for r in range(len(LABELERS)):
                held = [1.0, 1.0, 1.0] if truth else [2.0, 2.0, 1.0]  # a labeler is taken to be better than chance
                if truth:
                    held = [1.0, 1.0, 2.0]
                for ((_, votes), _n), w in zip(patterns, weights, strict=True):
                    held[votes[r]] += w
                p[truth][r] = [h / sum(held) for h in held]
        for kind in ADDED_KINDS:
            own = [(n, q) for ((k, _), n), q in zip(patterns, post, strict=True) if k == kind]
            prior[kind] = (sum(n * q for n, q in own) + 3) / (sum(n for n, _ in own) + 5)
    posterior = {p: q for (p, _), q in zip(patterns, post, strict=True)}
    return {c: posterior[v] for c, v in votes_of.items()}


def _inputs(kind: str, seen: tuple[int, ...]) -> list[float]:
    """Kind, votes, and the features one by one and with the kind."""
    votes, features = seen[: len(LABELERS)], seen[len(LABELERS) :]
    of_kind = [float(kind == k) for k in ADDED_KINDS]
    values = [float(f == v) for f, size in zip(features, FEATURES.values(), strict=True) for v in range(1, size)]
    return [1.0, *of_kind, *(float(v - 1) for v in votes), *values, *(k * (features[2] / 3) for k in of_kind)]


def train(counts: dict[int, int], posteriors: dict[int, float], steps: int = 30) -> list[float]:
    """Weights of a logistic span classifier, fitted to the posteriors by Newton's method over the patterns' counts."""
    x = np.array([_inputs(*uncode(c)) for c in counts])
    n, q = np.array(list(counts.values()), float), np.array([posteriors[c] for c in counts])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (p - q)) + ridge @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w.tolist()


class Takes(dict):
    """Pattern -> whether the classifier takes its spans as personal data; worked out where it is asked for."""

    def __init__(self, weights: list[float] | None, threshold: float = 0.5) -> None:
        self.weights, self.threshold = weights, threshold

    def __reduce__(self):
        return Takes, (self.weights, self.threshold)

    def __missing__(self, pattern: int) -> bool:
        score = 0.0 if self.weights is None else 1 / (1 + math.exp(-sum(a * b for a, b in zip(self.weights, _inputs(*uncode(pattern)), strict=True))))
        self[pattern] = self.weights is not None and score >= self.threshold
        return self[pattern]


def all_spans(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those added ones, longest first, that overlap none taken before."""
    taken = sorted((a, b) for _, a, b in base)
    out = list(base)
    for kind, a, b in sorted(added, key=lambda s: (s[1] - s[2], s[1], KINDS.index(s[0]))):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _parsed(text: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in text.split(","))] if text else []


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, td, base (spans joined), cand (array of pattern:start:end). Both are short for any text; texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, cand = [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                base.append(_joined(base_spans(text)))
                cand.append([f"{code(k, v)}:{a}:{b}" for k, a, b, v in candidates(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.string()), pa.array(cand, pa.list_(pa.string()))], ["doc_id", "td", "base", "cand"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("td"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, td long, base string, cand array<string>")


def decide(found: DataFrame, takes: Takes) -> DataFrame:
    """doc_id, td, n_email, n_ip, n_card, n_phone, base_sha256, spans, from what scan gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = [[] for _ in BASE_KINDS], [], []
            for base_text, cand in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                base = _parsed(base_text)
                for k, kind in enumerate(BASE_KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                sha.append(hashlib.sha256(base_text.encode()).hexdigest())
                added = [(uncode(c)[0], a, b) for c, a, b in (map(int, s.split(":")) for s in cand) if takes[c]]
                spans.append(_joined(all_spans(base, added)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "td", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_arrow(found, run, f"doc_id {kind}, td long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def fitted(found: DataFrame) -> Takes:
    """Reliabilities and classifier from the counts of patterns, of which there are at most 7 * 3 ** 5 * 96, and some
    hundreds in practice, however many texts there are; that many rows reach the driver."""
    rows = found.select(F.explode("cand").alias("c")).groupBy(F.substring_index("c", ":", 1).cast("int").alias("c")).count().collect()
    counts = {r["c"]: r["count"] for r in rows}
    return Takes(train(counts, reliabilities(counts)) if counts else None)


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; offsets in code points, end exclusive."""
    found = stored(scan(docs, id_col, text_col), "pii")
    return decide(found, fitted(found)).drop("td")


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; other columns as they are.
    Two passes over the texts: one counts patterns, the other finds the spans again and replaces them in place."""
    takes = fitted(stored(scan(docs, id_col, text_col).select("cand"), "pii"))
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    added = [(k, a, b) for k, a, b, v in candidates(text) if takes[code(k, v)]]
                    spans = all_spans(base_spans(text), added)
                    if spans:
                        parts, here = [], 0
                        for kind, a, b in spans:
                            if b > here:
                                parts += [text[here : max(a, here)], f"<{kind}>" if a >= here else ""]
                                here = b
                        text = "".join([*parts, text[here:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return map_arrow(docs, run, schema)
