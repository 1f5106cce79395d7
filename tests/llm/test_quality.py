from __future__ import annotations

import math
import random
import re

import pytest

from tessella.llm import quality_classifier as C
from tessella.llm import quality_rules as R


def repeated(words: list[str]) -> int:
    places: dict[tuple, list[int]] = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    return len({p + j for ks in places.values() if len(ks) > 1 for p in ks for j in range(8)})


def base(text: str | None):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n_repeat = repeated(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), n_repeat, len(w) < 20 or 100 * n_repeat > 30 * len(w)


def test_base_measures(spark):
    r = random.Random(3)
    texts = [None, "", " \n ", "a b", "x " * 9, "# | é\n# | é\n\n", " lead x trail\x0b", "𝒳 " * 30]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(5, 60))) for _ in range(60)]
    texts += ["\n".join(r.choice(["one line here", "two", "", " "]) for _ in range(12)) for _ in range(10)] + [" ".join(str(k % 700) for k in range(3000))]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "a b", "clash"), (3, "a b", "clash")]
    found = R.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, votes string")).collect()
    got = [(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in found]
    assert sorted(got, key=str) == sorted(((d, *base(t)) for d, t, _ in rows), key=str)
    assert not any(x.kept and x.base_failed for x in found)


def test_votes_separate_junk(spark):
    r = random.Random(4)
    prose = lambda n: " ".join(("word" + str(r.randint(0, 9999))) for _ in range(n)) + "."
    rows = [(k, prose(100)) for k in range(300)]
    rows += [(1000 + k, " ".join("w%d###" % r.randint(0, 9999) for _ in range(80))) for k in range(20)]
    rows += [(2000 + k, " ".join("SHOUT%d!!" % r.randint(0, 9999) for _ in range(80))) for k in range(20)]
    rows += [(3000 + k, " | ".join("item%d" % r.randint(0, 9999) for _ in range(60))) for k in range(20)]
    kept = {x.doc_id for x in R.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert kept == set(range(300))


def em(counts: dict[tuple, int]) -> tuple[list[float], list[list[float]]]:
    """The same EM in plain Python."""
    classes, rules = range(1 + len(R.DEFECTS)), range(len(R.RULES))
    cast = lambda r, *kinds: sum(n for v, n in counts.items() if v[r] in kinds)
    good = [max(R.FALSE_ALARM, min(1 - R.FALSE_ALARM, (cast(r, R.BAD) / max(1, cast(r, R.BAD, R.GOOD)) - 0.15) / 0.85)) for r in rules]
    begin = [good, *([max(R.CAUGHT if name in own else R.ASIDE, g) for name, g in zip(R.RULES, good, strict=True)] for own in R.DEFECTS.values())]
    prior, bad = [0.85, *[0.15 / len(R.DEFECTS)] * len(R.DEFECTS)], begin
    total = sum(counts.values())
    for _ in range(R.ITERATIONS):
        post = {}
        for v in counts:
            like = [prior[k] * math.prod({R.BAD: bad[k][r], R.GOOD: 1 - bad[k][r], R.ABSTAIN: 1.0}[v[r]] for r in rules) for k in classes]
            post[v] = [x / sum(like) for x in like]
        share = lambda k, r=None, kinds=(): sum(n * post[v][k] for v, n in counts.items() if r is None or v[r] in kinds)  # noqa: B023, E731
        prior = [(share(k) + 1) / (total + len(classes)) for k in classes]
        bad = [[(share(k, r, (R.BAD,)) + R.PRIOR_VOTES * begin[k][r]) / (share(k, r, (R.BAD, R.GOOD)) + R.PRIOR_VOTES) for r in rules] for k in classes]
    return prior, bad


def pattern(**votes: int) -> tuple[int, ...]:
    return tuple(votes.get(name, R.GOOD) for name in R.RULES)


def test_em_matches_plain_python(spark):
    r = random.Random(1)
    counts = {tuple(r.choice([R.GOOD, R.GOOD, R.ABSTAIN, R.BAD]) for _ in R.RULES): r.randint(1, 50) for _ in range(12)} | {pattern(): 900}
    row = R.estimate(spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long")).first()
    prior, bad = em(counts)
    assert row["prior"] == pytest.approx(prior, rel=1e-6) and all(x == pytest.approx(y, rel=1e-6) for x, y in zip(row["bad"], bad, strict=True))


def test_accuracies_decide(spark):
    """One vote of a rule that is often wrong doesn't reject; one of a rule that others confirm does, and so do two."""
    counts = {
        pattern(): 6000,
        pattern(dup_lines=R.BAD): 900,  # often wrong: no other rule of its kind agrees
        pattern(symbols=R.BAD, word_length=R.BAD): 300,
        pattern(symbols=R.BAD, bars=R.BAD): 300,
        pattern(symbols=R.BAD): 10,
        pattern(shouting=R.BAD, case=R.BAD, ends=R.BAD): 200,
    }
    model = R.estimate(spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long")).first()
    asked = [pattern(), pattern(dup_lines=R.BAD), pattern(symbols=R.BAD), pattern(symbols=R.BAD, word_length=R.BAD), pattern(shouting=R.BAD, case=R.BAD), (R.ABSTAIN,) * len(R.RULES)]
    good = [x.p for x in spark.createDataFrame([(list(v),) for v in asked], "votes array<int>").select(R.p_good(model["prior"], model["bad"]).alias("p")).collect()]
    assert [g >= 0.5 for g in good] == [True, True, False, False, False, True]
    assert good[-1] == pytest.approx(model["prior"][0])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert R.quality_rules(docs).collect() == []
    assert C.quality(docs, labels).collect() == []


def test_classifier(spark):
    r = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        junk = k % 5 == 0
        text = " ".join((f"w{r.randint(0, 999)}" + ("###" if junk else "")) for _ in range(60))
        rows.append((k, text, None if k == 7 else "big" if k % 3 else f"s{k % 40}", "en", "clash"))
        if k < 300:
            labels.append((k, int(not junk), 0))
    rows += [(900, None, "big", "en", "x"), (None, "a b", None, None, "x"), (1, rows[1][1], "big", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = C.quality(docs, labels).collect()
    assert len(found) == len(rows)
    right = [x.kept == (x.doc_id % 5 != 0) for x in found if x.doc_id is not None and x.doc_id < 400]
    assert sum(right) / len(right) > 0.98
    assert not next(x for x in found if x.doc_id == 900).kept
    kept = C.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 900").isEmpty()
    sites = {(x.host_rate, x.path_rate) for x in found}
    assert all(0 < a < 1 and 0 < b < 1 for a, b in sites)


def test_shrinkage_is_stronger_for_sparse_groups(spark):
    groups = spark.createDataFrame([("a", 1000, 500.0), ("b", 1000, 950.0), ("c", 2, 0.0)], "host string, n long, good double").selectExpr("*", "0.75D AS prior")
    got = {x.host: x.posterior for x in C.shrunk(groups, "prior").collect()}
    assert abs(got["a"] - 0.5) < 0.05 and abs(got["b"] - 0.95) < 0.05 and got["c"] > 0.2


def test_sites_move_verdicts(spark):
    """Documents of the same middling evidence: kept on hosts and paths with a good record, rejected on bad ones, and
    alike where the sites are left out."""
    r = random.Random(8)
    words = lambda n: [f"w{r.randint(0, 999)}" for _ in range(n)]

    def text(noise: float) -> str:
        return " ".join(w + ("###" if r.random() < noise else "") for w in words(60))

    rows, labels = [], []
    for k in range(600):
        host, good = ("https://Good.example/a/1", k % 20 != 0) if k % 2 else ("https://bad.example/junk/2", k % 20 == 0)
        rows.append((k, text(r.uniform(0.0, 0.45) if good else r.uniform(0.15, 0.6)), host, "en"))
        labels.append((k, int(good)))
    middling = [(1000 + k, text(0.3)) for k in range(30)]
    rows += [(d, t, "http://good.example/a/x", "en") for d, t in middling] + [(d + 1000, t, "http://bad.example/junk/x", "en") for d, t in middling]
    args = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {x.doc_id: x.kept for x in C.quality(*args).collect()}
    alike = {x.doc_id: x.kept for x in C.quality(*args, site_weight=0.0).collect()}
    on_good, on_bad = (sum(kept[d + k] for d, _ in middling) for k in (0, 1000))
    assert on_good >= 24 and on_bad <= 6
    assert all(alike[d] == alike[d + 1000] for d, _ in middling)
