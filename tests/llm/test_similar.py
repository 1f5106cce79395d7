from __future__ import annotations

import random
import re

import pytest

from tessella.llm import ngram_jaccard as N


def brute(rows):
    """doc_id -> (n_shingles, n_similar, component_id) by comparing all pairs."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower))
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    links = [[j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 70 * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((doc, len(sets[i]), len(links[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def corpus(seed: int, n: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("abcdefgh") + r.choice(["", "x", "É"])
    hot = [word() for _ in range(25)]
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if kind < 0.45 and texts:
            w = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = word()
            text = r.choice([" ", "\n", " \t"]).join(w)
        elif kind < 0.7:
            text = " ".join([word() for _ in range(r.randint(0, 12))] + hot + [word() for _ in range(r.randint(0, 12))])
        else:
            text = " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 9, 40, 120])))
        texts.append(text)
        rows.append((i * 7 + 3, text.upper() if r.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize(("seed", "frequent", "combined"), [(1, 64, 8), (2, 3, 4), (3, 1, 2), (4, 4, 60)])
def test_against_all_pairs(spark, monkeypatch, seed, frequent, combined):
    monkeypatch.setattr(N, "FREQUENT", frequent)
    monkeypatch.setattr(N, "COMBINED", combined)
    rows = corpus(seed, 150)
    found = N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_many_classes_with_one_shingle(spark, monkeypatch):
    monkeypatch.setattr(N, "FREQUENT", 3)
    rows = [(k, "a " * k) for k in range(3, 40)] + [(100, "b c b c b"), (101, "b c b c b c"), (102, "c b c b c b c"), (103, "b c b c b c b c"), (104, "c b c b c b")]
    found = N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == brute(rows)


@pytest.mark.parametrize("seed", [7, 8])
def test_clashing_ids_hot_shingles_and_no_broadcast(spark, monkeypatch, seed):
    """Ids that stand with several texts lose no link, whichever way shingles are counted and tables are joined."""
    monkeypatch.setattr("tessella.llm.common.BROADCAST_ROWS", 3)
    monkeypatch.setattr(N, "PARTNERS", 1)
    rows = [(k % 100, t) for k, t in corpus(seed, 160)] + [(1, "a b c d e"), (1, "x y z u v"), (5, "x y z u v"), (6, "x y z u v"), (7, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.similar_documents(docs, hot_share=0.001).collect())) == brute(rows)
    assert sorted(map(tuple, N.similar_documents(docs).collect())) == brute(rows)


def test_keys_that_share_a_hash(spark, monkeypatch):
    """Should two classes have the same short hash, they go by their whole keys."""
    real = N.F.xxhash64
    monkeypatch.setattr(N.F, "xxhash64", lambda *c: N.F.pmod(real(*c), N.F.lit(2)) if isinstance(c[0], str) and c[0] == "key" else real(*c))
    rows = corpus(9, 60)
    assert sorted(map(tuple, N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


@pytest.mark.parametrize(("seed", "bits"), [(1, 3), (2, 6), (3, 10)])
def test_tokens_that_clash(spark, monkeypatch, seed, bits):
    """Shingles of a document, and of several, that share a token lose no link."""
    monkeypatch.setattr(N, "TOKEN_BITS", bits)
    monkeypatch.setattr(N, "FREQUENT", 5)
    monkeypatch.setattr(N, "SAMPLED", 10)
    rows = corpus(seed, 120)
    assert sorted(map(tuple, N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


@pytest.mark.parametrize(("seed", "bits", "counted"), [(1, 40, 0), (2, 40, 40), (3, 40, 100), (4, 3, 3), (5, 40, 256)])
def test_tokens_that_are_not_counted(spark, monkeypatch, seed, bits, counted):
    """Whatever share of the tokens is counted, and whether the others are needed or not, no link is lost."""
    monkeypatch.setattr(N, "COUNTED", counted)
    monkeypatch.setattr(N, "TOKEN_BITS", bits)
    monkeypatch.setattr(N, "FREQUENT", 3)
    monkeypatch.setattr(N, "COMBINED", 4)
    rows = corpus(seed, 120) + [(2000 + k, "p q r s t u v w x y z"[: 2 * k + 1]) for k in range(11)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.similar_documents(docs, hot_share=0.001 if seed % 2 else 0.5).collect())) == brute(rows)


def test_half_of_the_shingles_travels(spark):
    """Of long sets about half are sent to be counted, of any set enough to fill its longest prefix."""
    docs = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(n + 2))) for n in (1, 2, 5, 12, 30, 2000)], "doc_id long, text string")
    sent = {r.id: r["count"] for r in N._postings(N._sets(docs, "doc_id", "text")).groupBy("id").count().collect()}
    assert sent[2000] < 1200
    assert all(sent[n] >= min(n, n - -(-7 * n // 10) + 2) for n in (1, 2, 5, 12, 30, 2000))
    sizes = N._sets(docs, "doc_id", "text").select("id", N.let(N.F.col("s"), N._size).alias("z")).select("id", "z.*").collect()
    assert {r.id: (r.n, r.m_sent) for r in sizes} == {n: (n, m) for n, m in sent.items()}


def test_a_set_travels_once_to_a_group_of_near_copies(spark, monkeypatch):
    """Members of a group that are each other's candidates meet in one block; only a large group is spread."""
    pairs = [(g * 100 + i, g * 100 + j) for g in range(20) for i in range(12) for j in range(i + 1, 12)]
    stored = N.stored(spark.createDataFrame(pairs, "x long, y long"), "test")

    def blocks_of_groups():
        found = N._homes(stored, 64).collect()
        return [{r.block for r in found if r.x // 100 == g} for g in range(20)]

    assert all(len(b) == 1 for b in blocks_of_groups())
    monkeypatch.setattr(N, "NEIGHBOURS", 6)
    assert all(len(b) > 1 for b in blocks_of_groups())


@pytest.mark.parametrize(("neighbours", "partners", "broadcast"), [(1, 1, 1_000_000), (20, 3, 2), (1 << 16, 2, 1_000_000)])
def test_groups_spread_over_blocks(spark, monkeypatch, neighbours, partners, broadcast):
    monkeypatch.setattr(N, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(N, "PARTNERS", partners)
    monkeypatch.setattr("tessella.llm.common.BROADCAST_ROWS", broadcast)
    base = [f"w{k}" for k in range(60)]
    rows = corpus(11, 60) + [(1000 + k, " ".join([*base[:k], f"z{k}", *base[k + 1 :]])) for k in range(30)]
    assert sorted(map(tuple, N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_texts_are_split_once(spark, monkeypatch):
    """The plan of the postings makes each set once, after the rows that take no part have gone."""

    class Seen(Exception):
        pass

    def counted(postings, *_):
        raise Seen(postings._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(N, "_counted", counted)
    with pytest.raises(Seen) as seen:
        N.similar_documents(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string"))
    plan = str(seen.value)
    assert plan.count("array_distinct") == 1 and plan.index("array_distinct") < plan.index("LeftAnti")


def test_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 3000)], "x long, y long")
    found = {r.id: r.component for r in N.components(links).collect()}
    assert len(found) == 3001 and set(found.values()) == {0}


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "one", None), (5, "ONE", "x"), (6, "one two", "x"), (None, "one two", "x"), (8, long, "x"), (9, long + " z", "x"), (10, "a b c d", "x"), (10, "a b c d", "x")]
    found = N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 0, 0, 1), (2, 0, 0, 2), (3, 0, 0, 3), (4, 1, 1, 4), (5, 1, 1, 4), (6, 1, 0, 6), (None, 1, 0, None), (8, 4998, 1, 8), (9, 4999, 1, 8), (10, 2, 1, 10), (10, 2, 1, 10)], key=str)


def test_empty(spark):
    assert N.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pairs_are_verified_by_their_differences_from_a_lead(spark):
    """Groups of sets at all distances from their leads, those that share nothing with them included."""
    rng = random.Random(5)
    sets = {}
    for group in range(4):
        base = [group * 1000 + k for k in range(40)]
        for k in range(12):
            kept = rng.sample(base, rng.randint(0, 40) if k % 3 == 0 else rng.randint(30, 40))
            sets[group * 100 + k] = kept + [rng.randrange(10**6, 10**6 + 60) for _ in range(rng.randint(0, 12))]
    sets = {k: sorted(set(v)) or [k] for k, v in sets.items()}
    stored_sets = N.stored(spark.createDataFrame(list(sets.items()), "id long, s array<long>"), "sets")
    pairs = [(x, y) for x in sets for y in sets if (len(sets[x]), x) < (len(sets[y]), y) and (x // 100 == y // 100 or rng.random() < 0.1)]
    stored_pairs = N.stored(spark.createDataFrame(pairs, "x long, y long"), "pairs")
    homes = N._homes(stored_pairs, 4)
    assert homes.columns == ["x", "lead", "block"] and homes.where("lead > x").isEmpty()
    similar = {(x, y) for x, y in pairs if len({*sets[x]} & {*sets[y]}) * 100 >= len({*sets[x]} | {*sets[y]}) * 70}
    found = [(r.x, r.y) for r in N._verify(stored_pairs, stored_sets).collect()]
    assert len(found) == len(similar) > 20 and {*found} == similar
