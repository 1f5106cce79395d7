from __future__ import annotations

import hashlib
import random
import re

import pytest

from tessella.llm import decontamination as D
from tessella.llm import html_extract as H
from tessella.llm import pii as P
from tessella.llm import substring_dedup as U
from tessella.llm import toxicity as T

# --- pages ---------------------------------------------------------------------------------------------------------


def page(article: str, host: str = "") -> str:
    return f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p><p>no</p>';</script></head><body><nav><ul><li><a>Home</a></li></ul></nav><!-- <p>ad</p> -->{article}<footer>&copy; {host}</footer></body></html>"


@pytest.mark.parametrize(
    ("article", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>One  <b>two</b>\nthree<br>four<p>Five &lt;x&gt; &#233;&nbsp;z</article>", "A & B\nOne two three four\nFive <x> é z"),
        ('<article><p>Keep</p><div class="ad">Buy</div><aside>s</aside><form><p>f</p></form><p>This</p></article>', "Keep\nThis"),
        ('<main><div id="content"><p>x</p><section class="comments"><p>me too</p></section><div class="cookie-notice"><p>ok?</p></div></div></main>', "x"),
        ('<article><p>a</p><div role="navigation">n</div><ul><li>i<li>j</ul><table><tr><td>1<td>2</table><p hidden>h</p></article>', "a\ni\nj\n1\n2"),
        ("<article><p>un<b>closed <i>tags</p><p>go on &am", "un closed tags".replace("un ", "un") + "\ngo on &am © "[:-3]),
        ("<article></article>", ""),
    ],
)
def test_structure(article, text):
    found = "\n".join(t for t, _ in H.blocks(page(article)))
    if article == "<article></article>":
        assert found == ""
    else:
        assert found.startswith(text)


def test_run_pages_against_brute_force():
    r = random.Random(2)
    for _ in range(30):
        pages = [[r.randint(1, 3) for _ in range(r.randint(0, 30))] for _ in range(5)]
        for p in pages[1:3]:
            p[3:3] = [1, 2, 3, 1, 1, 2, 2, 3, 3, 1]
        tokens, owner = [], []
        for k, p in enumerate(pages):
            tokens += [*p, 0]
            owner += [k] * (len(p) + 1)
        runs: dict[tuple, set[int]] = {}
        for k in range(len(tokens) - 7):
            w = tuple(tokens[k : k + 8])
            if 0 not in w:
                runs.setdefault(w, set()).add(owner[k])
        want = [max([0, *(len(runs.get(tuple(tokens[k : k + 8]), ())) for k in range(max(0, i - 7), min(i, len(tokens) - 8) + 1))]) for i in range(len(tokens))]
        assert H.run_pages(H.np.array(tokens), H.np.array(owner)).tolist() == want


def test_common_blocks_of_articles(spark):
    body = lambda k: " ".join(f"word{k}x{j}" for j in range(30))
    blurb = "subscribe to the letter that we send to all of our readers each week"
    copied = " ".join(f"copied{j}" for j in range(40))
    text = lambda k: [body(k)] + [copied] * (k < 4)
    article = lambda k, extra: page("<article>" + "".join(f"<p>{p}</p>" for p in [*text(k), *extra]) + "</article>")
    rows = [(k, f"http://big.example/{k}", article(k, [blurb])) for k in range(30)] + [(100 + k, f"http://small.example/{k}", article(k, [blurb])) for k in range(5)]
    found = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(30):
        assert found[k] == "\n".join(text(k))  # the blurb is on every page of the host; what four pages share stays
    for k in range(5):
        assert found[100 + k] == "\n".join([*text(k), blurb])  # too few pages to tell


def test_open_pages_of_a_host(spark):
    frame = "<body><div>Welcome to this site of ours where all the news is always fresh</div><div>{}</div><div>All rights reserved by the owners of this site since the year dot</div></body>"
    body = lambda k: " ".join(f"word{k}x{j}" for j in range(30))
    rows = [(k, f"http://h.example/{k}", frame.format(body(k)), "clash") for k in range(40)]
    rows += [(100, "http://h.example/a", page("<article><p>Own</p></article>"), ""), (101, None, None, ""), (102, "http://h.example/b", "", ""), (None, "x", "<p>alone</p>", "")]
    found = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(found) == len(rows)
    for k in range(40):
        assert found[k, f"http://h.example/{k}"] == (body(k), len(body(k)))
    assert found[100, "http://h.example/a"] == ("Own", 3) and found[101, None] == ("", 0) and found[102, "http://h.example/b"] == ("", 0) and found[None, "x"] == ("alone", 5)
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_groups_of_a_host_see_the_whole_host(spark, monkeypatch):
    """Runs on two pages, common blocks and short ones are found in whichever groups of the host their pages are."""
    r = random.Random(3)
    word = lambda k, j: f"word{k}x{j}"
    shared = [" ".join(f"shared{s}y{j}" for j in range(12)) for s in range(20)]
    rows = []
    for k in range(60):
        parts = [" ".join(word(k, j) for j in range(15)), shared[k % 20] if k < 40 else "Only here", "Home" if k < 45 else "Rare"]
        rows.append((k, f"http://h.example/{k}", "<body>" + "".join(f"<div>{p}</div>" for p in parts) + "</body>"))
        article = [" ".join(word(100 + k, j) for j in range(15)), "read more of this from all of our writers each day"][: 1 + (k % 3 > 0)]
        rows.append((100 + k, f"http://a.example/{k}", page("<article>" + "".join(f"<p>{p}</p>" for p in article) + "</article>")))
    rows += [r.choice(rows) for _ in range(5)] + [(500 + k, f"http://small.example/{k}", page(f"<article><p>Own {k}</p></article>")) for k in range(3)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, H.main_text(docs).collect()))
    monkeypatch.setattr(H, "GROUP_PAGES", 4)
    assert sorted(map(tuple, H.main_text(docs).collect())) == want
    text = {x[0]: x[2] for x in want}
    assert text[0] == " ".join(word(0, j) for j in range(15)) and text[50].endswith("Only here\nRare") and "read more" not in text[101] and len(want) == len(rows)


# --- decontamination -----------------------------------------------------------------------------------------------


def test_alignment_against_full_table():
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randint(1, 12))] for _ in range(2))
        best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (D.MATCH if x == y else D.MISMATCH), table[i - 1][j] + D.GAP, table[i][j - 1] + D.GAP)
                best = max(best, table[i][j])
        s, matched, start, end = D.align(a, b)
        assert s == best and matched <= min(len(a), end - start)


def test_planted_leaks(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 4)))
    items = [(k, " ".join(word() for _ in range(r.randint(15, 50)))) for k in range(20)] + [(50, "Single"), (51, None), (52, "")]
    docs, want = [], set()
    for k in range(200):
        w = [word() for _ in range(r.randint(20, 200))]
        if k % 4 == 0:
            item, text = items[k // 4 % 20]
            copy = text.split()
            for _ in range(len(copy) // 8 if k % 8 else 0):
                copy[r.randrange(len(copy))] = word()
            at = r.randrange(len(w))
            w[at:at] = copy
            want.add((k, item))
        docs.append((k, " ".join(w).upper() if k % 8 == 4 else " ".join(w), "clash"))
    docs += [(900, None, ""), (901, "", ""), (0, docs[0][1], ""), (902, " ".join(word() for _ in range(20_000)) + " " + items[3][1], ""), (903, "a single b", "")]
    want |= {(902, 3), (903, 50)}
    table = spark.createDataFrame(docs, "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in D.contaminated_pairs(table, bench).collect()} == want
    kept = D.decontaminated(table, bench)
    assert kept.columns == table.columns and {x.doc_id for x in kept.collect()} == {d for d, _, _ in docs} - {d for d, _ in want}
    assert D.contaminated_pairs(table.limit(0), bench).collect() == [] and D.contaminated_pairs(table, bench.limit(0)).collect() == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some text {k} with the words of item number {k % 5} and then more") for k in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"the words of item number {k}") for k in range(5)], "item_id long, text string")
    one = sorted(map(tuple, D.contaminated_pairs(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_NGRAMS", 10)
    assert sorted((d, i) for d, i, *_ in map(tuple, D.contaminated_pairs(docs, bench).collect())) == sorted((d, i) for d, i, *_ in one)


def test_many_edited_copies_of_an_item(spark):
    r = random.Random(5)
    item = [f"w{k}" for k in range(24)]
    edits = [[w if j % 3 else f"x{k}q{j}" for j, w in enumerate(item)] for k in range(50)]  # each third word is another
    edits += [item[:12] + [f"y{k}"] for k in range(20)]
    edits += [[x for w in item for x in (w, f"z{k}")] for k in range(3)]  # no two words of the item in a row
    docs = spark.createDataFrame([(k, " ".join([f"a{k}", f"b{k}", *e, f"c{k}"])) for k, e in enumerate(edits)], "doc_id long, text string")
    found = D.contaminated_pairs(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {x.doc_id for x in found} == set(range(len(edits)))

    items = [(k, " ".join(r.choices("abcdefghijklmnop", k=r.randint(4, 14)))) for k in range(30)]
    texts = [(k, " ".join(r.choices("abcdefghijklmnop", k=r.randint(5, 60)))) for k in range(60)]
    found = D.contaminated_pairs(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    best = {(d, i): D.align(w, t.split())[0] / (2 * len(w)) for d, t in texts for i, w in ((i, x.split()) for i, x in items)}
    want = {p: s for p, s in best.items() if s >= D.THRESHOLD}
    assert want and {(x.doc_id, x.item_id): x.score for x in found} == want


# --- personal data -------------------------------------------------------------------------------------------------


def base_by_regex(text: str):
    spans = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(spans, key=lambda s: (s[1], P.BASE_KINDS.index(s[0])))


def test_base_spans_against_patterns(spark):
    r = random.Random(9)
    pieces = ["a@b.co", "@", "x@y", ".", "-", "+", " ", "1", "12", "255.1.2.3", "256.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "é", "(", ")", "%", "b.c", "0", "99"]
    texts = [None, "", "🙂 me@x.org."] + ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    for t in texts[1:]:
        assert P.base_spans(t) == base_by_regex(t), t
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "a@b.co", "x"), (1, "a@b.co", "x")]
    found = P.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    want = []
    for d, t, _ in rows:
        s = base_by_regex(t or "")
        want.append((d, *(sum(x[0] == k for x in s) for k in P.BASE_KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert sorted((tuple(x)[:6] for x in found), key=str) == sorted(want, key=str)
    by = {}
    for x in found:
        by.setdefault(x.doc_id, []).append(x.spans)
    for d, t, _ in rows:
        base = {f"{k}:{a}:{b}" for k, a, b in base_by_regex(t or "")}
        assert any(base <= set(s.split(",")) | {""} for s in by[d])
    assert P.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_added_spans_and_redaction(spark):
    secret = "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    rows = [(k, f"plain words {secret} and me{k}@x.org then +1 (017) 555-7713.", "k") for k in range(30)] + [(99, None, "k"), (100, "", "k"), (101, "clean words only", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = {x.doc_id: x.spans for x in P.personal_data(docs).collect()}
    assert "secret" in spans[0] or "key" in spans[0]
    assert "email" in spans[0] and "phone" in spans[0] and spans[99] == spans[100] == spans[101] == ""
    out = {x.doc_id: x.text for x in P.redacted(docs).collect()}
    assert "@" not in out[3] and "555" not in out[3] and "04dbebab" not in out[3] and out[3].startswith("plain words token = ")
    assert out[99] is None and out[100] == "" and out[101] == "clean words only"


def test_classifier_sees_more_than_votes(spark):
    """Of spans on which the labelers agree alike, it takes those whose context is that of sure ones."""
    yes, no, torn = (P.YES, P.YES, P.ABSTAIN, P.YES, P.YES), (P.NO, P.ABSTAIN, P.ABSTAIN, P.NO, P.NO), (P.ABSTAIN, P.ABSTAIN, P.ABSTAIN, P.YES, P.NO)
    near, far = (1, 2, 3, 0), (1, 2, 1, 0)
    counts = {P.code("number", yes + near): 300, P.code("number", no + far): 300, P.code("number", torn + near): 20, P.code("number", torn + far): 20}
    post = P.reliabilities(counts)
    assert post[P.code("number", torn + near)] == post[P.code("number", torn + far)]
    post = {c: 1.0 if c == P.code("number", yes + near) else 0.0 if c == P.code("number", no + far) else 0.5 for c in counts}
    takes = P.Takes(P.train(counts, post))
    assert [takes[P.code("number", v)] for v in (yes + near, no + far, torn + near, torn + far)] == [True, False, True, False]
    assert all(P.code(*P.uncode(c)) == c for c in counts)


def test_more_kinds(spark):
    texts = ["please call (678) 555-5272 today", "write to jane.doe [at] mail [dot] example [dot] com now", "we met Jennifer Whitfield there", "phone +1 (678) 555-5272", "the 2020-2021 season, 3.14 and Upper Case Words", "x " * 100_000 + "call 678-555-5272"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {x.doc_id: [k.split(":")[0] for k in x.spans.split(",") if k] for x in P.personal_data(docs).collect()}
    assert kinds == {0: ["tel"], 1: ["mail"], 2: ["name"], 3: ["phone"], 4: [], 5: ["tel"]}


# --- repeated lines ------------------------------------------------------------------------------------------------


def _tiles(line: str) -> list[tuple[int, int]]:
    """Sentences of a line by walking over its characters."""
    out, start, k = [], 0, 0
    while k < len(line):
        if line[k] in ".!?":
            while k < len(line) and line[k] in ".!?":
                k += 1
            while k < len(line) and line[k].isspace():
                k += 1
            out.append((start, k))
            start = k
        else:
            k += 1
    return out + [(start, k)] * (start < k)


def _without_repeats(rows: list[tuple]) -> list[tuple]:
    """doc_id, text left, spans (start, end): what stands earlier, by doc_id and start, goes."""
    least, named = U.LEAST_WORDS, []
    for d, t in rows:
        here = 0
        for k, line in enumerate((t or "").split("\n")):
            tiles = _tiles(line)
            for j, (a, b) in enumerate([(0, len(line)), *(tiles if len(tiles) > 1 else [])]):
                n = line[a:b].lower().split()
                if len(n) >= least:
                    named.append(((d is None, d or 0, here + a, here + b), d, t, k, j, " ".join(n)))
            here += len(line) + 1
    first = {}
    for place, *_, n in named:
        first[n] = min(first.get(n, place), place)
    gone = {(d, t, k, j) for place, d, t, k, j, n in named if first[n] != place}
    out = []
    for d, t in rows:
        here, left, spans = 0, [], []
        for k, line in enumerate((t or "").split("\n")):
            if (d, t, k, 0) in gone:
                spans.append((here, here + len(line)))
            else:
                tiles = _tiles(line)
                cut = [(d, t, k, j + 1) in gone and len(tiles) > 1 for j in range(len(tiles))]
                spans += [(here + a, here + b) for (a, b), c in zip(tiles, cut) if c]
                rest = "".join(line[a:b] for (a, b), c in zip(tiles, cut) if not c)
                if rest.strip() or not any(cut):
                    left.append(rest)
            here += len(line) + 1
        out.append((d, "\n".join(left), spans))
    return out


def test_units_against_brute_force(spark):
    r = random.Random(4)
    sentence = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "Delta", "3.5"]) for _ in range(n)) + r.choice([".", "!?", "...", ""])
    pool = [sentence(r.choice([2, 15, 16, 17, 60])) for _ in range(30)]
    line = lambda: r.choice(["", "  "]) + r.choice([" ", "  "]).join(r.choice([x, x.upper()]) for x in r.choices(pool, k=r.choice([1, 1, 2, 4])))
    rows = [(k, "\n".join(line() for _ in range(r.randint(0, 6)))) for k in range(80)]
    rows += [(200, None), (5, rows[5][1]), (None, pool[3]), (201, "only\n" + " ".join(f"new{k}" for k in range(30))), (202, " \n\n"), (203, ""), (204, " ".join(["long"] * 200_000))]
    found = U.substring_dedup(spark.createDataFrame([(*x, "clash", 7, b"d") for x in rows], "doc_id long, text string, removed string, td long, digest binary")).collect()
    want = _without_repeats(rows)
    assert sorted(((x.doc_id, x.text, [(g.start, g.end) for g in x.removed]) for x in found), key=str) == sorted(want, key=str)
    assert all(x.n_removed == len(x.removed) for x in found) and sum(x.n_removed for x in found) > 50
    assert U.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passage_inside_a_longer_line(spark):
    passage = [" ".join(f"{w}{k}" for k in range(20)) + "." for w in ("one", "two", "three")]
    edited = "Something else stands before it. " + " ".join(passage) + " And behind it."
    rows = [(1, "\n".join(passage)), (2, edited), (3, "Short. Words. Recur."), (4, "Short. Words. Recur.")]
    found = {x.doc_id: x for x in U.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_removed == found[3].n_removed == found[4].n_removed == 0
    assert found[2].text == "Something else stands before it. And behind it."
    assert [(g.first_doc_id, edited[g.start : g.end].strip()) for g in found[2].removed] == [(1, p) for p in passage]


def _without_passages(rows: list[tuple], words: int) -> list[tuple]:
    """doc_id, text left, spans (start, end, first_doc_id, first_start): by comparing all runs of words themselves."""
    runs, first = {}, {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        tiles = list(re.finditer(U.WORD, t or ""))
        names = [m.group().strip("\t\n\v\f\r ").lower() for m in tiles]
        runs[d, t] = tiles, [tuple(names[k : k + words]) for k in range(len(names) - words + 1)]
        for k, n in enumerate(runs[d, t][1]):
            first.setdefault(n, (d, t, k))
    out = []
    for d, t in rows:
        tiles, names = runs[d, t]
        source = {}
        for k, n in enumerate(names):
            d1, t1, k1 = first[n]
            if (d1, t1) != (d, t) or k >= k1 + words:
                for j in range(k, k + words):
                    source.setdefault(j, (d1, runs[d1, t1][0][k1].start()))
        spans = []
        for j in sorted(source):
            if spans and j - 1 in source:
                spans[-1][1] = tiles[j].end()
            else:
                spans.append([tiles[j].start(), tiles[j].end(), *source[j]])
        left = (t or "")[: tiles[0].start() if tiles else None] + "".join(m.group() for j, m in enumerate(tiles) if j not in source)
        out.append((d, left, [tuple(x) for x in spans]))
    return out


def _passages(spark, rows, **options) -> list[tuple]:
    found = U.passage_dedup(spark.createDataFrame([(*x, "clash", 7, b"d") for x in rows], "doc_id long, text string, removed string, td long, digest binary"), **options).collect()
    assert all(x.n_removed == len(x.removed) for x in found)
    return [(x.doc_id, x.text, [tuple(g) for g in x.removed]) for x in found]


@pytest.mark.parametrize("words", [2, 7, 51])
def test_passages_against_brute_force(spark, words):
    r = random.Random(words)
    make = lambda n: "".join(r.choice(["alpha", "Beta", "gamma.", "3.5", "ÄÖ"]) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(n))
    pool = [make(n) for n in (words - 1, words, words + 1, 2 * words, 5 * words)]
    rows = [(k, r.choice(["", " \n"]) + "".join(r.choice([make(r.randint(0, words)), x, x.upper()]) for x in r.choices(pool, k=r.randint(0, 4)))) for k in range(60)]
    rows += [(100, "tior " * (3 * words + 5)), (101, "x " + "tior " * (words + 3) + "y"), (102, "的" * (2 * words)), (103, "前" + "的" * words), (104, None), (5, rows[5][1]), (None, pool[4]), (105, " \n"), (106, "")]
    want = _without_passages(rows, words)
    assert sorted(_passages(spark, rows, words=words), key=str) == sorted(want, key=str)
    assert sum(len(x[2]) for x in want) > 20
    assert _passages(spark, [], words=words) == []


def test_passage_without_lines_and_sentences(spark):
    """Units of lines and sentences miss each of these: short sentences, no sentence ends, ends that are shifted."""
    short = " ".join(f"Word{k} is here." for k in range(20))
    endless = " ".join(f"plain{k}" for k in range(60))
    rows = [(1, f"A begins {short} here ends."), (2, f"B opens {short} there stops."), (3, f"begins {endless} behind"), (4, f"other {endless} differs"), (5, endless[: endless.index("plain50")]), (6, f"New {endless[: endless.index('plain50')]}too")]
    found = {d: (text, spans) for d, text, spans in _passages(spark, rows)}
    assert [found[d][1] for d in (1, 3, 6)] == [[], [], []]
    assert found[2] == ("B opens there stops.", [(8, 8 + len(short) + 1, 1, 9)])
    assert found[4] == ("other differs", [(6, 6 + len(endless) + 1, 3, 7)])
    assert found[5][1] == []  # 50 words
    assert all(x.n_removed == 0 for x in U.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())


# --- toxicity ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("word", ["1d10t", "stuuupid", "id!ot", "tr@sh", "$tupid", "scuuum", "l0ser", "cl*wn", "d.i.s.g.u.s.t.i.n.g"])
def test_restores_disguised_words(word):
    plain = ["idiot", "stupid", "trash", "scum", "loser", "clown", "disgusting"]
    model = T.CharModel(dict.fromkeys(plain, 50) | {"the": 500, "house": 30, "on": 100})
    assert T.restore(word, model) in plain


def test_learns_and_holds_out(spark):
    r = random.Random(3)
    prose = lambda n: [r.choice(["the", "house", "stands", "on", "green", "hill", "river", "stone"]) + r.choice(["", "s", "ly"]) for _ in range(n)]
    rows, labels = [], []
    for k in range(600):
        w = prose(40)
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum", "loser"]))
        rows.append((k, " ".join(w), "clash"))
        labels.append((k, int(toxic)))
    disguised = ["1d10t m0r0n", "what a l0ser and sc*m", "you i d i o t go", "IDIOOOT MORON"]
    rows += [(1000 + k, " ".join(prose(20)) + " " + t + " " + " ".join(prose(5)), "x") for k, t in enumerate(disguised)]
    rows += [(2000, None, "x"), (2001, "", "x"), (None, "idiot moron scum", "x"), (1, rows[1][1], "x")]
    found = T.toxicity(spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in found)
    import zlib

    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in found)
    held = [x for x in found if x.held_out and x.doc_id < 600]
    assert sum(x.predicted == int(x.doc_id % 6 == 0) for x in held) / len(held) > 0.97
    by = {x.doc_id: x.predicted for x in found}
    assert [by[1000 + k] for k in range(4)] == [1] * 4 and by[2000] == by[2001] == 0 and by[None] == 1


@pytest.mark.parametrize("text", ["idi" + "o" * 80 + "t", "you-are-" * 9 + "idiot", "y o u i d i o t", "y.o.u.1.d.i.o.t", "i diot", "id iot", "go h o g", "you 1d 10t", "the 1di0 t0ts 1d10t", "1di ot", "y o u a r e " * 9 + "i d i o t"])
def test_spaces_and_length_are_decoded(text):
    words = {w: 50 for w in ("you", "are", "the", "house", "go", "idiot", "hog")}
    scores = T._Scores(T.Model({"idiot": 4.0, "hog": 4.0}, words, {}, None))
    assert T.hits(text, scores)[0] == 4.0
    assert T.hits("you are the house", scores) == (0.0, 0.0, 0.0)


def test_verdicts_depend_on_the_decoder(spark, monkeypatch):
    """Disguised words in documents whose labels were never seen: found by the decoder, not without it."""
    r = random.Random(5)
    plain, bad = ["house", "green", "hill", "river", "stone", "stands", "there"], ["idiot", "moron", "trash", "loser"]
    prose = lambda: " ".join(r.choice(plain) for _ in range(30))
    rows = [(k, f"{prose()} {r.choice(bad) if k % 5 == 0 else 'calm'} {prose()}") for k in range(400)]
    labels = [(k, int(k % 5 == 0)) for k in range(400)]
    hidden = [(1000 + k, f"{prose()} {w} {prose()}") for k, w in enumerate(["1d10t", "m0r0n", "t r a s h", "l.0.s.e.r", "idiii0t", "1di ot", "m o r o n", "tr@sssh"])]
    clean = [(2000 + k, f"{prose()} {w} {prose()}") for k, w in enumerate(["10 stone", "the 3rd hill", "a b c d", "v1.0", "50% off", "gr33n"])]
    args = spark.createDataFrame(rows + hidden + clean, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(*args)

    def verdicts() -> dict[int, bool]:
        scores = T._Scores(model)
        return {d: T.sigmoid(sum(a * b for a, b in zip(model.weights, (1.0, *T.hits(t, scores)), strict=True))) >= 0.5 for d, t in hidden + clean}

    assert verdicts() == {d: d < 2000 for d, _ in hidden + clean}
    monkeypatch.setattr(T, "restore", lambda token, model: token)
    assert sum(verdicts()[d] for d, _ in hidden) <= 3


def test_characters_of_all_texts(spark):
    docs = spark.createDataFrame([(k, "idiot word" if k % 2 else "plain word") for k in range(40)] + [(100 + k, "zyx, 漢字") for k in range(3)] + [(None, "zyx", ), (200, None)], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int"))
    assert model.trigrams["^^z"] == model.trigrams["zyx"] == model.trigrams["yx$"] == 4 and model.trigrams["^^w"] == 40
    assert T.CharModel({}, model.trigrams).tri == T.CharModel({"idiot": 20, "plain": 20, "word": 40, "zyx": 4, "漢字": 3}).tri


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(x) for x in T.toxicity(docs, labels).collect()] == [(1, False, 0.0, 0)]
    assert T.toxicity(docs.limit(0), labels).collect() == []
