from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella import errors as E
from tessella.functions.tokenizers import SIMPLE, UNICODE
from tessella.operators import set_ops as S
from tessella.operators.fulltext import FullTextIndex, SearchOptions
from tessella.operators.tag_index import Condition, TagIndex
from tessella.plans.builder import where
from tessella.plans.dsl import Leaf, Node, SortKey, Text, parse, split_text
from tessella.plans.engine import Engine


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([(1000, 101), (1000, 102), (1000, 103), (1001, 104), (1001, 105), (2010, 101)], "tag long, id long")


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("tag:type==1", {101, 102, 103}),
        ("tag:type==2", {104, 105}),
        ("tag:type==1 and tag:category==10", {101}),
        ("tag:type==1 or tag:type==2", {101, 102, 103, 104, 105}),
        ("tag:type==999", set()),
        ("tag:type==1; limit: 2", [101, 102]),
        ("tag:type==1; offset: 1; limit: 2", [102, 103]),
        ("tag:type==1; sort: +id", [101, 102, 103]),
        ("tag:type==1; sort: -id", [103, 102, 101]),
        ("tag:type==1; offset: 5", []),
        ("tag:type not in [1]", {104, 105}),
        ("tag:type != 1", {104, 105}),
        ("not tag:type == 1 and tag:type in [1, 2]", {104, 105}),
    ],
)
def test_tag_queries(tags, query, expected):
    found = ids(Engine(tags=tags).query(query).df)
    assert (found if isinstance(expected, list) else set(found)) == expected and len(found) == len(set(found))


@pytest.mark.parametrize("text", ["tag:type==1", "tag:type==1; limit: 10", "a==1; sort: -name", "a==1 and b==2", "a==1; sort: -name, +size", "tag:type!=1", "tag:size>1000", "a==1 or b==2"])
def test_accepted(text):
    assert parse(text).condition is not None


@pytest.mark.parametrize(("text", "error"), [("tag:type??1", E.QuerySyntaxError), ("", E.InvalidQueryError), (" ; ", E.InvalidQueryError), ("a = 1", E.QuerySyntaxError), ("a == 1 and", E.QuerySyntaxError), ("a in []", E.QuerySyntaxError), ("a between 1", E.QuerySyntaxError), ("a == 1; limit: x", E.InvalidValueError), ("int:a == x", E.InvalidValueError), ("(a == 1", E.QuerySyntaxError)])
def test_rejected(text, error):
    with pytest.raises(error):
        parse(text)


def test_trees():
    assert parse("a == 1 and b == 2.5 or c == true").condition == Node("and", (Leaf("a", "eq", (1,), "integer"), Node("or", (Leaf("b", "eq", (2.5,), "float"), Leaf("c", "eq", (True,), "boolean")))))
    assert parse("a==1 and b in [2]").condition == Node("and", (Leaf("a", "eq", (1,), "integer"), Leaf("b", "in", ("2",), "string")))
    assert parse("x not in [1, 'a b']").condition == Leaf("x", "nin", ("1", "a b"), "string")
    assert parse('n == "12"').condition == Leaf("n", "eq", ("12",), "string")
    assert parse("name == two words and b == 1").condition.children[0] == Leaf("name", "eq", ("two words",), "string")
    assert parse("date:d between 2020-01-01 and 2021-01-01").condition == Leaf("d", "between", ("2020-01-01", "2021-01-01"), "date")
    q = parse("a == 1; a == 2; sort: -x, y; limit: 3; offset: 4")
    assert q.condition == Leaf("a", "eq", (2,), "integer") and q.sort == (SortKey("x", False), SortKey("y")) and (q.limit, q.offset) == (3, 4)
    assert parse('x == 1 and text:"a b"').condition == Node("and", (Leaf("x", "eq", (1,), "integer"), Text("a b")))
    assert parse("text:word").limit == 10
    assert split_text(parse('text:a and x == 1 and text:"b c"').condition) == ([Text("a"), Text("b c")], Leaf("x", "eq", (1,), "integer"))
    assert parse("a == 1").canonical() != parse("a == 2").canonical()


def test_builder_equals_text():
    q = where("a").gt(10).and_("b").eq("x").or_("c").in_("p", "q").full_text("hi").order_by("-a").paginate(3, 5).build()
    assert q == parse('a > 10 and b == x or c in [p, q] and text:hi; sort: -a; limit: 5; offset: 10')


@pytest.fixture(scope="module")
def entities(spark):
    rows = [(1, "ab", 3.9, True, "2024-01-02", None), (2, "cd", -3.9, False, "2024-03-01 10:00:00", 5), (3, "7", 0.0, None, "2024-01-02T00:00:00+02:00", 0), (4, None, None, None, "junk", None)]
    return spark.createDataFrame(rows, "id long, s string, f double, b boolean, d string, n int")


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("s == ab", {1}),
        ("s != ab", {2, 3}),
        ("int:f == 3", {1}),
        ("int:f == -3", {2}),
        ("f >= 0", {1, 3}),
        ("int:s == 7", {3}),
        ("bool:b == true", {1}),
        ("bool:b != true", {2}),
        ("bool:n == true", {2}),
        ("exists n", {2, 3}),
        ("not exists n", {1, 4}),
        ("int:n in [5, 6]", {2}),
        ("int:n not in [5]", {3}),
        ("date:d == 2024-01-02", {1}),
        ("date:d < 2024-01-02", {3}),
        ("date:d between 2024-01-01 and 2024-02-01", {1, 3}),
        ("s contains b", {1}),
        ("s startswith c", {2}),
        ("s endswith 7", {3}),
        ('s matches "^[a-c]"', {1, 2}),
        ("s between a and b", {1}),
        ("float:f between 9 and 1", set()),
        ("nosuch == 1", set()),
        ("nosuch != 1", set()),
        ("s == ab or s == cd and b == true", {1}),
        ("s == cd or (s == ab and bool:b == true)", {1, 2}),
    ],
)
def test_predicates(entities, query, expected):
    assert set(ids(Engine(entities).query(query).df)) == expected


def test_predicate_errors(entities):
    for query in ("s > a", "bool:b > true", "tag:x == 1"):
        with pytest.raises((E.UnsupportedOperatorError, E.InvalidQueryError)):
            Engine(entities).query(query.replace("> a", "> 'a'")).df.collect()
    with pytest.raises(Exception, match="CAST"):
        Engine(entities, strict=True).query("int:s == 7").df.collect()


def test_paging_and_totals(entities):
    result = Engine(entities).query("id > 0; sort: -id; limit: 2; offset: 1")
    assert ids(result.df) == [3, 2] and result.total() == 4
    assert [(r.id, r.total_count) for r in result.with_total().collect()] == [(3, 4), (2, 4)]
    assert ids(Engine(entities).query("id > 0; sort: s; limit: 2").df) == [4, 3]
    engine = Engine(entities)
    assert engine.cached("id > 1").count() == engine.cached("id > 1").count() == 3 and len(engine._kept) == 1


def test_pushdown(spark, entities, tmp_path):
    entities.write.parquet(str(tmp_path / "e"))
    plan = Engine(spark.read.parquet(str(tmp_path / "e"))).query("f > 1.5 and s == ab").df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(f,1.5)" in plan and "EqualTo(s,ab)" in plan and "Exchange" not in plan


def test_mixed_tags_text_predicates(spark, tags, entities):
    docs = spark.createDataFrame([(101, "red fox runs"), (102, "red red hen"), (104, "blue whale"), (1, "red")], "id long, content string")
    people = spark.createDataFrame([(101, "x", False), (102, "y", False), (103, "x", False), (104, "x", True)], "id long, s string, deleted boolean")
    engine = Engine(people, tags=tags, docs=docs, search=SearchOptions(threshold=0.0))
    assert set(ids(engine.query("tag:type == 1 and s == x").df)) == {101, 103}
    assert set(ids(engine.query("s == x").df)) == {101, 103}
    assert ids(engine.query("text:red and tag:type == 1").df) == [102, 101]
    assert set(ids(engine.query("text:whale or s == y").df)) == {104, 102}
    assert ids(engine.query('text:"red hen"').df)[0] == 102
    assert [c for c in engine.query("text:red and s == x", ["s"]).df.columns] == ["id", "score", "s"]


def test_tag_index(spark, tmp_path):
    index = TagIndex(spark.createDataFrame([(1, 123), (1, 124), (1, 125), (2, 456), (2, 457)], "tag long, id long"))
    assert len(ids(index.find_prefix(1, "12"))) == len(ids(index.find_prefix(1, ""))) == 3 and ids(index.find_prefix(3, "1")) == []
    assert len(ids(index.remove(spark.createDataFrame([(1, 123)], "tag long, id long")).find_prefix(1, "12"))) == 2
    index = TagIndex(spark.createDataFrame([(1, 100), (1, 200), (1, 300), (2, 150), (2, 250), (3, 100), (3, 200), (4, 150), (4, 250)], "tag long, id long"))
    compound = lambda *c: sorted(ids(index.find_compound(list(c))))
    assert compound(Condition(1)) == [100, 200, 300] and compound(Condition(1), Condition(2)) == []
    assert compound(Condition(1, "range", low=150, high=250)) == [200] and compound(Condition(1), Condition(3)) == [100, 200]
    assert compound(Condition(1, "gte", 200), Condition(3)) == [200] and compound(Condition(1, "contains", "30")) == [300]
    with pytest.raises(E.UnsupportedOperatorError):
        compound(Condition(1, "invalid"))
    with pytest.raises(E.InvalidQueryError):
        compound()
    with pytest.raises(E.InvalidValueError):
        index.find_in_shard(1, 16)
    assert ids(index.find_range(1, 100, 200)) == [100, 200] and ids(index.find_range(1, 300, 200)) == []
    path = str(tmp_path / "i")
    index.save(path)
    assert TagIndex.load(spark, path).tags.exceptAll(index.tags).isEmpty()
    spark.createDataFrame([(9, 9)], "tag long, id long").write.mode("append").partitionBy("tag").parquet(str(tmp_path / "other"))
    spark.read.parquet(f"{path}/postings").limit(3).write.parquet(str(tmp_path / "cut" / "postings"))
    spark.read.json(f"{path}/checksum").write.json(str(tmp_path / "cut" / "checksum"))
    with pytest.raises(E.CorruptedError):
        TagIndex.load(spark, str(tmp_path / "cut"))
    with pytest.raises(E.NotFoundError):
        TagIndex.load(spark, str(tmp_path / "none"))


def test_generated_index(spark):
    big = TagIndex(spark.range(10_000).select(F.lit(10).cast("long").alias("tag"), "id"))
    assert big.find_range(10, 1000, 9000).count() == 8001
    multiples = spark.range(1, 10_001).select(F.explode(F.array_compact(F.array(F.lit(1), F.when(F.col("id") % 2 == 0, 2), F.when(F.col("id") % 3 == 0, 3)).cast("array<bigint>"))).alias("tag"), "id")
    assert S.all_of(multiples, [2, 3]).count() == 1666
    twice = TagIndex(multiples).append(multiples)
    assert twice.compact().tags.count() == multiples.count() and twice.status().first().postings == 2 * multiples.count()
    assert {r.n for r in big.per_shard().collect()} == {625} and big.balance().first().balance == 1.0
    assert big.prefix_tree(10, 2).where("prefix = '42'").first().n == 111


def test_set_laws(spark):
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    a, b = frame([1, 1, 2, 3]), frame([2, 3, 3, 4])
    assert sorted(ids(S.intersect(a, b))) == [2, 3] and sorted(ids(S.difference(a, b))) == [1, 1] and sorted(ids(S.union(a, b))) == [1, 2, 3, 4]
    assert sorted(ids(S.intersect_all([a, b, frame([3])]))) == [3] and sorted(ids(S.union_all([a, b, frame([9])]))) == [1, 2, 3, 4, 9]


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick quick hen"), (3, "nothing here"), (4, "")], "id long, content string")
    index = FullTextIndex(docs)
    got = {r.id: r.score for r in index.scores("quick fox quick", SearchOptions(threshold=0.0)).collect()}
    import math

    idf = lambda df: 1 + math.log2(4 / df)
    assert got.keys() == {1, 2} and math.isclose(got[1], 2 * idf(2) / 3 + idf(1) / 3) and math.isclose(got[2], 2 * 2 / 3 * idf(2))
    assert {r.id: r.score for r in index.scores("quick", SearchOptions(idf="constant")).collect()} == {1: 2 / 3, 2: 4 / 3}
    assert ids(index.search("quick", SearchOptions(limit=1))) == [2] and ids(index.search("quick", SearchOptions(offset=1))) == [1]
    assert ids(index.search("quik", SearchOptions(fuzzy=0.75, threshold=0.0))) == [2, 1]
    index.save(str(tmp_path / "t"))
    assert {r.id for r in FullTextIndex.load(spark, str(tmp_path / "t")).search("fox").collect()} == {1}
    assert [(r.term, r.tf, r.positions) for r in index.postings().where("id = 2").orderBy("term").collect()] == [("hen", 1, [2]), ("quick", 2, [0, 1])]
    assert index.statistics().first().asDict() == {"docs": 4, "terms": 5, "tokens": 7, "avg_length": 1.75}
    assert index.highlight("quick").where("id = 1").first().content == "The <em>quick</em> brown fox"
    assert {r.id for r in index.remove(docs.where("id = 2")).search("quick").collect()} == {1}
    assert {r.id for r in index.upsert(spark.createDataFrame([(3, "quick now")], docs.schema)).search("quick").collect()} == {1, 2, 3}
    with pytest.raises(E.InvalidQueryError):
        index.search("the")


def test_texts_are_tokenized_once_and_postings_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "Red hen, red fox"), (2, "the hen"), (3, None), (4, "--- ...")], "id long, content string")
    index = FullTextIndex(docs, UNICODE)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    search = index.scores("hen", SearchOptions(fuzzy=0.9, idf="constant"))
    for df in (index.postings(), index.spans(), index.document_frequency(), search):
        assert plan(df).count("regexp_extract_all") == 1
    assert "Aggregate [id" not in plan(index.term_frequency()) + plan(index.document_frequency())


def test_terms_of_repeated_ids_count_once(spark):
    rows = [(1, "red hen red"), (1, "hen fox"), (2, "hen"), (None, "fox"), (None, "fox owl"), (3, ""), (4, None)]
    index = FullTextIndex(spark.createDataFrame(rows, "id long, content string"))
    assert {(r.term, r.df) for r in index.document_frequency().collect()} == {("red", 1), ("hen", 2), ("fox", 1), ("owl", 0)}
    spans = {(r.term, r.id): (r.tf, r.first_pos, r.last_pos) for r in index.spans().collect()}
    assert spans == {("red", 1): (2, 0, 2), ("hen", 1): (2, 0, 1), ("fox", 1): (1, 1, 1), ("hen", 2): (1, 0, 0), ("fox", None): (2, 0, 0), ("owl", None): (1, 1, 1)}
    assert {(r.term, r.tf, r.df) for r in index.term_statistics().collect()} == {("red", 2, 1), ("hen", 3, 2), ("fox", 3, 1), ("owl", 1, 0)}


def test_simple_tokens_are_pieces_between_white_space_without_outer_punctuation(spark):
    texts = ["", " ", "...", "--Ab-c..  (d.e)!x", "ΟΔΟΣ. 'Σ ΑΣ', a.Σ Σ.a İSTANBUL", "　x ¿y? z\u0085", "٣, $5. ​q", "😀! «Été» ..a..b.."]
    old = F.filter(F.transform(F.transform(F.split("t", r"(?U)\s+"), lambda t: F.regexp_replace(t, r"^\p{P}+|\p{P}+$", "")), F.lower), lambda t: (t != "") & ~t.isin(*SIMPLE.stop_words))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(old.alias("a"), SIMPLE.terms(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in df.collect()) and df.count() == len(texts)


def test_saved_postings_are_filtered_in_the_scan(spark, tmp_path):
    index = FullTextIndex(spark.createDataFrame([(1, "red hen"), (2, "fox")], "id long, content string"))
    index.save(str(tmp_path))
    found = FullTextIndex.load(spark, str(tmp_path)).scores("hen", SearchOptions(threshold=0.0))
    assert "EqualTo(term,hen)" in found._jdf.queryExecution().executedPlan().toString() and [r.id for r in found.collect()] == [1]
