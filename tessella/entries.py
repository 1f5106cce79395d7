"""The registered queries over the driver's tables, one or more an operator, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import expressions as X
from tessella.functions import tokenizers as K
from tessella.operators import analytics as A
from tessella.operators import blocks as B
from tessella.operators import filesystem as FS
from tessella.operators import metadata as M
from tessella.operators import security as SEC
from tessella.operators import set_ops as S
from tessella.operators.fulltext import FullTextIndex, SearchOptions
from tessella.operators.tag_index import Condition, TagIndex
from tessella.plans.builder import where
from tessella.plans.engine import Engine
from tessella.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


# --- the query language over single tables -------------------------------------------------------------------------


def _dsl(name: str, source: str, key: str, text: str, sql_where: str, *, tail: str = "", columns: tuple[str, ...] = ()) -> None:
    """A DSL query over one table; its SQL is the condition in DuckDB's words."""
    picked = "".join(f", {c}" for c in columns)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return Engine(table(spark, d, source), id_col=key).query(text, list(columns)).df

    register(name, f"SELECT {key} AS id{picked} FROM {source} WHERE {sql_where} {tail}")(run)


_dsl("pred_eq_string", "customer", "c_custkey", "c_mktsegment == BUILDING", "c_mktsegment = 'BUILDING'")
_dsl("pred_ne_string", "customer", "c_custkey", "c_mktsegment != BUILDING", "c_mktsegment <> 'BUILDING'")
_dsl("pred_contains", "part", "p_partkey", "p_type contains S", "contains(p_type, 'S')")
_dsl("pred_startswith", "part", "p_partkey", 'p_brand startswith "Brand#1"', "starts_with(p_brand, 'Brand#1')")
_dsl("pred_endswith", "part", "p_partkey", "p_brand endswith 3", "ends_with(p_brand, '3')")
_dsl("pred_matches", "part", "p_partkey", 'p_brand matches "#[12][0-4]$"', "regexp_matches(p_brand, '#[12][0-4]$')")
for _op, _sql in {"==": "=", "!=": "<>", ">": ">", ">=": ">=", "<": "<", "<=": "<="}.items():
    _word = {"==": "eq", "!=": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[_op]
    _dsl(f"pred_int_{_word}", "events", "event_id", f"int:value {_op} 42", f"trunc(value)::BIGINT {_sql} 42")
    _dsl(f"pred_float_{_word}", "events", "event_id", f"value {_op} 10.5", f"value {_sql} 10.5")
    _dsl(f"pred_date_{_word}", "orders", "o_orderkey", f"date:o_orderdate {_op} 1996-01-02", f"o_orderdate {_sql} TIMESTAMP '1996-01-02'")
_dsl("pred_bool_eq", "labels", "doc_id", "bool:toxic == true", "toxic <> 0")
_dsl("pred_bool_ne", "labels", "doc_id", "bool:quality != true", "(quality <> 0) <> true")
_dsl("pred_in", "part", "p_partkey", 'p_brand in ["Brand#12", "Brand#23"]', "p_brand IN ('Brand#12', 'Brand#23')")
_dsl("pred_nin", "part", "p_partkey", 'p_brand not in ["Brand#12", "Brand#23"]', "p_brand NOT IN ('Brand#12', 'Brand#23')")
_dsl("pred_in_int", "part", "p_partkey", "int:p_size in [1, 7, 50]", "p_size IN (1, 7, 50)")
_dsl("between_string", "part", "p_partkey", 'p_brand between "Brand#2" and "Brand#3"', "p_brand BETWEEN 'Brand#2' AND 'Brand#3'")
_dsl("between_int", "part", "p_partkey", "int:p_size between 10 and 20", "p_size BETWEEN 10 AND 20")
_dsl("between_float", "orders", "o_orderkey", "float:o_totalprice between 1000.5 and 99999.25", "o_totalprice BETWEEN 1000.5 AND 99999.25")
_dsl("between_date", "orders", "o_orderkey", "date:o_orderdate between 1995-01-01 and 1995-12-31", "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
_dsl("and_or_precedence", "orders", "o_orderkey", "o_orderstatus == O and o_totalprice > 300000.0 or o_totalprice < 5000.0", "o_orderstatus = 'O' AND (o_totalprice > 300000 OR o_totalprice < 5000)")
_dsl("parentheses", "orders", "o_orderkey", "(o_orderstatus == O and o_totalprice > 300000.0) or o_totalprice < 5000.0", "(o_orderstatus = 'O' AND o_totalprice > 300000) OR o_totalprice < 5000")
_dsl("not_condition", "orders", "o_orderkey", "not (o_orderstatus == O or o_totalprice > 100000.0)", "NOT (o_orderstatus = 'O' OR o_totalprice > 100000)")
_dsl("last_part_wins", "part", "p_partkey", "int:p_size == 3; int:p_size == 4", "p_size = 4")
_dsl("sort_limit_offset", "orders", "o_orderkey", "o_totalprice > 200000.0; sort: -o_totalprice, +id; limit: 20; offset: 5", "o_totalprice > 200000", tail="ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", columns=("o_totalprice",))
_dsl("flagship", "orders", "o_orderkey", "int:id between 100 and 500000 and o_totalprice > 200000.0 ; sort: -o_totalprice, +id ; limit: 20", "o_orderkey BETWEEN 100 AND 500000 AND o_totalprice > 200000", tail="ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", columns=("o_totalprice",))


@register("exists_field", "SELECT d.doc_id AS id FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL")
def exists_field(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return Engine(joined, id_col="doc_id").query("exists toxic").df


@register("absent_field_nin", "SELECT d.doc_id AS id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality NOT IN (1)")
def absent_field_nin(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return Engine(joined, id_col="doc_id").query("int:quality not in [1]").df


@register("result_with_total", "SELECT o_orderkey AS id, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::BIGINT AS total_count FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10")
def result_with_total(spark: SparkSession, d: str) -> DataFrame:
    return Engine(table(spark, d, "orders"), id_col="o_orderkey").query("o_orderstatus == F; sort: id; limit: 10").with_total()


@register("fluent_builder", "SELECT p_partkey AS id FROM part WHERE p_size > 10 AND (p_brand = 'Brand#12' OR p_retailprice < 950.0) ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 25")
def fluent_builder(spark: SparkSession, d: str) -> DataFrame:
    q = where("p_size").gt(10).and_("p_brand").eq("Brand#12").or_("p_retailprice").lt(950.0).order_by("-p_size").paginate(2, 25)
    return Engine(table(spark, d, "part"), id_col="p_partkey").query(q).df


# --- tags ----------------------------------------------------------------------------------------------------------

TAGS_SQL = "WITH tags AS (SELECT 1000 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS tag, o_orderkey AS id FROM orders UNION ALL SELECT 2000 + c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) "


def tags(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    kind = orders.select((F.lit(999) + F.substring("o_orderpriority", 1, 1).cast("bigint")).alias("tag"), F.col("o_orderkey").alias("id"))
    nation = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select((F.lit(2000) + F.col("c_nationkey")).cast("bigint").alias("tag"), F.col("o_orderkey").alias("id"))
    return kind.unionByName(nation)


def index(spark: SparkSession, d: str) -> TagIndex:
    return TagIndex(tags(spark, d))


def _tagged(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Engine(tags=tags(spark, d)).query(text).df

    register(name, TAGS_SQL + sql)(run)


_tagged("tag_eq", "tag:type == 1", "SELECT DISTINCT id FROM tags WHERE tag = 1000")
_tagged("tag_number", "tag:x == 2003", "SELECT DISTINCT id FROM tags WHERE tag = 2003")
_tagged("tag_category", "tag:category == 7", "SELECT DISTINCT id FROM tags WHERE tag = 2007")
_tagged("tag_in", "tag:category in [1, 2, 3]", "SELECT DISTINCT id FROM tags WHERE tag IN (2001, 2002, 2003)")
_tagged("tag_nin", "tag:category not in [1, 2, 3]", "SELECT id FROM tags EXCEPT SELECT id FROM tags WHERE tag IN (2001, 2002, 2003)")
_tagged("tag_and", "tag:type == 1 and tag:category == 7", "SELECT id FROM tags WHERE tag = 1000 INTERSECT SELECT id FROM tags WHERE tag = 2007")
_tagged("tag_or", "tag:type == 1 or tag:category == 7", "SELECT id FROM tags WHERE tag = 1000 UNION SELECT id FROM tags WHERE tag = 2007")
_tagged("tag_not", "not tag:type == 1", "SELECT id FROM tags EXCEPT SELECT id FROM tags WHERE tag = 1000")
_tagged("tag_mixed", "tag:type == 1 or tag:type == 2 and tag:category in [3, 4]", "(SELECT id FROM tags WHERE tag IN (1000, 1001)) INTERSECT (SELECT id FROM tags WHERE tag IN (2003, 2004))")
_tagged("tag_unknown", "tag:type == 999", "SELECT DISTINCT id FROM tags WHERE tag = 1998")


@register("tag_and_predicate", TAGS_SQL + "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderkey IN (SELECT id FROM tags WHERE tag = 1002) ORDER BY o_totalprice DESC, id LIMIT 50")
def tag_and_predicate(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(table(spark, d, "orders"), tags=tags(spark, d), id_col="o_orderkey")
    return engine.query("tag:type == 3 and o_totalprice > 100000.0; sort: -o_totalprice; limit: 50", ["o_totalprice"]).df


@register("tags_all_of", TAGS_SQL + "SELECT id FROM tags WHERE tag IN (1003, 2010) GROUP BY id HAVING count(DISTINCT tag) = 2")
def tags_all_of(spark: SparkSession, d: str) -> DataFrame:
    return S.all_of(tags(spark, d), [1003, 2010])


@register("set_intersect", TAGS_SQL + "SELECT id FROM tags WHERE tag = 1001 AND id IN (SELECT id FROM tags WHERE tag = 2005)")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return S.intersect(i.find(1001), i.find(2005))


@register("set_union", TAGS_SQL + "SELECT id FROM tags WHERE tag = 1001 UNION SELECT id FROM tags WHERE tag = 2005")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return S.union(i.find(1001), i.find(2005))


@register("set_difference", TAGS_SQL + "SELECT id FROM tags WHERE tag = 1001 AND id NOT IN (SELECT id FROM tags WHERE tag = 2005)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return S.difference(i.find(1001), i.find(2005))


@register("set_n_ary", TAGS_SQL + "(SELECT id FROM tags WHERE tag IN (1000, 1001, 1002)) INTERSECT (SELECT id FROM tags WHERE tag BETWEEN 2000 AND 2009)")
def set_n_ary(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return S.intersect_all([S.union_all([i.find(t) for t in (1000, 1001, 1002)]), i.tags.where("tag between 2000 and 2009")]).select("id").distinct()


@register("full_scan", TAGS_SQL + "SELECT DISTINCT id FROM tags")
def full_scan(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).ids()


@register("find_tag", TAGS_SQL + "SELECT id FROM tags WHERE tag = 2004")
def find_tag(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).find(2004)


@register("find_in_shard", TAGS_SQL + "SELECT id FROM tags WHERE tag = 1002 AND id % 16 = 5")
def find_in_shard(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).find_in_shard(1002, 5)


@register("find_pattern", TAGS_SQL + "SELECT tag, id FROM tags WHERE contains(tag::VARCHAR, '01')")
def find_pattern(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).find_pattern("01")


@register("find_prefix", TAGS_SQL + "SELECT id FROM tags WHERE tag = 1001 AND starts_with(id::VARCHAR, '12')")
def find_prefix(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).find_prefix(1001, "12")


@register("prefix_tree", TAGS_SQL + "SELECT prefix, count(*) AS n FROM (SELECT substr(id::VARCHAR, 1, unnest(range(1, least(8, length(id::VARCHAR)) + 1))::BIGINT) AS prefix FROM tags WHERE tag = 1001) GROUP BY prefix")
def prefix_tree(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).prefix_tree(1001)


@register("find_range", TAGS_SQL + "SELECT id FROM tags WHERE tag = 1003 AND id BETWEEN 1000 AND 9000")
def find_range(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).find_range(1003, 1000, 9000)


@register("find_compound", TAGS_SQL + "SELECT DISTINCT id FROM tags WHERE tag = 1000 AND id IN (SELECT id FROM tags WHERE tag = 2003) AND id BETWEEN 100 AND 400000 AND starts_with(id::VARCHAR, '1')")
def find_compound(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).find_compound([Condition(1000), Condition(2003), Condition(1000, "range", low=100, high=400000), Condition(1000, "prefix", "1")])


@register("find_compound_compare", TAGS_SQL + "SELECT DISTINCT id FROM tags WHERE tag = 1000 AND id > 500 AND id <> 700 AND ends_with(id::VARCHAR, '7')")
def find_compound_compare(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).find_compound([Condition(1000, "gt", 500), Condition(1000, "neq", 700), Condition(1000, "suffix", "7")])


@register("batch_add", TAGS_SQL + "SELECT tag, id FROM tags UNION SELECT tag + 1, id FROM tags WHERE tag < 1003")
def batch_add(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return i.add(i.tags.where("tag < 1003").select((F.col("tag") + 1).alias("tag"), "id")).tags


@register("batch_remove", TAGS_SQL + "SELECT tag, id FROM tags EXCEPT SELECT tag, id FROM tags WHERE tag >= 2000 AND id % 3 = 0")
def batch_remove(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return i.remove(i.tags.where("tag >= 2000 and id % 3 = 0")).tags


@register("dedup_compact", TAGS_SQL + "SELECT DISTINCT tag, id FROM (SELECT * FROM tags UNION ALL SELECT * FROM tags WHERE id % 2 = 0)")
def dedup_compact(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return i.append(i.tags.where("id % 2 = 0")).compact().tags


@register("index_metadata", "SELECT unnest([1000 + p_size, 3000 + length(p_type)])::BIGINT AS tag, p_partkey AS id FROM part")
def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array((F.lit(1000) + F.col("p_size")).cast("bigint"), (F.lit(3000) + F.length("p_type")).cast("bigint")).alias("tags"))
    return TagIndex(spark.createDataFrame([], "tag long, id long")).index_metadata(rows).tags


@register("index_status", TAGS_SQL + "SELECT count(*) AS postings, count(DISTINCT tag) AS tags, count(DISTINCT id) AS ids FROM tags")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).status()


@register("items_per_shard", TAGS_SQL + "SELECT s.shard, count(t.id) AS n FROM (SELECT unnest(range(16)) AS shard) s LEFT JOIN tags t ON t.id % 16 = s.shard GROUP BY s.shard")
def items_per_shard(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).per_shard()


@register("shard_balance", TAGS_SQL + "SELECT round(1 - least(1, stddev_pop(n) / avg(n)), 9) AS balance FROM (SELECT count(t.id) AS n FROM (SELECT unnest(range(16)) AS shard) s LEFT JOIN tags t ON t.id % 16 = s.shard GROUP BY s.shard)")
def shard_balance(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).balance().select(F.round("balance", 9).alias("balance"))


@register("verify_index", TAGS_SQL + "SELECT tag, id FROM tags WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def verify_index(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return index(spark, d).verify(live).select("tag", "id")


@register("async_net_changes", TAGS_SQL + "SELECT tag, id FROM tags EXCEPT SELECT tag, id FROM tags WHERE id % 5 = 0 AND id % 2 = 1 UNION SELECT 3000, id FROM tags WHERE tag = 1000 AND id % 2 = 0")
def async_net_changes(spark: SparkSession, d: str) -> DataFrame:
    t = tags(spark, d)
    change = lambda rows, op, seq: rows.select("tag", "id", F.lit(op).alias("op"), F.lit(seq).alias("seq"))
    new = t.where("tag = 1000 and id % 2 = 0").withColumn("tag", F.lit(3000).cast("bigint"))
    events = change(t.where("id % 5 = 0"), "remove", 1).unionByName(change(t.where("id % 5 = 0 and id % 2 = 0"), "add", 2)).unionByName(change(new, "add", 1))
    return ingest.apply_batch(t, events)


# --- text ----------------------------------------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in sorted(K.ENGLISH | K.CHINESE))
_EN_STOPS = ", ".join(f"'{w}'" for w in sorted(K.ENGLISH))
_SIMPLE_SQL = f"WITH docs AS (SELECT doc_id AS id, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda t: lower(regexp_replace(t, '^\\p{{P}}+|\\p{{P}}+$', '', 'g'))), lambda t: t <> '' AND t NOT IN ({_STOPS})) AS terms FROM documents), tokens AS (SELECT id, unnest(terms) AS term, len(terms) AS length FROM docs) "
_UNICODE_SQL = f"WITH docs AS (SELECT doc_id AS id, list_filter(list_transform(regexp_extract_all(text, '\\p{{L}}+|\\p{{N}}+'), lambda t: lower(t)), lambda t: t NOT IN ({_EN_STOPS})) AS terms FROM documents) "


def corpus(spark: SparkSession, d: str, tokenizer: K.Tokenizer = K.SIMPLE) -> FullTextIndex:
    return FullTextIndex(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), tokenizer)


@register("tokenize_simple", _SIMPLE_SQL + "SELECT id, term, count(*) AS n FROM tokens GROUP BY id, term")
def tokenize_simple(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).term_frequency().withColumnRenamed("tf", "n")


@register("tokenize_unicode", _UNICODE_SQL + "SELECT id, len(terms) AS n, md5(array_to_string(terms, ' ')) AS digest FROM docs")
def tokenize_unicode(spark: SparkSession, d: str) -> DataFrame:
    terms = K.UNICODE.terms(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), terms.alias("t")).select("id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@register("term_stats", _SIMPLE_SQL + "SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM tokens GROUP BY term")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).term_statistics()


@register("doc_freq", _SIMPLE_SQL + "SELECT term, count(DISTINCT id) AS df FROM tokens GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).document_frequency()


@register("postings", _SIMPLE_SQL + "SELECT term, id, count(*) AS tf, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM (SELECT id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM docs) GROUP BY term, id")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).spans().withColumns({c: F.col(c).cast("bigint") for c in ("first_pos", "last_pos")})


@register("corpus_stats", _SIMPLE_SQL + "SELECT count(*) AS docs, (SELECT count(DISTINCT term) FROM tokens) AS terms, sum(len(terms))::BIGINT AS tokens, round(avg(len(terms)), 6) AS avg_length FROM docs")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).statistics().withColumn("avg_length", F.round("avg_length", 6))


def _search_sql(terms: str, idf: str, threshold: float, tail: str) -> str:
    return _SIMPLE_SQL + f", hits AS (SELECT id, length, term, count(*) AS tf FROM tokens WHERE term IN ({terms}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM hits GROUP BY term), scores AS (SELECT id, sum(tf / length * ({idf})) AS score FROM hits JOIN df USING (term) GROUP BY id HAVING sum(tf / length * ({idf})) >= {threshold}) " + tail


_LOG = "1 + log2((SELECT count(*) FROM documents) / df)"


@register("search_tfidf", _search_sql("'erer', 'tion'", _LOG, 0.005, "SELECT id, round(score, 9) AS score FROM scores"))
def search_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).scores("erer tion", SearchOptions(threshold=0.005)).select("id", F.round("score", 9).alias("score"))


@register("search_constidf", _search_sql("'erer', 'tion'", "2.0", 0.01, "SELECT id, round(score, 9) AS score FROM scores"))
def search_constidf(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).scores("erer tion", SearchOptions(threshold=0.01, idf="constant")).select("id", F.round("score", 9).alias("score"))


@register("search_ranked_page", _search_sql("'erer', 'tion', 'thhe'", _LOG, 0.0, "SELECT id, round(score, 9) AS score FROM scores ORDER BY scores.score DESC, id LIMIT 10 OFFSET 5"))
def search_ranked_page(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).search("erer tion thhe", SearchOptions(threshold=0.0, limit=10, offset=5)).select("id", F.round("score", 9).alias("score"))


@register("search_and_filter", _search_sql("'erer', 'tion'", _LOG, 0.0, "SELECT s.id, round(s.score, 9) AS score FROM scores s JOIN documents ON doc_id = s.id WHERE lang = 'en' AND n_chars > 1000 ORDER BY s.score DESC, s.id LIMIT 20"))
def search_and_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    engine = Engine(docs.select("doc_id", "lang", "n_chars"), docs=docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), id_col="doc_id", search=SearchOptions(threshold=0.0))
    return engine.query('text:"erer tion" and lang == en and n_chars > 1000; limit: 20').df.select("id", F.round("score", 9).alias("score"))


@register("search_or_filter", _SIMPLE_SQL + "SELECT DISTINCT id FROM tokens WHERE term = 'erer' UNION SELECT doc_id FROM documents WHERE lang = 'fr'")
def search_or_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    engine = Engine(docs.select("doc_id", "lang"), docs=docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), id_col="doc_id", search=SearchOptions(threshold=0.0))
    return engine.query("text:erer or lang == fr").df


@register("substring_search", "SELECT doc_id AS id FROM documents WHERE contains(text, 'tionth')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return Engine(table(spark, d, "documents"), id_col="doc_id").query("text contains tionth").df


@register("token_types", _SIMPLE_SQL + "SELECT CASE WHEN regexp_matches(term, '^[0-9.+-]*[0-9][0-9.+-]*$') THEN 'number' WHEN regexp_matches(term, '^[\\p{P}\\p{S}]+$') THEN 'symbol' ELSE 'word' END AS kind, count(*) AS n FROM tokens GROUP BY kind")
def token_types(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).tokens().groupBy(K.token_type(F.col("term")).alias("kind")).agg(F.count("*").alias("n"))


# --- metadata and blocks -------------------------------------------------------------------------------------------

_META_SQL = "WITH metadata AS (SELECT c_custkey::VARCHAR AS file_id, 4 AS tag, encode(c_name) AS value FROM customer UNION ALL SELECT c_custkey::VARCHAR, 4097, encode(c_mktsegment) FROM customer UNION ALL SELECT c_custkey::VARCHAR, 4098, encode(c_nationkey::VARCHAR) FROM customer) "


def metadata(spark: SparkSession, d: str) -> M.Metadata:
    return M.Metadata(M.from_entities(table(spark, d, "customer"), "c_custkey", {"c_name": 4, "c_mktsegment": 4097, "c_nationkey": 4098}))


for _name, _op, _sql in (("eq", M.EQ, "value = encode('MACHINERY')"), ("ne", M.NE, "value <> encode('MACHINERY')"), ("gt", M.GT, "ascii(decode(value)) > ascii('F')"), ("lt", M.LT, "ascii(decode(value)) < ascii('F')"), ("contains", M.CONTAINS, "contains(decode(value), 'UI')")):
    _value = {"gt": b"F", "lt": b"F", "contains": b"UI"}.get(_name, b"MACHINERY")

    def _bytes(spark: SparkSession, d: str, op: int = _op, value: bytes = _value) -> DataFrame:
        return metadata(spark, d).matching([M.Condition(4097, op, value)])

    register(f"bytes_{_name}", _META_SQL + f"SELECT file_id FROM metadata WHERE tag = 4097 AND {_sql}")(_bytes)


@register("metadata_and", _META_SQL + "SELECT file_id FROM metadata WHERE tag = 4097 AND value = encode('BUILDING') INTERSECT SELECT file_id FROM metadata WHERE tag = 4098 AND value = encode('7')")
def metadata_and(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).matching([M.Condition(4097, M.EQ, b"BUILDING"), M.Condition(4098, M.EQ, b"7")])


@register("metadata_or", _META_SQL + "SELECT file_id FROM metadata WHERE tag = 4097 AND value = encode('BUILDING') UNION SELECT file_id FROM metadata WHERE tag = 4098 AND value = encode('7')")
def metadata_or(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).matching([M.Condition(4097, M.EQ, b"BUILDING"), M.Condition(4098, M.EQ, b"7")], any_of=True)


@register("metadata_page", _META_SQL + ", hits AS (SELECT m.file_id, n.value FROM metadata m JOIN metadata n ON n.file_id = m.file_id AND n.tag = 4 WHERE m.tag = 4097 AND m.value = encode('BUILDING')) SELECT file_id, (SELECT count(*) FROM hits) AS total_count, (SELECT count(*) FROM hits) > 25 AS has_more FROM (SELECT file_id FROM hits ORDER BY value DESC, file_id LIMIT 20 OFFSET 5)")
def metadata_page(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).query([M.Condition(4097, M.EQ, b"BUILDING")], limit=20, offset=5, sort_tag=4, descending=True)


@register("metadata_by_tag", _META_SQL + "SELECT file_id, tag FROM metadata WHERE tag = 4098 AND value = encode('3') ORDER BY file_id LIMIT 100")
def metadata_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).by_tag(4098, b"3").select("file_id", "tag")


@register("metadata_batch", _META_SQL + "SELECT file_id, tag, CASE WHEN tag = 4097 AND file_id::BIGINT % 3 = 1 THEN decode(value) || '+x' ELSE decode(value) END AS value FROM metadata WHERE NOT (tag = 4098 AND file_id::BIGINT % 3 = 0) UNION ALL SELECT c_custkey::VARCHAR, 5000, 'new' FROM customer WHERE c_custkey % 3 = 2")
def metadata_batch(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("file_id"))
    op = lambda rows, tag, seq, kind, value: rows.select("file_id", F.lit(tag).alias("tag"), F.lit(seq).alias("seq"), F.lit(kind).alias("op"), F.lit(value).alias("value"))
    ops = op(ids.where("k % 3 = 0"), 4098, 1, 1, b"").unionByName(op(ids.where("k % 3 = 1"), 4097, 1, 2, b"+")).unionByName(op(ids.where("k % 3 = 1"), 4097, 2, 2, b"x")).unionByName(op(ids.where("k % 3 = 2"), 5000, 1, 0, b"old")).unionByName(op(ids.where("k % 3 = 2"), 5000, 2, 0, b"new"))
    return metadata(spark, d).batch(ops).rows.withColumn("value", F.col("value").cast("string"))


@register("tag_classes", "SELECT count(*) FILTER (WHERE t < 256) AS system, count(*) FILTER (WHERE t BETWEEN 256 AND 4095) AS app, count(*) FILTER (WHERE t >= 4096) AS users FROM (SELECT CASE WHEN p_size < 20 THEN p_size WHEN p_size < 30 THEN p_size * 100 ELSE 4096 + (p_partkey & 4095) END AS t FROM part)")
def tag_classes(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    t = F.when(size < 20, size).when(size < 30, size * 100).otherwise(X.user_tag(F.col("p_partkey")))
    return table(spark, d, "part").select(t.alias("t")).agg(F.count_if(X.is_system_tag(F.col("t"))).alias("system"), F.count_if(X.is_app_tag(F.col("t"))).alias("app"), F.count_if(X.is_user_tag(F.col("t"))).alias("users"))


@register("int64_codec", "SELECT o_orderkey AS id, o_orderkey * -7 AS value FROM orders")
def int64_codec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.int64_be(X.encode_int64_be(F.col("o_orderkey") * -7)).alias("value"))


@register("checksums", "SELECT doc_id AS id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2("text", 256).alias("sha256"))


@register("djb2", "SELECT c_custkey AS id, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296) AS hash FROM customer")
def djb2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.djb2(F.col("c_name")).alias("hash"))


@register("block_paths", "SELECT doc_id AS id, lower(lpad(to_hex(doc_id % 256), 2, '0')) || '/' || lower(lpad(to_hex((doc_id // 256) % 256), 2, '0')) || '/' || lower(lpad(to_hex(doc_id), 8, '0')) || '.blk' AS path FROM documents")
def block_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.block_path(F.col("doc_id")).alias("path"))


@register("write_blocks", "SELECT row_number() OVER (ORDER BY p_partkey) AS block_id, p_partkey, octet_length(encode(p_name)) AS size, md5(p_name) AS checksum FROM part")
def write_blocks(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "part").select("p_partkey", F.col("p_name").cast("binary").alias("data"))
    return B.written(data, ["p_partkey"]).select("block_id", "p_partkey", "size", "checksum")


@register("write_blocks_reusing", "WITH f AS (SELECT n_nationkey * 3 AS freed, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT s_suppkey, coalesce(freed, b.k - (SELECT count(*) FROM f) + 999) AS block_id FROM b LEFT JOIN f USING (k)")
def write_blocks_reusing(spark: SparkSession, d: str) -> DataFrame:
    free = table(spark, d, "nation").select((F.col("n_nationkey") * 3).alias("block_id"))
    return B.number(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], free, first=1000).select("s_suppkey", "block_id")


@register("block_chain", "WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS id, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations), walk(start, id, depth) AS (SELECT conv_id * 1000 + min(turn), conv_id * 1000 + min(turn), 0 FROM conversations GROUP BY conv_id UNION ALL SELECT w.start, e.next, w.depth + 1 FROM walk w JOIN e ON e.id = w.id WHERE e.next IS NOT NULL) SELECT start, id, depth FROM walk")
def block_chain(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    edges = turns.withColumn("next", F.lead("id").over(Window.partitionBy("conv_id").orderBy("id"))).select("id", "next")
    return B.chain(edges, turns.groupBy("conv_id").agg(F.min("id").alias("id")).select("id")).withColumn("depth", F.col("depth").cast("int"))


@register("block_type_names", "SELECT CASE p_size % 10 WHEN 0 THEN 'normal' WHEN 1 THEN 'metadata' WHEN 2 THEN 'index' WHEN 3 THEN 'delta' WHEN 4 THEN 'xor' WHEN 5 THEN 'compression' WHEN 6 THEN 'encrypted' WHEN 7 THEN 'indirect' WHEN 8 THEN 'system' ELSE 'unknown' END AS kind, count(*) AS n FROM part GROUP BY kind")
def block_type_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(B.type_name(F.col("p_size") % 10).alias("kind")).agg(F.count("*").alias("n"))


@register("content_addressed", "SELECT sha256(text) AS hash, count(*) AS copies FROM documents GROUP BY hash")
def content_addressed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"))


# --- access, placement, latency ------------------------------------------------------------------------------------

_LOCATION = "CASE event_type WHEN 'view' THEN 'inline' WHEN 'click' THEN 'container' ELSE 'directory' END"
_RECORDS_SQL = f"WITH access AS (SELECT user_id::VARCHAR AS block_key, CAST(trunc(value * 100) AS BIGINT) AS size, {_LOCATION} AS location, ts, event_id AS seq FROM events), records AS (SELECT block_key, count(*) AS n, min(ts) AS first, max(ts) AS last, arg_max(location, (ts, seq)) AS location, arg_max(size, (ts, seq)) FILTER (WHERE size > 0) AS size FROM access GROUP BY block_key), now AS (SELECT max(ts) AS t FROM events) "
_COLD = "epoch_us((SELECT t FROM now)) - epoch_us(last) > 1800000000"


def access_log(spark: SparkSession, d: str) -> DataFrame:
    location = F.when(F.col("event_type") == "view", "inline").when(F.col("event_type") == "click", "container").otherwise("directory")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("block_key"), (F.col("value") * 100).cast("bigint").alias("size"), location.alias("location"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "event_type")


def records(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    log = access_log(spark, d)
    return A.access_records(log), log.agg(F.max("ts")).scalar()


@register("access_record", _RECORDS_SQL + "SELECT block_key, n, epoch_us(first) AS first, epoch_us(last) AS last, location, size FROM records")
def access_record(spark: SparkSession, d: str) -> DataFrame:
    found, _ = records(spark, d)
    return found.select("block_key", "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "location", "size")


@register("hot_cold", _RECORDS_SQL + f"SELECT block_key, n >= 5 AS hot, {_COLD} AS cold FROM records")
def hot_cold(spark: SparkSession, d: str) -> DataFrame:
    found, now = records(spark, d)
    return found.select("block_key", A.is_hot().alias("hot"), A.is_cold(now).alias("cold"))


_SCORE_SQL = "round(least(n / 10, 0.7) + greatest(1 - (epoch_us((SELECT t FROM now)) - epoch_us(last)) / 86400000000.0, 0) * 0.3, 9)"


@register("importance", _RECORDS_SQL + f"SELECT block_key, {_SCORE_SQL} AS score FROM records")
def importance(spark: SparkSession, d: str) -> DataFrame:
    found, now = records(spark, d)
    return found.select("block_key", F.round(A.importance(now), 9).alias("score"))


@register("topk_score", _RECORDS_SQL + f"SELECT block_key, {_SCORE_SQL} AS score FROM records ORDER BY score DESC, block_key LIMIT 25")
def topk_score(spark: SparkSession, d: str) -> DataFrame:
    found, now = records(spark, d)
    return found.select("block_key", F.round(A.importance(now), 9).alias("score")).orderBy(F.desc("score"), "block_key").limit(25)


@register("placement_simple", "SELECT CASE WHEN n_chars <= 1024 THEN 'inline' ELSE 'directory' END AS place, count(*) AS n FROM documents GROUP BY place")
def placement_simple(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(A.place_simple(F.col("n_chars")).alias("place")).agg(F.count("*").alias("n"))


@register("placement_adaptive", _RECORDS_SQL + f"SELECT doc_id AS id, CASE WHEN n_chars <= 1024 THEN 'inline' WHEN n IS NULL THEN CASE WHEN n_chars > 1048576 THEN 'directory' ELSE 'container' END WHEN n >= 5 THEN 'container' WHEN {_COLD} THEN 'directory' WHEN n_chars > 524288 THEN 'directory' ELSE 'container' END AS place FROM documents LEFT JOIN records ON block_key = doc_id::VARCHAR")
def placement_adaptive(spark: SparkSession, d: str) -> DataFrame:
    found, now = records(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(found, F.col("doc_id").cast("string") == F.col("block_key"), "left")
    return docs.select(F.col("doc_id").alias("id"), A.place_adaptive(F.col("n_chars"), now).alias("place"))


@register("hybrid_stats", "SELECT CASE WHEN n_chars <= 512 THEN 'inline' WHEN n_chars >= 1048576 THEN 'directory' ELSE 'container' END AS location, count(*) AS blocks, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY location")
def hybrid_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.location_stats(table(spark, d, "documents").select(F.col("n_chars").alias("size")))


_SHARES_SQL = "count(*) AS total, avg((location = 'inline')::INT) AS inline, avg((location = 'container')::INT) AS container, avg((location = 'directory')::INT) AS directory"


@register("distribution_simple", _RECORDS_SQL + f"SELECT total, round(inline, 9) AS inline, round(container, 9) AS container, round(directory, 9) AS directory, round(1 - abs(inline - 0.2), 9) AS efficiency, round((1 - abs(inline - 0.2)) * 100, 6) AS score FROM (SELECT {_SHARES_SQL} FROM records)")
def distribution_simple(spark: SparkSession, d: str) -> DataFrame:
    found, _ = records(spark, d)
    out = A.distribution_simple(found)
    return out.select("total", *[F.round(c, 9).alias(c) for c in ("inline", "container", "directory", "efficiency")], F.round("score", 6).alias("score"))


@register("distribution_adaptive", _RECORDS_SQL + f", m AS (SELECT {_SHARES_SQL}, count(*) FILTER (WHERE n >= 5) AS hot_blocks, count(*) FILTER (WHERE {_COLD}) AS cold_blocks, coalesce(count(*) FILTER (WHERE n >= 5 AND location = 'container') / nullif(count(*) FILTER (WHERE n >= 5), 0), 1) AS h, coalesce(count(*) FILTER (WHERE {_COLD} AND location = 'directory') / nullif(count(*) FILTER (WHERE {_COLD}), 0), 1) AS c FROM records) SELECT total, hot_blocks, cold_blocks, round(h * 0.4 + c * 0.3 + (1 - abs(inline - 0.2)) * 0.3, 9) AS efficiency, round((h * 0.5 + (c * 0.7 + (1 - abs(inline - 0.2)) * 0.3) * 0.5) * 100, 6) AS score FROM m")
def distribution_adaptive(spark: SparkSession, d: str) -> DataFrame:
    found, now = records(spark, d)
    return A.distribution_adaptive(found, now).select("total", "hot_blocks", "cold_blocks", F.round("efficiency", 9).alias("efficiency"), F.round("score", 6).alias("score"))


@register("storage_mode", "SELECT source, CASE WHEN used < 25000 THEN 'container' WHEN used >= 50000 THEN 'directory' WHEN used // n < 512 AND used >= 37500 THEN 'hybrid' ELSE 'container' END AS mode FROM (SELECT source, sum(n_chars)::BIGINT AS used, count(*) AS n FROM documents GROUP BY source)")
def storage_mode(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("used"), F.count("*").alias("n"))
    return per.select("source", A.storage_mode(F.col("used"), F.col("n"), F.lit(0.0), F.lit("container"), 50_000).alias("mode"))


@register("storage_stats", "SELECT count(*) AS blocks, sum(n_chars)::BIGINT AS used, (1000000000000 - sum(n_chars))::BIGINT AS free, 0.0::DOUBLE AS fragmentation FROM documents")
def storage_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.storage_stats(table(spark, d, "documents").select(F.col("n_chars").alias("size")), 1_000_000_000_000)


@register("access_pattern", "SELECT user_id, CASE WHEN r > 0.8 THEN 'read-heavy' WHEN r < 0.2 THEN 'write-heavy' ELSE 'mixed' END AS pattern, round(CASE WHEN r > 0.8 THEN r WHEN r < 0.2 THEN 1 - r ELSE 1.0 END, 9) AS value FROM (SELECT user_id, avg((event_type IN ('view', 'click'))::INT) AS r FROM events GROUP BY user_id)")
def access_pattern(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type").isin("view", "click")).alias("reads"), F.count_if(~F.col("event_type").isin("view", "click")).alias("writes"))
    return per.select("user_id", A.read_write_pattern(F.col("reads"), F.col("writes")).alias("p")).select("user_id", "p.pattern", F.round("p.value", 9).alias("value"))


@register("query_statistics", "SELECT event_type AS query_type, count(*) AS n, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, round(avg(user_id), 6) AS avg_rows, round(avg((value > 50)::INT), 9) AS hit_rate FROM events GROUP BY event_type")
def query_statistics(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_type").alias("query_type"), F.col("value").alias("ms"), F.col("user_id").alias("rows"), (F.col("value") > 50).alias("hit"))
    return A.query_statistics(log).withColumn("avg_ms", F.round("avg_ms", 6)).withColumn("avg_rows", F.round("avg_rows", 6)).withColumn("hit_rate", F.round("hit_rate", 9))


@register("last_values", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_values(spark: SparkSession, d: str) -> DataFrame:
    return A.last_values(table(spark, d, "events"), "user_id", "value", "event_id")


@register("latency_percentiles", "SELECT event_type, l[1 + floor((len(l) - 1) * 50 / 100)::BIGINT] AS p50, l[1 + floor((len(l) - 1) * 95 / 100)::BIGINT] AS p95, l[1 + floor((len(l) - 1) * 99 / 100)::BIGINT] AS p99, l[1] AS p0, l[len(l)] AS p100 FROM (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY event_type)")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return A.latency_percentiles(table(spark, d, "events"), ["event_type"], "value", [0, 50, 95, 99, 100])


@register("latency_sliding", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS least, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS greatest FROM events")
def latency_sliding(spark: SparkSession, d: str) -> DataFrame:
    return A.sliding_mean(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("mean", 9).alias("mean"), "least", "greatest")


@register("hit_rate", "SELECT user_id, round(avg((event_type = 'click')::INT), 9) AS rate FROM events GROUP BY user_id")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(A.hit_rate(F.col("event_type") == "click"), 9).alias("rate"))


@register("lru_evict", _RECORDS_SQL + "SELECT block_key FROM (SELECT block_key, coalesce(sum(size) OVER (ORDER BY last, block_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM records) WHERE before < 20000")
def lru_evict(spark: SparkSession, d: str) -> DataFrame:
    found, _ = records(spark, d)
    return A.evicted(found, 20_000, ["last", "block_key"]).select("block_key")


@register("lru_keep", _RECORDS_SQL + "SELECT block_key FROM records ORDER BY last DESC, block_key LIMIT 40")
def lru_keep(spark: SparkSession, d: str) -> DataFrame:
    found, _ = records(spark, d)
    return A.kept_by_lru(found, 40, "last", "block_key").select("block_key")


@register("byte_sizes", "SELECT doc_id AS id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN format('{:.1f} KB', s / 1024.0) ELSE format('{:.1f} MB', s / 1048576.0) END AS size FROM (SELECT doc_id, n_chars * 17 AS s FROM documents)")
def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.byte_size(F.col("n_chars") * 17).alias("size"))


# --- access rules --------------------------------------------------------------------------------------------------

_RESOURCES_SQL = "requests AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 4 WHEN 0 THEN 'ann' WHEN 1 THEN 'bob' WHEN 2 THEN 'eve' ELSE 'joe' END AS subject, '/' || r_name || '/' || n_name || '/' || s_suppkey AS resource, CASE WHEN s_suppkey % 3 = 0 THEN 'write' ELSE 'read' END AS operation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_ACL = [("ann", "/EUROPE", "*", "allow"), ("bob", "/ASIA/*", "read", "allow"), ("*", "/AMERICA/*", "read", "allow"), ("eve", "*", "*", "allow"), ("eve", "/AFRICA", "write", "deny"), ("*", "/ASIA/CHINA", "*", "deny")]
_PARENTS = [("admin", "editor"), ("editor", "viewer"), ("viewer", "guest"), ("guest", "admin"), ("auditor", "viewer"), ("ghost", "none")]
_ASSIGNED = [("ann", "viewer"), ("bob", "admin"), ("joe", "auditor"), ("joe", "ghost")]
_PERMISSIONS = [("guest", "/AMERICA", ["read"]), ("viewer", "/EUROPE/*", ["read"]), ("editor", "/ASIA/*", ["read", "write"]), ("admin", "", ["*"])]
_values = lambda rows: ", ".join("(" + ", ".join("[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else f"'{v}'" for v in r) + ")" for r in rows)
_MATCH = "({p} = resource OR {p} = '*' OR ({p} LIKE '%/*' AND starts_with(resource, left({p}, length({p}) - 1))) OR starts_with(resource, {p} || '/'))"
_SEC_SQL = f"WITH RECURSIVE {_RESOURCES_SQL}, acl(subject_id, pattern, op, effect) AS (VALUES {_values(_ACL)}), parents(role, parent) AS (VALUES {_values(_PARENTS)}), assigned(subject, role) AS (VALUES {_values(_ASSIGNED)}), permissions(role, pattern, ops) AS (VALUES {_values(_PERMISSIONS)}), effective(subject, role) AS (SELECT subject, role FROM assigned UNION SELECT e.subject, p.parent FROM effective e JOIN parents p USING (role)), a AS (SELECT request_id, coalesce(bool_or(effect = 'deny'), false) AS denied, coalesce(bool_or(effect = 'allow'), false) AS allow FROM requests LEFT JOIN acl ON (subject_id = subject OR subject_id = '*') AND (op = operation OR op = '*') AND {_MATCH.format(p='pattern')} GROUP BY request_id), b AS (SELECT request_id, count(pattern) > 0 AS allowed FROM requests r LEFT JOIN (effective JOIN permissions USING (role)) p ON p.subject = r.subject AND (pattern = '' OR {_MATCH.format(p='pattern')}) AND (list_contains(ops, operation) OR list_contains(ops, '*')) GROUP BY request_id) "


def requests(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    subject = F.element_at(F.array(*[F.lit(x) for x in ("ann", "bob", "eve", "joe")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return joined.select(F.col("s_suppkey").alias("request_id"), subject.alias("subject"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), F.col("s_suppkey").cast("string")).alias("resource"), F.when(F.col("s_suppkey") % 3 == 0, "write").otherwise("read").alias("operation"))


def rules(spark: SparkSession) -> dict[str, DataFrame]:
    acl = spark.createDataFrame([(*r, None) for r in _ACL], "subject_id string, resource_id string, operation string, effect string, expires_at timestamp")
    assigned, parents = spark.createDataFrame(_ASSIGNED, "subject string, role string"), spark.createDataFrame(_PARENTS, "role string, parent string")
    return {"acl": acl, "assigned": assigned, "parents": parents, "permissions": spark.createDataFrame(_PERMISSIONS, "role string, resource_pattern string, operations array<string>")}


@register("acl_check", _SEC_SQL + "SELECT request_id, allow AND NOT denied AS allowed, denied FROM a")
def acl_check(spark: SparkSession, d: str) -> DataFrame:
    return SEC.acl_check(requests(spark, d), rules(spark)["acl"], F.lit("2024-01-01").cast("timestamp"))


@register("rbac_roles", _SEC_SQL + "SELECT subject, role FROM effective")
def rbac_roles(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark)
    return SEC.effective_roles(r["assigned"], r["parents"])


@register("rbac_check", _SEC_SQL + "SELECT request_id, allowed FROM b")
def rbac_check(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark)
    return SEC.rbac_check(requests(spark, d), SEC.effective_roles(r["assigned"], r["parents"]), r["permissions"])


@register("access_combined", _SEC_SQL + "SELECT request_id, (allow AND NOT denied) OR (allowed AND NOT denied) AS allowed FROM a JOIN b USING (request_id)")
def access_combined(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark)
    return SEC.access(requests(spark, d), r["acl"], SEC.effective_roles(r["assigned"], r["parents"]), r["permissions"], F.lit("2024-01-01").cast("timestamp"))


# --- file tree -----------------------------------------------------------------------------------------------------

_TREE_SQL = "WITH entries AS (SELECT '/' || r_name AS path, true AS is_dir, 0::BIGINT AS size FROM region UNION ALL SELECT '/' || r_name || '/' || n_name, true, 0 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '/' || r_name || '/' || n_name || '/' || s_suppkey, false, s_suppkey * 100 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "


def tree(spark: SparkSession, d: str) -> DataFrame:
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    folders = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
    files = table(spark, d, "supplier").join(folders, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("path", F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"), F.lit(False).alias("is_dir"), (F.col("s_suppkey") * 100).alias("size"))
    top = region.select(F.concat(F.lit("/"), "r_name").alias("path"), F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size"))
    return top.unionByName(folders.select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size"))).unionByName(files)


@register("fs_children", _TREE_SQL + "SELECT path, is_dir, size FROM entries WHERE regexp_replace(path, '/[^/]*$', '') = '/EUROPE'")
def fs_children(spark: SparkSession, d: str) -> DataFrame:
    return FS.children(tree(spark, d), "/EUROPE")


@register("fs_move", _TREE_SQL + "SELECT CASE WHEN path = '/ASIA' OR starts_with(path, '/ASIA/') THEN '/EAST' || substr(path, 6) ELSE path END AS path, is_dir, size FROM entries")
def fs_move(spark: SparkSession, d: str) -> DataFrame:
    return FS.moved(tree(spark, d), "/ASIA", "/EAST")


@register("fs_attributes", _TREE_SQL + "SELECT path, ceil(size / 512)::BIGINT AS blocks FROM entries")
def fs_attributes(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).select("path", X.disk_blocks(F.col("size")).alias("blocks"))


@register("url_parents", "SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS parent FROM pages")
def url_parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.parent_path(F.col("url")).alias("parent"))


# --- windows over events, and the relational surface ---------------------------------------------------------------


@register("tumbling_window", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.tumbling(events, "1 hour", "10 minutes").select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@register("session_window", "SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '2 hours' THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s")
def session_window(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.sessions(events, "2 hours", "10 minutes").select("user_id", F.unix_micros("start").alias("start"), "n")


@register("join_aggregate", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_aggregate(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@register("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("top_per_group", "SELECT c_mktsegment, c_custkey, rank FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("c_mktsegment", "c_custkey", F.col("rank").cast("bigint").alias("rank"))


@register("outer_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def outer_join(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@register("as_of_join", "SELECT p.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS last_click FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND (c.ts, c.event_id) < (p.ts, p.event_id) WHERE p.event_type = 'purchase' GROUP BY p.event_id")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """The last click before each purchase of a user: one window, no range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    events = table(spark, d, "events").where("event_type in ('purchase', 'click')")
    return events.withColumn("last_click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "last_click")
