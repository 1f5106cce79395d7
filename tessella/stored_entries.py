"""More registered queries: what is written, read back and compared, options of tokenizers and search, encryption,
streams and configuration. Each has its SQL."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import entries as E
from tessella.config import Config
from tessella.entries import TAGS_SQL, corpus, index, metadata, register, table, tags
from tessella.functions import crypto, tlv
from tessella.functions import expressions as X
from tessella.functions import tokenizers as K
from tessella.operators import blocks as B
from tessella.operators import security as SEC
from tessella.operators.fulltext import FullTextIndex, SearchOptions
from tessella.operators.tag_index import TagIndex
from tessella.plans.engine import Engine
from tessella.scratch import scratch_path
from tessella.sources import stores
from tessella.streaming import ingest

# --- indexes on disk -----------------------------------------------------------------------------------------------


@register("index_save_load", TAGS_SQL + "SELECT DISTINCT tag, id FROM tags")
def index_save_load(spark: SparkSession, d: str) -> DataFrame:
    """Saved by shard with a checksum of its content, loaded and checked."""
    path = scratch_path(spark, "index")
    index(spark, d).save(path)
    return TagIndex.load(spark, path).tags


@register("index_load_find", TAGS_SQL + "SELECT DISTINCT id FROM tags WHERE tag = 1001 AND id % 16 = 3")
def index_load_find(spark: SparkSession, d: str) -> DataFrame:
    """A look-up over stored shards: one folder is read."""
    path = scratch_path(spark, "index")
    index(spark, d).save(path)
    return spark.read.parquet(f"{path}/postings").where("shard = 3 and tag = 1001").select("id")


@register("index_rebalanced", TAGS_SQL + "SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def index_rebalanced(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).rebalanced(5).tags.groupBy("tag").agg(F.count("*").alias("n"))


@functools.cache
def _saved_corpus(app: str, spark: SparkSession, d: str) -> str:
    path = scratch_path(spark, "corpus")
    corpus(spark, d).save(path)
    return path


def saved_corpus(spark: SparkSession, d: str) -> FullTextIndex:
    """Saved once an application, as an index is, and then searched."""
    return FullTextIndex.load(spark, _saved_corpus(spark.sparkContext.applicationId, spark, d))


@register("search_saved_postings", E._search_sql("'erer', 'tion'", E._LOG, 0.005, "SELECT id, round(score, 9) AS score FROM scores"))
def search_saved_postings(spark: SparkSession, d: str) -> DataFrame:
    return saved_corpus(spark, d).scores("erer tion", SearchOptions(threshold=0.005)).select("id", F.round("score", 9).alias("score"))


_POSTINGS = "SELECT term, id, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ' ') AS positions, any_value(length)::BIGINT AS length FROM (SELECT id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos, len(terms) AS length FROM docs) GROUP BY term, id"


@register("postings_positions", E._SIMPLE_SQL + _POSTINGS)
def postings_positions(spark: SparkSession, d: str) -> DataFrame:
    p = corpus(spark, d).postings()
    return p.select("term", "id", F.col("tf").cast("bigint").alias("tf"), F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), F.col("length").cast("bigint").alias("length"))


@register("fulltext_upsert", E._SIMPLE_SQL + "SELECT term, count(DISTINCT id) AS df FROM (SELECT id, term FROM tokens WHERE id % 3 <> 0 UNION ALL SELECT id, unnest(['fresh', 'words']) FROM docs WHERE id % 3 = 0) GROUP BY term")
def fulltext_upsert(spark: SparkSession, d: str) -> DataFrame:
    i = corpus(spark, d)
    new = i.docs.where("id % 3 = 0").select("id", F.lit("Fresh, words").alias("content"))
    return i.upsert(new).document_frequency()


@register("fulltext_remove", E._SIMPLE_SQL + "SELECT term, count(DISTINCT id) AS df FROM tokens WHERE id % 2 = 1 GROUP BY term")
def fulltext_remove(spark: SparkSession, d: str) -> DataFrame:
    i = corpus(spark, d)
    return i.remove(i.docs.where("id % 2 = 0").select("id")).document_frequency()


@register("search_highlight", "SELECT doc_id AS id, md5(regexp_replace(regexp_replace(text, '([^\\p{L}\\p{N}]|^)(erer|tion)($|[^\\p{L}\\p{N}])', '\\1<em>\\2</em>\\3', 'gi'), '([^\\p{L}\\p{N}]|^)(erer|tion)($|[^\\p{L}\\p{N}])', '\\1<em>\\2</em>\\3', 'gi')) <> md5(text) AS marked FROM documents")
def search_highlight(spark: SparkSession, d: str) -> DataFrame:
    marked = corpus(spark, d).highlight("erer tion").withColumnRenamed("content", "new")
    return marked.select("id", F.col("new").contains("<em>").alias("marked"))


@register("search_fuzzy", E._SIMPLE_SQL + ", near AS (SELECT id, length, count(*) AS tf FROM tokens WHERE term = 'tionth' OR 1 - levenshtein(term, 'tionth') / greatest(length(term), 6) >= 0.8 GROUP BY id, length) SELECT id, round(tf / length * 2.0, 9) AS score FROM near WHERE tf / length * 2.0 >= 0.001")
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    found = corpus(spark, d).scores("tionth", SearchOptions(threshold=0.001, idf="constant", fuzzy=0.8))
    return found.select("id", F.round("score", 9).alias("score"))


@register("search_ascending", E._search_sql("'erer', 'tion'", E._LOG, 0.0, "SELECT id, round(score, 9) AS score FROM scores ORDER BY scores.score, id LIMIT 15"))
def search_ascending(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).search("erer tion", SearchOptions(threshold=0.0, limit=15, ascending=True)).select("id", F.round("score", 9).alias("score"))


# --- tokenizer options ---------------------------------------------------------------------------------------------


def _digest(tokenizer: K.Tokenizer):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = tokenizer.terms(F.col("text"))
        return table(spark, d, "documents").select(F.col("doc_id").alias("id"), t.alias("t")).select("id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))

    return run


def _terms_sql(pattern: str, keep: str, lower: bool = True) -> str:
    term = "lower(t)" if lower else "t"
    return f"SELECT id, len(terms) AS n, md5(array_to_string(terms, ' ')) AS digest FROM (SELECT doc_id AS id, list_filter(list_transform(regexp_extract_all(text, '{pattern}'), lambda t: {term}), lambda t: {keep}) AS terms FROM documents)"


_RUNS = "\\p{L}+|\\p{N}+"
_EN = f"t NOT IN ({E._EN_STOPS})"
register("tokenize_case_sensitive", _terms_sql(_RUNS, _EN, lower=False))(_digest(K.Tokenizer("unicode", K.ENGLISH, case_sensitive=True)))
register("tokenize_without_numbers", _terms_sql(_RUNS, _EN + " AND NOT regexp_full_match(t, '\\p{N}+')"))(_digest(K.Tokenizer("unicode", K.ENGLISH, numbers=False)))
register("tokenize_punctuation", _terms_sql("""\\p{L}+|\\p{N}+|[.,!?;:''"()\\[\\]{}]""", _EN))(_digest(K.Tokenizer("unicode", K.ENGLISH, punctuation=True)))
register("tokenize_chinese", _terms_sql("\\p{Han}|\\p{Nd}+|[^\\s\\p{P}\\p{S}\\p{Nd}\\p{Han}]+", f"t NOT IN ({E._STOPS})"))(_digest(K.CHINESE_CHARS))
register("tokenize_stop_words", _terms_sql(_RUNS, f"t NOT IN ({', '.join(repr(w) for w in sorted((K.ENGLISH | {'tion', 'erer'}) - {'the', 'and'}))})"))(_digest(K.UNICODE.with_stop_words(["tion", "erer"], ["the", "and"])))

# --- predicates ----------------------------------------------------------------------------------------------------

@register("deleted_hidden", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
def deleted_hidden(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("deleted", F.col("o_orderstatus") == "F")
    return Engine(orders, id_col="o_orderkey").query("o_totalprice > 100000.0").df


@register("explain_tree", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 200000")
def explain_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree as JSON has the fields of the query; the same engine then runs it from its cache."""
    engine = Engine(table(spark, d, "orders"), id_col="o_orderkey")
    if "o_totalprice" not in engine.explain("o_totalprice > 200000.0"):
        raise AssertionError("the tree lacks the field")
    return engine.cached("o_totalprice > 200000.0")


# --- metadata and codecs -------------------------------------------------------------------------------------------


@register("metadata_set", E._META_SQL + "SELECT file_id, tag, CASE WHEN tag = 4097 AND file_id::BIGINT % 2 = 0 THEN 'NEW' ELSE decode(value) END AS value FROM metadata WHERE tag = 4097")
def metadata_set(spark: SparkSession, d: str) -> DataFrame:
    m = metadata(spark, d)
    new = m.rows.where("tag = 4097 and cast(file_id as bigint) % 2 = 0").select("file_id", "tag", F.lit("NEW").cast("binary").alias("value"))
    return m.set(new).rows.where("tag = 4097").select("file_id", "tag", F.col("value").cast("string").alias("value"))


@register("metadata_delete", E._META_SQL + "SELECT file_id, tag FROM metadata WHERE NOT (file_id = '7' AND tag = 4097)")
def metadata_delete(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).delete("7", 4097).rows.select("file_id", "tag")


@register("metadata_entries", E._META_SQL + "SELECT tag, decode(value) AS value FROM metadata WHERE file_id = '7' AND tag = 4097")
def metadata_entries(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).get("7", 4097).select(F.lit(4097).alias("tag"), F.col("value").cast("string").alias("value"))


@register("tlv_text", "SELECT p_partkey AS id, p_name AS value FROM part")
def tlv_text(spark: SparkSession, d: str) -> DataFrame:
    """Columns of text as TLV items and back."""
    decoded = tlv.to_json(tlv.from_text(F.col("p_name")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get_json_object(F.concat(F.lit('{"v":'), decoded, F.lit("}")), "$.v").alias("value"))


@register("tlv_values", "SELECT n_nationkey AS id, '[' || n_nationkey || ', -3, true, 2.5, {\"k\": [1, 2]}]' AS value FROM nation")
def tlv_values(spark: SparkSession, d: str) -> DataFrame:
    """Integers, floats, booleans, arrays and maps, nested: encoded item by item, decoded by the column function."""
    keys = [r[0] for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 rows at any scale
    rows = [(k, bytearray(tlv.encode([k, -3, True, 2.5, {"k": [1, 2]}]))) for k in keys]
    return spark.createDataFrame(rows, "id bigint, data binary").select(F.col("id").cast("int").alias("id") if dict(table(spark, d, "nation").dtypes)["n_nationkey"] == "int" else "id", tlv.to_json(F.col("data")).alias("value"))


@register("read_ranges", "SELECT p_partkey AS id, substr(p_name, 3, 4) AS part, left(p_name, 5) AS head FROM part")
def read_ranges(spark: SparkSession, d: str) -> DataFrame:
    data = F.col("p_name").cast("binary")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.read_range(data, 2, 4).cast("string").alias("part"), X.truncated(data, 5).cast("string").alias("head"))


# --- blocks and stores ---------------------------------------------------------------------------------------------


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "part").select("p_partkey", F.col("p_name").cast("binary").alias("data"))
    return B.written(data, ["p_partkey"]).drop("p_partkey")


_BLOCKS_SQL = "WITH blocks AS (SELECT row_number() OVER (ORDER BY p_partkey) AS block_id, octet_length(encode(p_name)) AS size, md5(p_name) AS checksum, p_name FROM part) "


@register("read_block", _BLOCKS_SQL + "SELECT block_id, size, checksum FROM blocks WHERE block_id = 17")
def read_block(spark: SparkSession, d: str) -> DataFrame:
    return B.read(_blocks(spark, d), 17).select("block_id", "size", "checksum")


@register("link_delete_blocks", _BLOCKS_SQL + "SELECT block_id, CASE block_id WHEN 5 THEN 9 ELSE 0 END::BIGINT AS next, CASE block_id WHEN 9 THEN 5 ELSE 0 END::BIGINT AS prev FROM blocks WHERE block_id <> 7")
def link_delete_blocks(spark: SparkSession, d: str) -> DataFrame:
    """5 to 7 to 9 linked, then 7 deleted: its neighbours are joined."""
    rows = B.linked(B.linked(_blocks(spark, d), 5, 7), 7, 9)
    return B.deleted(rows, 7).select("block_id", "next", "prev")


@register("corrupted_blocks", _BLOCKS_SQL + "SELECT block_id FROM blocks WHERE block_id % 10 = 0")
def corrupted_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _blocks(spark, d)
    return B.corrupted(rows.withColumn("data", F.when(F.col("block_id") % 10 == 0, F.concat("data", F.lit(b"!"))).otherwise(F.col("data"))))


def _store(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = scratch_path(spark, "store")
        stores.write(_blocks(spark, d), path, mode)
        return stores.read(spark, path, mode).select("block_id", "size", F.md5("data").alias("checksum"))

    return run


for _mode in ("container", "directory", "hybrid"):
    register(f"store_{_mode}", _BLOCKS_SQL + "SELECT block_id, size, checksum FROM blocks")(_store(_mode))


@register("store_converted", _BLOCKS_SQL + "SELECT block_id, size, checksum FROM blocks")
def store_converted(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "store")
    stores.write(_blocks(spark, d), path, "container")
    stores.convert(spark, path, "container", "hybrid")
    stores.convert(spark, path, "hybrid", "directory")
    return stores.read(spark, path, "directory").select("block_id", "size", F.md5("data").alias("checksum"))


@register("store_upsert", _BLOCKS_SQL + "SELECT block_id, CASE WHEN block_id % 4 = 0 THEN md5('new') ELSE checksum END AS checksum FROM blocks")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    path, to = scratch_path(spark, "store"), scratch_path(spark, "store")
    rows = _blocks(spark, d)
    stores.write(rows, path, "directory")
    new = rows.where("block_id % 4 = 0").withColumn("data", F.lit(b"new"))
    stores.upsert(spark, path, "directory", new, to)
    return stores.read(spark, to, "directory").select("block_id", F.md5("data").alias("checksum"))


@register("store_block", _BLOCKS_SQL + "SELECT block_id, checksum FROM blocks WHERE block_id = 33")
def store_block(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "store")
    stores.write(_blocks(spark, d), path, "directory")
    return stores.block(spark, path, "directory", 33).select("block_id", F.md5("data").alias("checksum"))


@register("related_blocks", "WITH e AS (SELECT conv_id * 1000 + turn AS id, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT id, next AS related, 'next' AS relation FROM e WHERE next IS NOT NULL UNION ALL SELECT next, id, 'prev' FROM e WHERE next IS NOT NULL")
def related_blocks(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    edges = turns.withColumn("next", F.lead("id").over(E.Window.partitionBy("conv_id").orderBy("id"))).where("next is not null")
    return edges.select("id", F.col("next").alias("related"), F.lit("next").alias("relation")).unionByName(edges.select(F.col("next").alias("id"), F.col("id").alias("related"), F.lit("prev").alias("relation")))


@register("content_index", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_index(spark: SparkSession, d: str) -> DataFrame:
    """Content to the ids that hold it, by digest."""
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


# --- encryption ----------------------------------------------------------------------------------------------------


def _key(name: str) -> crypto.Key:
    store = crypto.KeyStore()
    return store.import_key(name, hashlib.sha256(name.encode()).digest())


@register("encrypt_decrypt_blocks", _BLOCKS_SQL + "SELECT block_id, checksum, true AS hidden FROM blocks")
def encrypt_decrypt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """AES-GCM bound to the block id: what is written differs from the data, what is read back doesn't."""
    key, path = _key("blocks"), scratch_path(spark, "encrypted")
    plain = _blocks(spark, d)
    crypto.encrypt_blocks(plain, key).write.parquet(path)
    kept = spark.read.parquet(path)
    hidden = kept.select("block_id", (F.md5("data") != F.col("checksum")).alias("hidden"))
    return crypto.decrypt_blocks(kept, key).select("block_id", F.md5("data").alias("checksum")).join(hidden, "block_id")


@register("decrypt_wrong_block", _BLOCKS_SQL + "SELECT block_id, false AS readable FROM blocks")
def decrypt_wrong_block(spark: SparkSession, d: str) -> DataFrame:
    """A ciphertext moved to another block can't be read there."""
    key = _key("blocks")
    moved = crypto.encrypt_blocks(_blocks(spark, d), key).withColumn("block_id", F.col("block_id") + 1)
    opened = crypto.decrypt(F.col("data"), key.material, crypto.block_aad(F.col("block_id")), strict=False)
    return moved.select((F.col("block_id") - 1).alias("block_id"), opened.isNotNull().alias("readable"))


@register("encrypt_named_key", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def encrypt_named_key(spark: SparkSession, d: str) -> DataFrame:
    store = crypto.KeyStore()
    store.import_key("one", bytes(range(32)))
    key = store.rotate("one")
    sealed = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), crypto.encrypt(F.col("s_name").cast("binary"), key.material).alias("data"))
    return sealed.select("id", crypto.decrypt(F.col("data"), key.material).cast("string").alias("name"))


@register("hmac_verify", "SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS valid FROM supplier")
def hmac_verify(spark: SparkSession, d: str) -> DataFrame:
    key = b"a key for signatures"
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").cast("binary").alias("data"))
    signed = rows.withColumn("sign", crypto.hmac_sign(F.col("data"), key, "sha512"))
    forged = signed.withColumn("data", F.when(F.col("id") % 2 == 0, F.col("data")).otherwise(F.concat("data", F.lit(b"x"))))
    return forged.select("id", crypto.hmac_verify(F.col("data"), F.col("sign"), key, "sha512").alias("valid"))


@register("crypto_algorithms", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', {b}, {str(i).lower()})" for n, k, b, i in crypto.ALGORITHMS) + ") t(name, kind, bits, implemented)")
def crypto_algorithms(spark: SparkSession, d: str) -> DataFrame:
    return crypto.algorithms(spark)


# --- access rules over driver tables -------------------------------------------------------------------------------

_RULES_SQL = "WITH requests AS (SELECT o_orderkey AS request_id, o_custkey % 50 AS subject, '/' || o_orderstatus || '/' || (o_orderkey % 100) AS resource, CASE WHEN o_orderkey % 3 = 0 THEN 'write' ELSE 'read' END AS operation, o_orderpriority AS kind FROM orders), rules AS (SELECT c_custkey % 50 AS subject, '/' || CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'O' END AS pattern, CASE WHEN c_nationkey % 3 = 0 THEN '*' ELSE 'read' END AS op, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN 'deny' ELSE 'allow' END AS effect, CASE WHEN c_nationkey % 5 = 0 THEN '*' ELSE '1-URGENT' END AS kind FROM customer) "


@register("acl_attributes", _RULES_SQL + "SELECT q.request_id, coalesce(bool_or(r.effect = 'allow') AND NOT bool_or(r.effect = 'deny'), false) AS allowed, coalesce(bool_or(r.effect = 'deny'), false) AS denied FROM requests q LEFT JOIN (SELECT DISTINCT * FROM rules) r ON r.subject = q.subject AND starts_with(q.resource, r.pattern || '/') AND r.op IN ('*', q.operation) AND r.kind IN ('*', q.kind) GROUP BY q.request_id")
def acl_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Rules made of customers, requests of orders; types are matched beside subject, path and operation."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    asked = orders.select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_custkey") % 50).cast("string").alias("subject"),
        F.concat(F.lit("/"), "o_orderstatus", F.lit("/"), (F.col("o_orderkey") % 100).cast("string")).alias("resource"),
        F.when(F.col("o_orderkey") % 3 == 0, "write").otherwise("read").alias("operation"),
        F.col("o_orderpriority").alias("resource_type"),
    )
    rules = customer.select(
        (F.col("c_custkey") % 50).cast("string").alias("subject_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "/F/*").otherwise("/O/*").alias("resource_id"),
        F.when(F.col("c_nationkey") % 3 == 0, "*").otherwise("read").alias("operation"),
        F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 3), "deny").otherwise("allow").alias("effect"),
        F.lit(None).cast("timestamp").alias("expires_at"),
        F.when(F.col("c_nationkey") % 5 == 0, "*").otherwise("1-URGENT").alias("resource_type"),
    ).distinct()
    return SEC.acl_check(asked, rules, F.lit("2024-01-01").cast("timestamp"))


@register("acl_changes", "SELECT s_suppkey::VARCHAR AS subject_id, CASE WHEN s_suppkey % 5 = 0 THEN 'deny' ELSE 'allow' END AS effect FROM supplier WHERE s_suppkey % 7 <> 0")
def acl_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rules added, repeated ones dropped, some updated, some removed."""
    s = table(spark, d, "supplier")
    rule = lambda df, effect="allow": df.select(F.col("s_suppkey").cast("string").alias("subject_id"), F.lit("/x/*").alias("resource_id"), F.lit("read").alias("operation"), F.lit(effect).alias("effect"), F.lit(None).cast("timestamp").alias("expires_at"))
    acl = SEC.add_entries(rule(s.where("s_suppkey % 2 = 0")), rule(s))
    acl = SEC.update_entries(acl, rule(s.where("s_suppkey % 5 = 0"), "deny").select("subject_id", "resource_id", "operation", "effect"))
    gone = rule(s.where("s_suppkey % 7 = 0")).select("subject_id", "resource_id", "operation")
    return SEC.remove_entries(acl, gone).select("subject_id", "effect")


@register("rbac_assign", "SELECT c_custkey AS subject, 'role' || c_nationkey AS role FROM customer UNION SELECT c_custkey, 'role0' FROM customer WHERE c_custkey % 10 = 0")
def rbac_assign(spark: SparkSession, d: str) -> DataFrame:
    roles = table(spark, d, "nation").select(F.concat(F.lit("role"), F.col("n_nationkey").cast("string")).alias("role"))
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.concat(F.lit("role"), F.col("c_nationkey").cast("string")).alias("role"))
    new = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("subject"), F.lit("role0").alias("role"))
    return SEC.assign(held, roles, new)


# --- streams -------------------------------------------------------------------------------------------------------


def _changes(spark: SparkSession, d: str, streaming: bool) -> DataFrame:
    events = table(spark, d, "events")
    source = events.select((F.col("user_id") % 7).cast("bigint").alias("tag"), F.col("user_id").cast("bigint").alias("id"), F.col("event_id").cast("bigint").alias("seq"), F.when(F.col("event_type") == "click", "remove").otherwise("add").alias("op"), F.col("ts").cast("timestamp").alias("ts"))
    if not streaming:
        return source
    path = scratch_path(spark, "changes")
    source.repartition(4).write.parquet(path)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(path)


@register("stream_index", "SELECT user_id % 7 AS tag, user_id::BIGINT AS id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """Adds and removes as a stream of files, kept up by micro-batches; the last operation of a posting counts."""
    path = scratch_path(spark, "index")
    ingest.maintain_index(_changes(spark, d, True), path, scratch_path(spark, "checkpoint")).awaitTermination()
    return ingest.current_index(spark, path).select(F.col("tag"), "id")


@register("stream_index_compacted", "SELECT user_id % 7 AS tag, user_id::BIGINT AS id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
def stream_index_compacted(spark: SparkSession, d: str) -> DataFrame:
    path, to = scratch_path(spark, "index"), scratch_path(spark, "index")
    ingest.maintain_index(_changes(spark, d, True), path, scratch_path(spark, "checkpoint")).awaitTermination()
    ingest.compact_index(spark, path, to)
    return ingest.current_index(spark, to).select("tag", "id")


@register("stream_idempotent_adds", "SELECT DISTINCT user_id % 7 AS tag, user_id::BIGINT AS id FROM events")
def stream_idempotent_adds(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "adds")
    adds = ingest.distinct_postings(_changes(spark, d, True), "ts", "3650 days").select("tag", "id")
    adds.writeStream.option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start(path, format="parquet", outputMode="append").awaitTermination()
    return spark.read.parquet(path)


@register("access_tracker", "SELECT user_id::VARCHAR AS block_key, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events GROUP BY user_id")
def access_tracker(spark: SparkSession, d: str) -> DataFrame:
    tracked = ingest.tracked_access(table(spark, d, "events").select(F.col("user_id").cast("string").alias("block_key"), "ts"))
    return tracked.select("block_key", "n", F.unix_micros(F.col("first").cast("timestamp")).alias("first"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"))


# --- configuration -------------------------------------------------------------------------------------------------


@register("config_save_load", "SELECT 'same' AS state")
def config_save_load(spark: SparkSession, d: str) -> DataFrame:
    """A configuration saved as JSON and loaded has no difference from the one it was."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # a file of the driver's own, as configuration is
        Config().save(f"{folder}/config.json")
        diff = Config.load(f"{folder}/config.json").diff(Config())
    return spark.createDataFrame([("changed" if diff else "same",)], "state string")


@register("fs_write_checks", E._TREE_SQL + "SELECT path, count(*) AS n FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS path FROM entries) WHERE path <> '' GROUP BY path")
def fs_write_checks(spark: SparkSession, d: str) -> DataFrame:
    """Children of every folder by one aggregation over the parents of paths."""
    entries = E.tree(spark, d)
    return entries.groupBy(X.parent_path(F.col("path")).alias("path")).agg(F.count("*").alias("n")).where("path not in ('', '/')")


@register("tags_by_priority", TAGS_SQL + "SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 5")
def tags_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return tags(spark, d).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(5)
