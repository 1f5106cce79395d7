from __future__ import annotations

import math
import random
import struct
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessella import errors as E
from tessella.config import Config, Index, Manager, Storage
from tessella.functions import crypto as C
from tessella.functions import expressions as X
from tessella.functions import tlv
from tessella.functions.tokenizers import CHINESE_CHARS, SIMPLE, UNICODE, Tokenizer
from tessella.operators import analytics as A
from tessella.operators import blocks as B
from tessella.operators import filesystem as FS
from tessella.operators import metadata as M
from tessella.operators import security as SEC
from tessella.sources import container, stores
from tessella.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("tokenizer", "text", "terms"),
    [
        (UNICODE, "Hello world, this is a test.", ["hello", "world", "this", "test"]),
        (UNICODE, "Hello 世界, this is a test.", ["hello", "世界", "this", "test"]),
        (UNICODE, "Test123 numbers456", ["test", "123", "numbers", "456"]),
        (UNICODE, "the cat is on the mat", ["cat", "mat"]),
        (UNICODE, "", []),
        (Tokenizer("unicode", case_sensitive=True), "Hello HELLO hello", ["Hello", "HELLO", "hello"]),
        (Tokenizer("unicode", punctuation=True), "Hello, world!", ["hello", ",", "world", "!"]),
        (Tokenizer("unicode", numbers=False), "a1 22 b", ["b"]),
        (UNICODE.with_stop_words(add=("custom", "stop", "word")), "this is a custom stop word test", ["this", "test"]),
        (SIMPLE, "«E-mail»  (the)\tcat's… ", ["e-mail", "cat's"]),
        (CHINESE_CHARS, "我爱北京2024 test", ["爱", "北", "京", "2024", "test"]),
    ],
)
def test_tokenizers(spark, tokenizer, text, terms):
    assert value(spark, tokenizer.terms(F.lit(text))) == terms


def test_token_positions(spark):
    assert [(t.term, t.pos) for t in value(spark, SIMPLE.tokens(F.lit("the cat and dog")))] == [("cat", 0), ("dog", 1)]
    assert [(t.term, t.pos) for t in value(spark, CHINESE_CHARS.tokens(F.lit("我爱你家")))] == [("爱", 1), ("家", 3)]


@pytest.mark.parametrize(
    ("x", "kind"),
    [(127, 1), (-128, 1), (128, 3), (-32768, 3), (32768, 5), (-(2**31), 5), (2**31, 7), (-(2**63), 7), (tlv.Unsigned(255), 2), (tlv.Unsigned(65535), 4), (tlv.Unsigned(2**32 - 1), 6), (tlv.Unsigned(2**64 - 1), 8), (0.5, 9), (3.141592653589793, 10), ("日本", 11), (b"\x00", 12), (True, 13), ([], 14), ([1, "text", True, 3.14159], 14), ([[1, 2], [3]], 14), ({}, 15), ({"a": [1], "b": {"c": None}}, 15), (None, 0)],
)
def test_tlv_round_trip(x, kind):
    data = tlv.encode(x)
    assert data[0] == kind and tlv.decode(data) == x


def test_tlv_lengths_and_errors(spark):
    for n, head in ((100, 0), (1000, 1), (100_000, 2)):
        data = tlv.encode("x" * n)
        assert data[1] == head and tlv.decode(data) == "x" * n
        assert bytes(value(spark, tlv.from_text(F.lit("x" * n)))) == data
    for bad in (b"\x0b", b"\x0b\x00\x05ab", b"\x63\x00\x00", b"\x01\x00\x02ab", tlv.encode(1) * 2, b"\x0f\x00\x03\x01\x00\x00"):
        with pytest.raises(E.TlvError):
            tlv.decode(bad)
    with pytest.raises(E.TlvError):
        tlv.encode({1: 2})
    with pytest.raises(E.TlvError):
        tlv.encode(2**70)
    assert value(spark, tlv.to_json(F.lit(tlv.encode({"a": [1, None, "é"]})))) == '{"a": [1, null, "é"]}' and value(spark, tlv.to_json(F.lit(b"\x63\x00\x00"))) is None


def test_byte_codecs(spark):
    r = random.Random(1)
    for n in [0, -1, 2**63 - 1, -(2**63), *(r.randint(-(2**63), 2**63 - 1) for _ in range(5))]:
        assert value(spark, X.int64_be(F.lit(n.to_bytes(8, "big", signed=True) + b"x"))) == n
        assert bytes(value(spark, X.encode_int64_be(F.lit(n)))) == n.to_bytes(8, "big", signed=True)
    assert value(spark, X.int64_be(F.lit(b"1234567"))) == 0
    for f in (0.0, 1.0, -2.5, 3.141592653589793, 1e300, -1e-300, 5e-324, math.inf):
        assert value(spark, X.float64_be(F.lit(struct.pack(">d", f)))) == f
    assert math.isnan(value(spark, X.float64_be(F.lit(struct.pack(">d", math.nan))))) and value(spark, X.float64_be(F.lit(b"1"))) == 0.0
    for key in ("", "block1", "键é"):
        h = 5381
        for c in key.encode():
            h = (h * 33 + c) % 2**32
        assert value(spark, X.djb2(F.lit(key))) == h


def test_paths_and_sizes(spark):
    assert value(spark, X.block_path(F.lit(0x12345))) == "45/23/00012345.blk"
    assert [value(spark, X.parent_path(F.lit(p))) for p in ("/a/b/c", "/a", "/")] == ["/a/b", "/", "/"]
    cases = [("/a", "/a", True), ("*", "/x", True), ("/a/*", "/a/b", True), ("/a/*", "/a", False), ("/a", "/a/b/c", True), ("/a", "/ab", False)]
    assert [value(spark, X.path_matches(F.lit(p), F.lit(r))) for p, r, _ in cases] == [w for *_, w in cases]
    assert [value(spark, X.byte_size(F.lit(n))) for n in (0, 1023, 1024, 1536, 1 << 20, 5 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB"]
    data = F.lit(b"abcdef")
    assert [bytes(value(spark, c)) for c in (X.read_range(data, 2, 3), X.truncated(data, 3), X.truncated(data, 8), X.write_range(data, 1, b"XY"), X.write_range(data, 8, b"Z"))] == [b"cde", b"abc", b"abcdef\0\0", b"aXYdef", b"abcdef\0\0Z"]
    pattern, attrs = F.create_map(F.lit("k"), F.lit("v")), F.create_map(F.lit("k"), F.lit("v"), F.lit("o"), F.lit("p"))
    assert value(spark, X.attributes_match(pattern, attrs)) and not value(spark, X.attributes_match(attrs, pattern))


def test_metadata(spark):
    num = lambda n: n.to_bytes(8, "big", signed=True)
    rows = [("f1", 4, b"title"), ("f1", 0x1001, num(42)), ("f2", 4, b"other"), ("f2", 0x1001, num(-1)), ("f3", 4, b"")]
    meta = M.Metadata(spark.createDataFrame(rows, "file_id string, tag int, value binary"))
    files = lambda *c, **k: sorted(r.file_id for r in meta.matching(list(c), **k).collect())
    assert files(M.Condition(4, M.EQ, b"title")) == ["f1"] and files(M.Condition(4, M.NE, b"title")) == ["f2", "f3"]
    assert files(M.Condition(0x1001, M.GT, num(0))) == ["f1"] and files(M.Condition(0x1001, M.LT, num(0))) == ["f2"]
    assert files(M.Condition(4, M.GT, b"p")) == ["f1"] and files(M.Condition(4, M.CONTAINS, b"")) == ["f1", "f2", "f3"] and files(M.Condition(4, M.CONTAINS, b"the")) == ["f2"]
    both = (M.Condition(4, M.EQ, b"title"), M.Condition(0x1001, M.LT, num(0)))
    assert files(*both) == [] and files(*both, any_of=True) == ["f1", "f2"] and meta.matching_entries(list(both)).isEmpty()
    assert bytes(meta.get("f1", 4).first().value) == b"title" and meta.delete("f1", 4).get("f1", 4).isEmpty()
    with pytest.raises(E.NotFoundError):
        meta.delete("f1", 99)
    with pytest.raises(E.AccessError):
        meta.delete("f1", 2)
    ops = spark.createDataFrame([("f1", 4, 2, 2, b"!"), ("f1", 4, 1, 0, b"new"), ("f2", 4, 1, 1, None), ("f9", 7, 1, 2, b"x"), ("f9", 8, 1, 1, None)], "file_id string, tag int, seq long, op int, value binary")
    after = {(r.file_id, r.tag): bytes(r.value) for r in meta.batch(ops).rows.collect()}
    assert after == {("f1", 4): b"new!", ("f1", 0x1001): num(42), ("f2", 0x1001): num(-1), ("f3", 4): b"", ("f9", 7): b"x"}
    with pytest.raises(E.AccessError):
        meta.batch(spark.createDataFrame([("f1", 1, 1, 1, None)], ops.schema))
    page = meta.query([M.Condition(4, M.CONTAINS, b"")], limit=2, sort_tag=4).collect()
    assert [r.file_id for r in page] == ["f3", "f2"] and page[0].total_count == 3 and page[0].has_more


def test_blocks(spark):
    data = spark.createDataFrame([(k, bytes([k]) * k) for k in range(1, 8)], "k int, data binary")
    rows = B.written(data, ["k"], free=spark.createDataFrame([(40,), (20,)], "block_id long"), first=100)
    got = {r.k: r for r in rows.collect()}
    assert [got[k].block_id for k in range(1, 8)] == [20, 40, 100, 101, 102, 103, 104] and got[3].size == 3
    assert B.corrupted(rows).isEmpty() and B.corrupted(rows.withColumn("data", F.lit(b"x"))).count() == 7
    linked = B.linked(B.linked(rows, 20, 40), 40, 100)
    chain = B.chain(linked.where("next > 0 or prev > 0").select(F.col("block_id").alias("id"), F.when(F.col("next") > 0, F.col("next")).alias("next")), spark.createDataFrame([(20,)], "id long"))
    assert [(r.id, r.depth) for r in chain.orderBy("depth").collect()] == [(20, 0), (40, 1), (100, 2)]
    rest = {r.block_id: (r.prev, r.next) for r in B.deleted(linked, 40).collect()}
    assert rest[20] == (0, 100) and rest[100] == (20, 0) and 40 not in rest
    with pytest.raises(E.NotFoundError):
        B.deleted(rows, 999)


def test_stores(spark, tmp_path):
    rows = B.written(spark.createDataFrame([(k, b"x" * (k * 400)) for k in range(1, 6)], "k int, data binary"), ["k"]).drop("k")
    path = str(tmp_path)
    stores.write(rows, path, "container")
    for old, new in (("container", "directory"), ("directory", "hybrid")):
        stores.convert(spark, path, old, new)
        back = stores.read(spark, path, new).drop("location")
        assert back.select(sorted(rows.columns)).exceptAll(rows.select(sorted(rows.columns))).isEmpty() and back.count() == 5
    assert stores.block(spark, path, "directory", 3).first().size == 1200
    stores.upsert(spark, path, "container", rows.where("block_id = 2").withColumn("size", F.lit(1).cast("long")), str(tmp_path / "new"))
    assert stores.block(spark, str(tmp_path / "new"), "container", 2).first().size == 1
    with pytest.raises(E.InvalidValueError):
        stores.read(spark, path, "nosuch")


def test_container_files(spark, tmp_path):
    for k in range(3):
        container.write(str(tmp_path / f"{k}.frag"), {4: b"title%d" % k, 0x1001: b"v"}, [{"id": j, "data": bytes([j]) * j, "next": j + 1} for j in range(1, 4)], created=7)
    container.register(spark)
    read = lambda what, glob="*.frag": spark.read.format("tessella-container").option("what", what).load(str(tmp_path / glob))
    assert read("files").count() == 3 and {r.created for r in read("files").collect()} == {7}
    assert {bytes(r.value) for r in read("metadata").where("tag = 4").collect()} == {b"title0", b"title1", b"title2"}
    assert read("blocks").agg(F.sum("size")).first()[0] == 18 and {r.block_id for r in read("blocks", "1.frag").collect()} == {1, 2, 3}
    data = bytearray((tmp_path / "1.frag").read_bytes())
    data[-1] ^= 1
    (tmp_path / "bad.frag").write_bytes(data)
    with pytest.raises(E.CorruptedError):
        list(container.blocks(bytes(data)))
    with pytest.raises(E.CorruptedError):
        container.header(b"x" * 300)


def test_access_figures(spark):
    log = spark.createDataFrame([("a", 10, "inline", 1, 1), ("a", 0, "container", 2, 2), ("a", 5, "directory", 2, 3), ("b", 0, "inline", 1, 4)], "block_key string, size long, location string, t long, seq long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.block_key: r for r in A.access_records(log).collect()}
    assert (got["a"].n, got["a"].location, got["a"].size, got["b"].size) == (3, "directory", 5, None)
    samples = spark.createDataFrame([("k", float(x)) for x in range(1, 11)], "k string, v double")
    row = A.latency_percentiles(samples, ["k"], "v", [-5, 0, 50, 95, 100, 150]).first()
    assert (row["p-5"], row.p0, row.p50, row.p95, row.p100, row.p150) == (1, 1, 5, 9, 10, 10)
    sizes = [("container", 10, 100 << 10), ("directory", 1000, 2 << 20), ("container", 100, 500 << 10)]
    for want, n, used in sizes:
        assert value(spark, A.storage_mode(F.lit(used), F.lit(n), F.lit(0.4 if n == 100 else 0.0), F.lit("x"), 1 << 20)) == want
    assert [value(spark, A.place_hybrid(F.lit(n))) for n in (512, 2 << 20, 1 << 20, 600)] == ["inline", "directory", "directory", "container"]
    assert value(spark, A.read_write_pattern(F.lit(9), F.lit(1))).pattern == "read-heavy" and value(spark, A.read_write_pattern(F.lit(0), F.lit(0))) is None
    cache = spark.createDataFrame([("x", 5, 1), ("y", 5, 2), ("z", 5, 3)], "k string, size long, last long")
    assert {r.k for r in A.evicted(cache, 6, ["last"]).collect()} == {"x", "y"} and A.evicted(cache, 0, ["last"]).isEmpty()
    assert [r.k for r in A.kept_by_lru(cache, 2, "last", "k").collect()] == ["z", "y"]


def test_access_rules(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    acl = spark.createDataFrame([("u", "/a", "*", "allow", None), ("u", "/a/secret", "read", "deny", None), ("*", "/pub/*", "read", "allow", None), ("u", "/old", "*", "allow", datetime(2020, 1, 1))], "subject_id string, resource_id string, operation string, effect string, expires_at timestamp")
    asks = [(1, "u", "/a/x", "write"), (2, "u", "/a/secret/k", "read"), (3, "v", "/pub/1", "read"), (4, "v", "/pub/1", "write"), (5, "u", "/old", "read"), (6, "w", "/r/1", "write")]
    requests = spark.createDataFrame(asks, "request_id long, subject string, resource string, operation string")
    assert {r.request_id for r in SEC.acl_check(requests, acl, now).where("allowed").collect()} == {1, 3}
    roles = SEC.effective_roles(spark.createDataFrame([("w", "a"), ("u", "a")], "subject string, role string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "none")], "role string, parent string"))
    assert {r.role for r in roles.where("subject = 'w'").collect()} == {"a", "b", "c", "none"}
    permissions = spark.createDataFrame([("c", "/r/*", ["write"]), ("b", "/a/secret", ["*"])], "role string, resource_pattern string, operations array<string>")
    assert {r.request_id for r in SEC.access(requests, acl, roles, permissions, now).where("allowed").collect()} == {1, 3, 6}
    assert {r.request_id for r in SEC.access(requests, acl, roles, permissions, now, deny_wins=False).where("allowed").collect()} == {1, 2, 3, 6}


def test_crypto(spark):
    keys = C.KeyStore()
    key = keys.generate("k")
    r = random.Random(2)
    blocks = spark.createDataFrame([(k, r.randbytes(n), 0) for k, n in enumerate((64, 4096, 100_000))], "block_id long, data binary, flags int").withColumn("flags", F.col("flags").cast("smallint"))
    sealed = C.encrypt_blocks(blocks, key).persist()
    assert all(x.flags == 2 for x in sealed.collect()) and sealed.join(blocks, ["block_id", "data"]).isEmpty()
    assert C.decrypt_blocks(sealed, key).exceptAll(blocks).isEmpty() and C.encrypt_blocks(blocks, None) is blocks
    swapped = sealed.withColumn("block_id", F.col("block_id") + 1).select(C.decrypt(F.col("data"), key.material, C.block_aad(F.col("block_id")), strict=False).alias("d"))
    assert swapped.where("d is not null").isEmpty()
    signed = blocks.withColumn("s", C.hmac_sign(F.col("data"), b"secret"))
    assert signed.where(~C.hmac_verify(F.col("data"), F.col("s"), b"secret")).isEmpty() and signed.where(C.hmac_verify(F.col("data"), F.col("s"), b"other")).isEmpty()
    new = keys.rotate("k")
    assert keys.get("k").material == key.material and keys.get("k").replaced_by == new.id and keys.list() == ["k", new.id]
    keys.generate("old", expires=datetime(2020, 1, 1, tzinfo=UTC))
    for call, error in ((lambda: keys.get("old"), E.AccessError), (lambda: keys.get("none"), E.NotFoundError), (lambda: keys.generate("k"), E.AlreadyExistsError), (lambda: keys.import_key("x", b"1"), E.AccessError)):
        with pytest.raises(error):
            call()


def test_file_tree(spark):
    rows = [("/a", True, 0), ("/a/b", True, 0), ("/a/b/c", False, 700), ("/ab", False, 1)]
    tree = spark.createDataFrame(rows, "path string, is_dir boolean, size long")
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(FS.children(tree, "/")) == ["/a", "/ab"] and paths(FS.children(tree, "/a")) == ["/a/b"]
    assert paths(FS.moved(tree, "/a", "/z")) == ["/ab", "/z", "/z/b", "/z/b/c"] and FS.stat(tree, "/a/b/c").first().blocks == 2
    assert paths(FS.deleted(tree, "/ab")) == ["/a", "/a/b", "/a/b/c"] and "/a/n" in paths(FS.made(tree, "/a/n"))
    for call, error in ((lambda: FS.deleted(tree, "/a"), E.InvalidValueError), (lambda: FS.moved(tree, "/x", "/y"), E.NotFoundError), (lambda: FS.moved(tree, "/a", "/ab"), E.AlreadyExistsError), (lambda: FS.made(tree, "/q/r"), E.NotFoundError), (lambda: FS.moved(tree, "/a", "/a/b/d"), E.InvalidValueError)):
        with pytest.raises(error):
            call()


def test_streaming(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, 5, 1, "add"), (1, 6, 2, "add"), (1, 5, 3, "remove"), (2, 7, 4, "add"), (2, 7, 5, "remove"), (2, 7, 6, "add")]
    frame = spark.createDataFrame(rows, "tag long, id long, seq long, op string")
    for k in range(3):
        frame.where(f"seq > {2 * k} and seq <= {2 * k + 2}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest.maintain_index(stream, out, str(tmp_path / "check"))
    query.awaitTermination(120)
    assert sorted((r.tag, r.id) for r in ingest.current_index(spark, out).collect()) == [(1, 6), (2, 7)]
    ingest.compact_index(spark, out, str(tmp_path / "compact"))
    assert sorted((r.tag, r.id) for r in ingest.current_index(spark, str(tmp_path / "compact")).collect()) == [(1, 6), (2, 7)]

    events = spark.createDataFrame([(k, datetime(2024, 1, 1, 0, k), "click", float(k)) for k in range(30)], "event_id long, ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "events"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = ingest.tumbling(live, "10 minutes", "0 seconds").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.n, r.total) for r in spark.table("windows").collect()) == sorted((r.n, r.total) for r in ingest.tumbling(events, "10 minutes", "0 seconds").collect())


def test_config(tmp_path):
    for bad in ({"storage": {"mode": "x"}}, {"storage": {"block_size": 1000}}, {"index": {"shards": 0}}, {"logging": {"level": "loud"}}, {"query": {"threshold": 2}}, {"nosuch": {}}, {"index": {"nosuch": 1}}):
        with pytest.raises(E.ConfigError):
            Config.from_dict(bad)
    path, log = str(tmp_path / "c.json"), str(tmp_path / "log")
    Config().save(path)
    manager, calls = Manager(path, log, log_bytes=50), []
    manager.listen(lambda old, new: calls.append(new.index.shards), "index")
    assert not manager.poll()
    for n in (32, 64):
        assert manager.apply(Config(index=Index(shards=n)))["index.shards"][1] == n
    assert calls == [32, 64] and (tmp_path / "log.1").exists()
    assert manager.apply(Config(index=Index(shards=64), storage=Storage(mode="hybrid"))) == {"storage.mode": ("container", "hybrid")} and len(calls) == 2
    import os

    Config(index=Index(shards=8)).save(path)
    os.utime(path, ns=(1, 1))
    assert manager.poll() and manager.current.index.shards == 8 and not manager.poll()


def test_long_chains_cycles_and_roles(spark):
    """Pointers are doubled: no depth of recursion bounds a walk, and a cycle ends."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(2_000)] + [(20_000, 20_001), (20_001, 20_000)], "id long, next long")
    found = {(r.start, r.id): r.depth for r in B.chain(edges, spark.createDataFrame([(0,), (1_990,), (50_000,)], "id long")).collect()}
    assert found == {(0, k): k for k in range(2_001)} | {(1_990, k): k - 1_990 for k in range(1_990, 2_001)} | {(50_000, 50_000): 0}
    assert {r.id for r in B.chain(edges, spark.createDataFrame([(20_000,)], "id long"), depth=5).collect()} == {20_000, 20_001}
    roles = SEC.effective_roles(spark.createDataFrame([("u", "r0")], "subject string, role string"), spark.createDataFrame([(f"r{k}", f"r{k + 1}") for k in range(300)] + [("r300", "r0")], "role string, parent string"))
    assert {r.role for r in roles.collect()} == {f"r{k}" for k in range(301)}


def test_types_and_attributes_of_rules(spark):
    schema = "subject_id string, resource_id string, operation string, effect string, expires_at timestamp, subject_attributes map<string,string>, resource_type string"
    acl = spark.createDataFrame([("*", "/a/*", "read", "allow", None, {"team": "x"}, "*"), ("ann", "/a/*", "read", "deny", None, None, "secret")], schema)
    asked = spark.createDataFrame([(1, "bob", "/a/1", "read", {"team": "x"}, "plain"), (2, "bob", "/a/1", "read", {"team": "y"}, "plain"), (3, "ann", "/a/1", "read", {"team": "x"}, "secret"), (4, "ann", "/a/1", "read", {"team": "x"}, "plain")], "request_id long, subject string, resource string, operation string, subject_attributes map<string,string>, resource_type string")
    want = [(1, True, False), (2, False, False), (3, False, True), (4, True, False)]
    now = F.lit("2024-01-01").cast("timestamp")
    assert sorted(map(tuple, SEC.acl_check(asked, acl, now).collect())) == want
    before, SEC.BROADCAST_RULES = SEC.BROADCAST_RULES, 0
    try:
        assert sorted(map(tuple, SEC.acl_check(asked, acl, now).collect())) == want
    finally:
        SEC.BROADCAST_RULES = before
    with pytest.raises(E.NotFoundError):
        SEC.assign(spark.createDataFrame([("u", "a")], "subject string, role string"), spark.createDataFrame([("a",)], "role string"), spark.createDataFrame([("u", "b")], "subject string, role string"))


def test_numbers_stay_dense_and_in_order_in_many_partitions(spark):
    """Each reader of the numbered rows takes other columns, so a range exchange of its own would be coalesced otherwise."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        data = spark.range(0, 20_000, 1, 4).select((F.col("id") * 7 % 20_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("data"))
        rows = B.written(data, ["k"])
        found = [(r["k"], r["block_id"]) for r in rows.select("k", "block_id").orderBy("k").collect()]
        assert found == [(k, k + 1) for k in range(20_000)]
        marked = rows.withColumn("data", F.when(F.col("block_id") % 10 == 0, F.concat("data", F.lit(b"!"))).otherwise(F.col("data")))
        assert B.corrupted(marked).count() == 2_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
