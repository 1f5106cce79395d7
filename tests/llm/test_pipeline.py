from __future__ import annotations

import random

import corpus_pipeline
from tessella.llm import bpe, decontamination, ngram_jaccard, quality_classifier


def tables(spark, path) -> None:
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5)))
    bench = [(k, " ".join(word() for _ in range(25))) for k in range(5)]
    rows, labels = [], []
    for k in range(240):
        w = [word() for _ in range(r.randint(30, 120))]
        if k % 10 == 1:
            w[5:5] = bench[k % 5][1].split()
        if k % 10 == 2:
            w = rows[-2][1].split() if k > 2 else w
        if k % 10 == 3:
            w.insert(3, f"me{k}@mail.example.org")
        if k % 10 == 4:
            w = [x + "###" for x in w]
        text = " ".join(w)
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
        labels.append((k, int(k % 10 != 4), 0))
    rows += [(300, None, None, None, None), (301, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_one_by_one(spark, tmp_path):
    tables(spark, tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, all_ids = docs.columns, {x.doc_id for x in docs.select("doc_id").collect()}

    quality = quality_classifier.quality(docs, spark.read.parquet(f"{d}/labels.parquet"))
    first = corpus_pipeline.keep_quality(spark, docs, d).persist()
    ids = {x.doc_id for x in first.collect()}
    assert first.columns == columns and ids == {x.doc_id for x in quality.where("kept").collect()}
    assert all(k % 10 != 4 for k in ids) and len(ids) > 190 and 300 not in ids

    second = corpus_pipeline.keep_one_of_similar(spark, first, d).persist()
    groups = ngram_jaccard.similar_documents(first).collect()
    assert second.columns == columns and {x.doc_id for x in second.collect()} == {x.component_id for x in groups} < ids

    third = corpus_pipeline.keep_uncontaminated(spark, second, d).persist()
    leaks = decontamination.contaminated_pairs(second, spark.read.parquet(f"{d}/benchmark.parquet")).collect()
    assert third.columns == columns and leaks
    assert {x.doc_id for x in third.collect()} == {x.doc_id for x in second.collect()} - {x.doc_id for x in leaks}

    fourth = corpus_pipeline.redact(spark, third, d).persist()
    assert fourth.columns == columns and fourth.count() == third.count()
    assert not any("@mail" in x.text for x in fourth.collect()) and all(x.n_chars == len(x.text) for x in fourth.collect())

    fifth = corpus_pipeline.encode(spark, fourth, d)
    assert sorted(map(tuple, fifth.collect())) == sorted(map(tuple, bpe.round_trip(fourth).collect()))
    whole = sorted(map(tuple, corpus_pipeline.run(spark, d).collect()))
    assert whole == sorted(map(tuple, fifth.collect())) and {x[0] for x in whole} < all_ids


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "e f g h", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.keep_one_of_similar(spark, docs, "").collect()) == [1, 2]
