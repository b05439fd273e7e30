import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, kept, SF)
        after = spark.createDataFrame(after.toPandas(), after.schema)
        seen.append((name, kept, after))
        kept = after
    for _, _, after in seen[:-1]:
        assert after.columns == list(corpus_pipeline.COLUMNS)
    quality = seen[0][2]
    good = quality.join(labels, "doc_id")
    assert good.filter("quality = 1").count() >= 0.95 * docs.join(labels, "doc_id").filter("quality = 1").count()
    assert good.filter("quality = 0").count() <= 0.1 * docs.join(labels, "doc_id").filter("quality = 0").count()
    # Near copies: plain loops over what the stage had.
    texts = {r.doc_id: r.text or "" for r in seen[2][1].collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.split()) else set() for i, t in texts.items()}
    left = {r.doc_id for r in seen[2][2].collect()}
    for i in left:
        for j in left:
            if i < j and shingles[i] and shingles[j]:
                assert len(shingles[i] & shingles[j]) < 0.8 * len(shingles[i] | shingles[j])
    for i in texts.keys() - left:
        assert any(shingles[i] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in texts if j < i)
    # Packing: every document of its input, whole.
    rows = seen[4][2].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in seen[4][1].collect()}
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in rows)


def test_run_equals_the_stages_one_after_another(spark):
    want = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, SF)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(corpus_pipeline.run(spark, SF).select(key).collect()) == sorted(want.select(key).collect())


def test_stages_take_edge_rows_and_empty_tables(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    rows = [tuple(r)[:5] for r in good] + [(None, None, None, None, None), (900, None, "en", None, None), (901, "", None, "s", 0), (902, "word " * 30000, "en", "s", 150000), (903, "a\n\n b", "en", "s", 6), (903, "a\n\n b", "en", "s", 6), (None, good[0].text, "en", "s", 5)]
    edge = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as sampled", "1 as class_id", "2 as n_removed")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, SF).collect()
        assert out, name
        if name == "n-gram Jaccard join":
            assert sum(r.doc_id == 903 for r in out) == 1
        assert stage(spark, edge.limit(0), SF).count() == 0, name
