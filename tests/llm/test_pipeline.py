import corpus_pipeline
from imgq.llm import lang_id, queries

ORDER = ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_stages_take_effect(spark, tmp_path, documents, rows):
    item = rows[6][1]
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ORDER
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{i}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if i < 4:
            assert docs.columns == documents.columns
    assert not seen[0] & {60, 61, 62}
    assert not seen[2] & {63, 64, 65, 66, 67}  # copies of 3
    assert 6 in seen[2] and 6 not in seen[3]
    assert {0, 1, 2, 3, 4, 5, 71} <= seen[4]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == seen[4]


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert lang_id.UNKNOWN == "und"


def test_columns_called_like_results(spark, documents, rows):
    df = spark.createDataFrame([(1, "a repeated line here\nown one", 5, "mine1", 7, 8), (2, "a repeated line here\nown two", 5, "mine2", 7, 8)], "doc_id long, text string, n_chars long, kept string, n_lines int, n_dropped int")
    got = corpus_pipeline.dedup_lines(spark, df, "").orderBy("doc_id")
    assert got.columns == df.columns
    assert [tuple(r) for r in got.collect()] == [(1, "a repeated line here\nown one", 28, "mine1", 7, 8), (2, "own two", 7, "mine2", 7, 8)]
    bare = corpus_pipeline.dedup_lines(spark, df.select("doc_id", "text"), "")
    assert bare.columns == ["doc_id", "text"]
