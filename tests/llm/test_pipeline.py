import corpus_pipeline

from .common import empty, frame, odd_texts, prose


def test_stages(spark, tmp_path):
    shared = prose(500, 60)
    item = prose(501, 30)
    base = prose(502, 150)
    texts = [*odd_texts(), base, base + " tail", f"{prose(503, 90)} {shared}", f"{shared} {prose(504, 80)}", f"{prose(505, 100)} {item} {prose(506, 30)}", *(prose(600 + i, 60) for i in range(20)), "123 456"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    n = len(odd_texts())
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(texts) - 1 not in seen["language"] and 0 not in seen["language"] and n in seen["language"]
    assert n in seen["near_duplicates"] and n + 1 not in seen["near_duplicates"]
    assert shared[:100] not in seen["repeated_passages"][n + 2].text and len(seen["repeated_passages"]) == len(seen["near_duplicates"])
    assert n + 4 not in seen["test_leaks"] and len(seen["test_leaks"]) == len(seen["repeated_passages"]) - 1
    assert set(seen["packing"]) == set(seen["test_leaks"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_empty_tables(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
