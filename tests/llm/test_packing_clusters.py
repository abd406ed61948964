from collections import Counter

from thalweg.llm.packing import pack_documents


def test_named_clusters_keep_apart(spark):
    rows = [(i, f"w{i} " * 10, f"s{i}", i % 3 if i < 12 else None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, near int")
    cluster = {r[0]: r[3] for r in rows}
    got = pack_documents(docs, cluster_col="near").collect()
    assert sorted(r.doc_id for r in got) == list(range(20)) and all(r.n_tokens == 10 for r in got)
    inside = Counter((r.bin_id, cluster[r.doc_id]) for r in got if cluster[r.doc_id] is not None)
    assert max(inside.values()) == 1
    assert len({r.bin_id for r in got}) == 4
    assert len({r.bin_id for r in pack_documents(docs).collect()}) == 1
