import random

import numpy as np

from thalweg.llm.decontaminate import GAP, MATCH, MISMATCH, align, contaminated, drop_contaminated

from .common import empty, frame, odd_texts, prose


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return h.max()


def test_alignment_against_the_table():
    r = random.Random(0)
    for _ in range(200):
        a, b = (np.array([r.randrange(4) for _ in range(r.randint(1, 15))], np.uint64) for _ in range(2))
        assert align(a, b)[0] == smith_waterman(a, b)


ITEM = prose(5, 40)


def edited(seed, every):
    r = random.Random(seed)
    return " ".join(w if i % every else r.choice([w + "x", "other"]) for i, w in enumerate(ITEM.split()))


def documents():
    inside = lambda t: f"{prose(70, 200)} {t} {prose(71, 100)}"
    half = " ".join(ITEM.split()[:10])
    return [*odd_texts(), inside(ITEM), inside(ITEM.upper().replace(" ", ", ")), inside(edited(1, 6)), inside(half), prose(72, 400)]


def test_copies_are_found_and_others_left(spark):
    docs = frame(spark, documents(), extra=True)
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "two words"), (None, prose(6, 30)), (1, ITEM)], "item_id long, text string").selectExpr("*", "1 AS score")
    n = len(odd_texts())
    found = contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(n, 1), (n + 1, 1), (n + 2, 1)}
    assert len(found) == 6 and all(r.score == 1.0 for r in found if r.doc_id in (n, n + 1))
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert contaminated(empty(spark), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_widely_leaked_item_keeps_its_seeds(spark):
    docs = spark.createDataFrame([(i, f"{prose(i, 20)} {edited(i, 5)} {prose(1000 + i, 20)}") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contaminated(docs, items).count() == 60
