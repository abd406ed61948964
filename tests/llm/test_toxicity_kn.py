import random
import zlib

from thalweg.llm.toxicity_kn import fit_toxicity, score_toxicity

from .common import empty, frame, odd_texts, prose


def corpus(spark, n=600):
    r = random.Random(0)
    docs, labels = [], []
    for i in range(n):
        words = prose(i, r.randint(20, 120), "abcde", 50).split()
        toxic = i % 6 == 0
        for _ in range(max(2, len(words) // 20) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["zok", "zug", "zim"])
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return d, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), labels[7]], "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_texts(spark):
    docs, labels, truth = corpus(spark)
    got = {r.doc_id: r for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_odd_cases(spark):
    docs, labels, _ = corpus(spark, 300)
    model = fit_toxicity(docs, labels)
    odd = frame(spark, odd_texts(), extra=True)
    rows = score_toxicity(odd, model).collect()
    assert len(rows) == len(odd_texts()) + 2
    by = {r.doc_id: r for r in rows}
    assert by[0].score == by[1].score == by[2].score and by[None].held_out is False
    assert score_toxicity(empty(spark), model).count() == 0
    assert fit_toxicity(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in score_toxicity(odd, None).collect()} == {0.0}
    assert fit_toxicity(empty(spark), labels) is None
