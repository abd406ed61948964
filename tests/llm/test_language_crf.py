import numpy as np
import pyarrow as pa

from thalweg.llm.language_crf import PIECE, fit, fit_languages, keep_identified, label_words, pieces_of, posteriors, predict_languages
from thalweg.llm.words import split

from .common import empty, frame, odd_texts, prose


def slow(scores, transitions):
    a, x = np.exp(transitions), np.exp(scores.astype(float))
    n, k = x.shape
    f, b = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        f[t] = ((f[t - 1] if t else np.full(k, 1 / k)) @ a) * x[t]
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = a @ (x[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    g = f * b
    return g / g.sum(axis=1, keepdims=True)


def test_forward_backward_in_pieces_is_exact():
    r = np.random.default_rng(0)
    words = split(pa.array([" ".join(f"w{i}" for i in range(n)) for n in (1, 3, PIECE, PIECE + 1, 3 * PIECE + 7, 0, 5)]))
    p = pieces_of(words)
    score, transitions = r.normal(size=(len(words.vocab), 3)).astype(np.float32), r.normal(size=(3, 3))
    got = posteriors(score[words.codes[p.cell]], transitions, p).transpose(1, 0, 2)[p.real.T]
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        if b > a:
            assert np.abs(got[a:b] - slow(score[words.codes[a:b]], transitions)).max() < 1e-4


def model():
    return fit([prose(i, 40, "abcde") for i in range(20)] + [prose(i, 40, "vwxyz") for i in range(20)], ["aa"] * 20 + ["zz"] * 20)


def test_words_of_mixed_text():
    got = label_words("abc bcd cde vwx wxy xyz", model())
    assert [x[1] for x in got] == ["aa"] * 3 + ["zz"] * 3


def test_held_out_accuracy(spark):
    rows = [(i, prose(100 + i, 20 + i, "abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz", "s", 0) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in predict_languages(docs, fit_languages(docs, per_language=15)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert held and all(got[r[0]].lang_pred == r[2] and 0.5 < got[r[0]].score <= 1 for r in held)


def test_odd_cases(spark):
    docs = frame(spark, [*odd_texts(), "123 456 --"], extra=True)
    rows = predict_languages(docs, model()).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd_texts()) + 3
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == by[len(odd_texts())].lang_pred == "und"
    assert by[0].score == 0 and by[None].held_out is False
    assert predict_languages(empty(spark), fit_languages(empty(spark))).count() == 0
    assert {r.lang_pred for r in predict_languages(docs, None).collect()} == {"und"}
    kept = keep_identified(docs, model(), 0.3)
    assert kept.columns == docs.columns and 0 not in {r.doc_id for r in kept.collect()}


def test_pair_marginals_are_exact():
    r = np.random.default_rng(1)
    words = split(pa.array([" ".join(f"w{i}" for i in range(n)) for n in (1, 2, PIECE, 2 * PIECE + 5, 0, 4)]))
    p = pieces_of(words)
    score, a = r.normal(size=(len(words.vocab), 3)).astype(np.float32), r.normal(size=(3, 3))
    got = np.zeros((3, 3))
    posteriors(score[words.codes[p.cell]], a, p, np.where(p.real, 1.0, 0.0), got)
    want = np.zeros((3, 3))
    for i, j in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        x, n = np.exp(score[words.codes[i:j]].astype(float)), j - i
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            f[t] = ((f[t - 1] if t else np.full(3, 1 / 3)) @ np.exp(a)) * x[t]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = np.exp(a) @ (x[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        for t in range(1, n):
            m = f[t - 1][:, None] * np.exp(a) * (x[t] * b[t])[None, :]
            want += m / m.sum()
    assert np.abs(got - want).max() < 1e-3 * want.sum()


def test_transitions_are_learned():
    """Phrases stay in their language more often than they switch, and a word of no language takes its neighbours'."""
    m = model()
    off = m.transitions[~np.eye(2, dtype=bool)]
    assert np.diag(m.transitions).min() > off.max() + 1
    got = label_words("abc bcd cde ??? abc dea wxy vwx ??? xyz vwz", m)
    assert got[3][1] == "aa" and got[8][1] == "zz"
    flat = label_words("abc bcd cde ??? abc dea wxy vwx ??? xyz vwz", m._replace(transitions=np.zeros((2, 2))))
    chance = lambda x: x[2] if x[1] == "aa" else 1 - x[2]
    assert chance(flat[3]) < chance(got[3]) and chance(flat[3]) > chance(got[8])


def test_lexicon_counts():
    m = model()
    known, bits = m.lexicon
    assert len(known) and set(bits.tolist()) <= {1, 2, 3}
