"""The models' counts, probabilities and ratios against a plain computation over every expression told apart."""

import math
import zlib
from collections import Counter

import pytest

from thalweg.llm import toxicity_kn as kn

from .test_toxicity_kn import corpus


def told(t, p, share):
    expected, odds = (t + p) * share, (t + 0.5) / (p + 0.5) * (1 - share) / share
    return abs(t - expected) >= kn.APART * math.sqrt(expected + 0.5) and (odds >= kn.ODDS or odds <= 1 / kn.ODDS)


def brute(texts, truth):
    """Ratio of every text."""
    train = [(t.split(), truth[i]) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 > 1]
    c = [Counter(), Counter()]
    for words, y in train:
        c[1 - y].update(set(words))
    total = [sum(x.values()) for x in c]
    share = total[0] / sum(total)
    lexicon = {w for w in c[0] | c[1] if told(c[0][w], c[1][w], share)}
    name = lambda w: w if w in lexicon else None
    pairs = [Counter(), Counter()]
    for words, y in train:
        w = [name(x) for x in words]
        pairs[1 - y].update(set(zip(w, w[1:], strict=False)))
    every = set(pairs[0]) | set(pairs[1])
    follows = Counter(w for _, w in every)
    denominator = len(every) + 0.5 * (len(lexicon) + 1)
    kept = [k for k in every if told(pairs[0][k], pairs[1][k], share)]
    models = []
    for own, both, n in zip(c, pairs, total, strict=True):
        count = {w: own[w] for w in lexicon}
        count[None] = n - sum(count.values())
        cut = {w: max(x - 0.75, 0) / n for w, x in count.items()}
        left = 1 - sum(cut.values())
        part = {k: max(both[k] - 0.75, 0) / max(count[k[0]], 1) for k in kept}
        rest = {w: min(1, max(1e-6, 1 - sum(x for k, x in part.items() if k[0] == w))) for w in count}
        models.append(({w: cut[w] + left * (follows[w] + 0.5) / denominator for w in count}, rest, part))

    def log_p(w, m):
        p, rest, part = m
        return [math.log(p[x] if i == 0 else p[x] * rest[w[i - 1]] + part.get((w[i - 1], x), 0)) for i, x in enumerate(w)]

    out = {}
    for i, t in texts.items():
        w = [name(x) for x in t.split()]
        out[i] = sum(log_p(w, models[0])) - sum(log_p(w, models[1]))
    return out, len(lexicon)


def test_every_expression_counts(spark, monkeypatch):
    for bound in ("MAX_WORDS", "MAX_PAIRS"):  # there is none
        monkeypatch.setattr(kn, bound, 1, raising=False)
    docs, labels, truth = corpus(spark, 400)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, n = brute(texts, truth)
    model = kn.fit_toxicity(docs, labels)
    assert n > 1 and model.words.count() == n
    got = kn.ratios(kn.candidates(docs.selectExpr("doc_id AS i", "text"), model.passing), model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ratio == pytest.approx(want[r.i], rel=1e-6, abs=1e-6)


def test_a_full_filter_changes_nothing(spark):
    docs, labels, _ = corpus(spark, 200)
    model = kn.fit_toxicity(docs, labels)
    full = model._replace(passing=model.passing | ~model.passing)
    scores = lambda m: sorted((r.doc_id, round(r.score, 9)) for r in kn.score_toxicity(docs, m).collect())
    assert scores(full) == scores(model)
