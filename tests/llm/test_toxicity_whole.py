"""The whole vocabulary's models against a plain computation, and rare words and pairs of ordinary words that decide a text."""

import math
import random
import zlib
from collections import Counter

import pytest

from thalweg.llm import kneser_ney as whole
from thalweg.llm import toxicity_kn as kn

from .common import prose
from .test_toxicity_kn import corpus


def brute(texts, truth):
    """Plain Kneser-Ney ratio of every text: all words and pairs of folds 2 to 4."""
    train = [((t or "").split(), truth[i]) for i, t in texts.items() if i in truth and zlib.crc32(str(i).encode()) % 5 > 1]
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for w, y in train:
        words[1 - y].update(set(w))
        pairs[1 - y].update(set(zip(w, w[1:], strict=False)))
    every = set(pairs[0]) | set(pairs[1])
    follows = Counter(w for _, w in every)
    denominator = len(every) + 0.5 * (len(set(words[0]) | set(words[1])) + 1)

    def log_p(w, c, both):
        total = sum(c.values())
        left = sum(min(x, 0.75) for x in c.values()) / total
        after, discounted = Counter(), Counter()
        for (h, _), x in both.items():
            after[h] += x
            discounted[h] += min(x, 1)
        low = lambda x: max(c[x] - 0.75, 0) / total + left * (follows[x] + 0.5) / denominator
        out = math.log(low(w[0])) if w else 0.0
        for h, x in zip(w, w[1:], strict=False):
            out += math.log(max(both[h, x] - 1, 0) / after[h] + discounted[h] / after[h] * low(x) if after[h] else low(x))
        # the end of a text is an end for both, and is not counted: what its last word leaves is
        return out + (math.log(discounted[w[-1]] / after[w[-1]]) if w and after[w[-1]] else 0.0)

    return {i: log_p((t or "").split(), words[0], pairs[0]) - log_p((t or "").split(), words[1], pairs[1]) for i, t in texts.items()}


@pytest.mark.parametrize(("block", "often"), [(whole.BLOCK, whole.OFTEN), (2000, 0), (2000, 640)])
def test_every_word_and_pair_counts(spark, monkeypatch, block, often):
    monkeypatch.setattr(whole, "BLOCK", block)
    monkeypatch.setattr(whole, "OFTEN", often)
    docs, labels, truth = corpus(spark, 150)
    odd = spark.createDataFrame([(1000, None), (1001, " "), (1002, "never seen"), (1003, "zok"), (1004, "zok zug " * 50)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd).union(odd.where("doc_id = 1004"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute(texts, truth)
    model = kn.fit_toxicity(docs, labels)
    got = kn.both_ratios(docs.selectExpr("doc_id AS i", "text"), model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.whole == pytest.approx(want[r.i], rel=1e-5, abs=1e-4)


def planted(spark, plant, n=900):
    """Ordinary prose in which ``plant`` puts expressions into a text's words, by whether the text is one of the third that is toxic."""
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = prose(i, 40, "abc", 10).split()
        for _ in range(4):
            plant(r, words, i % 3 == 0)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def right(docs, model):
    got = kn.score_toxicity(docs, model).where("held_out").collect()
    return sum(r.predicted == (r.doc_id % 3 == 0) for r in got) / len(got)


def test_rare_words_are_smoothed_not_lost(spark):
    def plant(r, words, toxic):
        if toxic:
            words[r.randrange(len(words))] = f"zz{r.randrange(200)}"

    docs, labels = planted(spark, plant)
    model = kn.fit_toxicity(docs, labels)
    assert model.words.where("toxic > plain").count() <= 5  # few of the 200 are told apart
    assert right(docs, model) >= 0.9


def test_pairs_of_ordinary_words_count(spark):
    def plant(r, words, toxic):
        k = r.randrange(20)
        both = [f"u{k}", f"v{k}"]
        at = r.randrange(len(words) - 1)
        words[at : at + 1] = both if toxic else [both[0], words[at], both[1]]

    docs, labels = planted(spark, plant)
    model = kn.fit_toxicity(docs, labels)
    assert model.words.count() <= 3  # the words alone tell nothing
    assert right(docs, model) >= 0.9
