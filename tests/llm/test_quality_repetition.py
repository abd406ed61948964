import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from thalweg.llm.quality_repetition import repetition, repetition_rules
from thalweg.llm.words import split

from .common import empty, frame, odd_texts


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def covered(w, k):
    places = defaultdict(list)
    for i in range(len(w) - k + 1):
        places[tuple(w[i : i + k])].append(i)
    return len({j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + k)})


def longest(w):
    best = 0
    for i in range(len(w)):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            best = max(best, n)
    return best


def maximal(w, least):
    places, n = defaultdict(list), 0
    for i in range(len(w)):
        for size in range(least, len(w) - i + 1):
            places[tuple(w[i : i + size])].append(i)
    for s, v in places.items():
        if len(v) > 1:
            n += len({w[i - 1] if i else i for i in v}) > 1 and len({w[i + len(s)] if i + len(s) < len(w) else -i - 1 for i in v}) > 1
    return n


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(seed):
    r = random.Random(seed)
    texts = [None, "", " ", "a", "a a a a a a", *(" ".join(r.choice("abc") for _ in range(r.randint(1, 50))) for _ in range(80))]
    got = repetition(split(pa.array(texts)), 4)
    ws = [words(t) for t in texts]
    assert got["n_repeat_words"].tolist() == [covered(w, 3) for w in ws]
    assert got["n_covered"].tolist() == [covered(w, 4) for w in ws]
    assert got["longest_repeat"].tolist() == [longest(w) for w in ws]
    assert got["n_maximal_repeats"].tolist() == [maximal(w, 4) for w in ws]


def test_texts_do_not_meet():
    t = " ".join(f"w{i}" for i in range(60))
    got = repetition(split(pa.array([t, t, t])))
    assert np.all(got["n_repeat_words"] == 0) and np.all(got["longest_repeat"] == 0)


def test_rules(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    looped = clean + " " + " ".join(f"v{i}" for i in range(30)) + " " + clean
    rows = {r.doc_id: r for r in repetition_rules(frame(spark, [*odd_texts(), clean, looped, "x\nx\n\n \nx"], extra=True)).collect()}
    n = len(odd_texts())
    assert not rows[0].kept and rows[0].base_failed and rows[0].n_words == 0
    assert rows[n].kept and not rows[n].base_failed
    assert rows[n + 1].base_failed and not rows[n + 1].kept
    assert rows[n + 2].n_dup_lines == 2 and rows[n + 2].word_chars == 3
    assert repetition_rules(empty(spark)).count() == 0
    assert repetition_rules(frame(spark, odd_texts())).count() == len(odd_texts()) + 2


def test_maximal_intervals_decide(monkeypatch):
    """Without the intervals nothing is covered."""
    from thalweg.llm import quality_repetition

    t = " ".join(["a b c d e f"] * 8)
    assert repetition(split(pa.array([t])), 4)["n_covered"].tolist() == [48]
    monkeypatch.setattr(quality_repetition, "maximal_repeats", lambda *a: np.zeros((0, 3), np.int64))
    assert repetition(split(pa.array([t])), 4)["n_covered"].tolist() == [0]


def test_one_word_many_times():
    got = repetition(split(pa.array(["x " * 50_000])))
    assert got["n_covered"].tolist() == [50_000] and got["longest_repeat"].tolist() == [49_999]
