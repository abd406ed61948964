import itertools
import random

import numpy as np
import pytest

from thalweg.llm.jaccard_join import allocated, keep_one_of_each, signatures, similar_components, similar_forest

from .common import empty, frame, odd_texts, prose


def components(n, edges):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_pigeonhole_and_forest(seed):
    r = random.Random(seed)
    p = r.choice([70, 80, 90, 95])
    sets = set()
    for _ in range(4):
        base = [r.getrandbits(63) for _ in range(r.choice([1, 2, 5, 9, 10, 12, 19, 20, 25, 40, 100, 300]))]
        for _ in range(12):
            s = set(base)
            for _ in range(r.randint(0, max(1, len(base) // 7))):
                if r.random() < 0.4 and len(s) > 1:
                    s.discard(r.choice(sorted(s)))
                else:
                    s.add(r.getrandbits(63))
            sets.add(frozenset(s))
    sets = [set(s) for s in sets]
    tokens = np.concatenate([np.sort(np.array(sorted(s), np.uint64)) for s in sets])
    offsets = np.r_[0, np.cumsum([len(s) for s in sets])]
    unit, key, single = signatures(tokens, offsets, p)
    copies = r.choice([1, 1, 5, 300])  # as if the sets were in so many more texts
    number = np.unique(key, return_inverse=True)[1]
    frequency = np.array([copies * x for x in np.bincount(number)])[number]
    shared = np.bincount(number)[number] > 1
    keep = allocated(p, np.diff(offsets), unit[shared], single[shared], frequency[shared])
    by = {}
    for a, b in zip((unit[shared][keep] >> 1).tolist(), key[shared][keep].tolist(), strict=True):
        by.setdefault(b, set()).add(a)
    candidates = {x for v in by.values() for x in itertools.combinations(sorted(v), 2)}
    linked = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])}
    assert linked <= candidates
    assert components(len(sets), similar_forest(tokens, offsets, p)) == components(len(sets), linked)
    part = np.array([r.randint(0, 1) for _ in sets])
    assert components(len(sets), similar_forest(tokens, offsets, p, part)) == components(len(sets), [(a, b) for a, b in linked if part[a] != part[b]])


def shingles(text, k):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def edited(text, seed, n):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    texts = [*odd_texts()]
    for b in range(3):
        base = prose(50 + b, 120)
        texts += [edited(base, 10 * b + i, i % 4) for i in range(10)] + [base, base.upper()]
    return texts


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, k, percent):
    df = frame(spark, corpus(), extra=True)
    rows = df.select("doc_id", "text").collect()
    sets = [shingles(r.text, k) for r in rows]
    linked = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    top = components(len(rows), linked)
    least = {}
    for r, t in zip(rows, top, strict=True):
        if r.doc_id is not None:
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, len(s), least.get(t)) for r, s, t in zip(rows, sets, top, strict=True)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(df, k=k, percent=percent).collect()), key=str)
    assert got == want


def test_one_of_each_stays(spark, tmp_path):
    path = f"{tmp_path}/docs"
    frame(spark, corpus(), extra=True).write.parquet(path)
    df = spark.read.parquet(path)
    kept = keep_one_of_each(df, k=3, percent=90)
    assert kept.columns == df.columns
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    want = [(r.doc_id, r.component_id, r.n_shingles) for r in similar_components(df).collect()]
    groups = {c for d, c, n in want if n and d is not None}
    assert {d for d in got if d is not None} == groups | {d for d, _, n in want if not n and d is not None}
    assert len(got) == len(set(got))


def test_empty(spark):
    assert similar_components(empty(spark)).count() == 0


def test_blocks_smaller_than_a_batch(spark, monkeypatch):
    """Many blocks a batch and a bucket of many blocks: links across blocks are found, lower-casing reads its own rows."""
    from thalweg.llm import jaccard_join

    texts = [edited(prose(900 + i % 40, 200), i, 1).title() for i in range(160)]
    df = frame(spark, texts).coalesce(1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df).collect() if r.doc_id is not None}
    sets = [shingles(x, 3) for x in texts]
    linked = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    assert len(linked) > 100
    assert {i: (len(s), t) for i, (s, t) in enumerate(zip(sets, components(len(texts), linked), strict=True))} == {i: got[i] for i in range(len(texts))}
