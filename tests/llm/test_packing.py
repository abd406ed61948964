import random

from thalweg.llm.packing import best_fit, pack_documents, pack_pieces

from .common import empty, frame, odd_texts, prose


def brute(sizes, sources, clusters, capacity):
    """Tightest bin without conflict, by looking at all of them; returns the residuals after each step."""
    single = lambda values: {v for v in values if v is not None}  # noqa: E731, F841
    bins, trail = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [b for b in bins if b["left"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        b = min(fits, key=lambda b: b["left"], default=None)
        if b is None:
            b = {"left": capacity, "s": set(), "c": set()}
            bins.append(b)
        trail.append(b["left"])
        b["left"] -= n
        b["s"].add(s), b["c"].add(c)
    return trail


def test_tightest_compatible_bin():
    # all sources apart: the tightest residual is the same whichever of equal bins is taken
    r = random.Random(3)
    for _ in range(30):
        sizes = sorted((r.randint(1, 50) for _ in range(60)), reverse=True)
        clusters = [r.choice([None, None, *range(8)]) for _ in sizes]
        got = pack_pieces(sizes, [None] * len(sizes), clusters, 50)
        left, seen = {}, {}
        for n, c, b in zip(sizes, clusters, got, strict=True):
            residual = left.get(b, 50)
            better = [x for x, v in left.items() if n <= v < residual and (c is None or c not in seen[x])]
            assert not better and n <= residual and (c is None or c not in seen.get(b, set()))
            if b not in left:
                assert not [x for x, v in left.items() if v >= n and (c is None or c not in seen[x])]
            left[b] = residual - n
            seen.setdefault(b, set()).add(c)


def test_residuals_match_brute_force():
    r = random.Random(4)
    sizes = sorted((r.randint(1, 40) for _ in range(80)), reverse=True)
    got = pack_pieces(sizes, list(range(80)), list(range(80)), 40)
    left, trail = {}, []
    for n, b in zip(sizes, got, strict=True):
        trail.append(left.get(b, 40))
        left[b] = left.get(b, 40) - n
    assert trail == brute(sizes, list(range(80)), list(range(80)), 40)


def test_whole_documents(spark):
    texts = [*odd_texts(), *(prose(i, 10 + 7 * i) for i in range(40)), prose(99, 1234), prose(99, 1234)]
    docs = frame(spark, texts, extra=True)
    out = pack_documents(docs, capacity=200).collect()
    sizes = {i: len((t or "").split()) for i, t in enumerate(texts)}
    total, spans = {}, {}
    for r in out:
        if r.doc_id is not None:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            spans.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    last = frame(spark, texts).collect()[-1].doc_id
    for i, n in sizes.items():
        assert total[i] == n * (2 if i == last else 1) or "\x1c" in (texts[i] or "")
    fill = {}
    for r in out:
        if r.bin_id is not None:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
    assert max(fill.values()) <= 200
    assert all(r.bin_id is None for r in out if r.n_tokens == 0)
    assert pack_documents(empty(spark)).count() == 0


def test_hot_source_and_cluster(spark):
    rows = [(i, "src0" if i % 3 else f"s{i % 7}", 10 + i % 30, i % 5 if i % 2 else None) for i in range(500)]
    out = best_fit(spark.createDataFrame(rows, "id long, source string, tokens long, cluster long"), 100, 100).collect()
    info, seen = {r[0]: r for r in rows}, {}
    for r in out:
        key = seen.setdefault(r.bin, (set(), set()))
        _, s, _, c = info[r.id]
        assert s not in key[0] and (c is None or c not in key[1])
        key[0].add(s), key[1].add(c)
    assert len(out) == 500
