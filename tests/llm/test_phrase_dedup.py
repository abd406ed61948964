import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from thalweg.llm.phrase_dedup import dictionary, kept_digest, occurrences, phrases_of, remove_repeats, repeat_spans
from thalweg.llm.words import covered, inside, split

from .common import empty, frame, odd_texts, prose

SHARED = prose(900, 60)


def corpus():
    texts = [*odd_texts(), f"{prose(1000, 80)} {SHARED} {prose(1001, 70)}", f"{SHARED} {prose(1002, 90)}", f"{prose(1003, 40)} {' '.join(SHARED.split()[10:45])}", f"{prose(1004, 40)} {' '.join(SHARED.split()[10:44])} {prose(1005, 5)}"]
    texts += ["loop " * 80, prose(1006, 35), prose(1006, 35), prose(1007, 34), prose(1007, 34)]
    long = prose(1008, 500)
    return [*texts, long, " ".join(w if i % 60 else f"e{i}" for i, w in enumerate(long.split()))]


def brute(texts, width):
    words = [(t or "").replace("\x1c", "\0fs\0").split() for t in texts]
    words = [[w.replace("\0fs\0", "\x1c") for w in ws] for ws in words]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize(("width", "gram"), [(35, 8), (12, 5)])
def test_against_brute_force(spark, width, gram):
    df = frame(spark, corpus(), extra=True)
    rows = df.select("doc_id", "text").collect()
    want = sorted(zip([str(r.doc_id) for r in rows], brute([r.text for r in rows], width), strict=True))
    out = repeat_spans(df, width=width, gram=gram)
    got = out.withColumn("sha", kept_digest(out["kept"])).collect()
    assert sorted((str(r.doc_id), (r.n_words, r.n_removed, r.kept)) for r in got) == want
    assert all(r.sha == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
    assert all(sum(b - a + 1 for a, b in r.spans) == r.n_removed for r in got)


def test_rows_and_columns_stay(spark):
    df = frame(spark, corpus(), extra=True)
    out = remove_repeats(df)
    assert out.columns == df.columns and out.schema == df.schema
    before, after = {r.doc_id: r for r in df.collect()}, {r.doc_id: r for r in out.collect()}
    assert out.count() == df.count()
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and all(after[i].n_chars == len(after[i].text) for i in changed)
    assert all(before[i] == after[i] for i in before if i not in changed)


def test_empty(spark):
    assert repeat_spans(empty(spark)).count() == 0 and remove_repeats(empty(spark)).count() == 0


def test_automaton_gives_the_positions():
    """What is removed comes from the dictionary alone: without it nothing is found."""
    words = split(pa.array([SHARED, f"{prose(1, 9)} {SHARED}", prose(2, 50), None, ""]))
    starts = np.flatnonzero(inside(words, 35))
    starts = starts[words.doc[starts] == 0]  # confirmed in the first text only
    lines = dictionary(words, starts, 35)
    assert lines.decode() == SHARED
    gone = covered(*occurrences(words, phrases_of(words, lines)), len(words.codes))
    assert gone[:60].all() and not gone[60:69].any() and gone[69:129].all() and not gone[129:].any()
    assert not covered(*occurrences(words, phrases_of(words, b"")), len(words.codes)).any()
