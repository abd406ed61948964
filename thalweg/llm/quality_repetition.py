"""Quality rules on repetition: suffix arrays and longest-common-prefix intervals.

The texts of a block are one array of word codes. Prefix doubling sorts all
suffixes of it at once; a text's number is the leading digit of the first key, so
suffixes of two texts never tie, and only suffixes that still tie are sorted
again. The class of each position at each doubling step gives the longest common
prefix of neighbours, high bit first. Intervals of the suffix array with one
common prefix are the repeated word sequences; those whose occurrences follow
different words are the maximal repeats. Every occurrence spans as many words as
the deepest maximal interval that holds it; the union of these spans, of repeats
of ``min_words`` words or more, must stay within ``max_covered`` of a text's
words, and the longest of them within ``max_longest`` words. (Repeats that are not maximal
lie in the spans of maximal ones.)

Results for the odd cases: null, empty and blank texts have 0 words, base_failed
true and kept false; every row, repeated ones included, gives one row; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import Words, covered, slices, split, texts_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_COVERED, MAX_LONGEST = 10, 0.3, 200


def suffix_array(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a block, and the common prefix of each suffix with the one before it (0 at the first)."""
    n = len(words.codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.repeat(words.offsets[1:], words.lengths)
    first = words.doc * np.int64(len(words.vocab)) + words.codes
    sa = np.argsort(first)
    fresh = np.r_[True, np.diff(first[sa]) != 0]
    slot = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[sa] = slot
    levels = [rank.copy()]
    tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))  # slots of classes with two members or more
    step = 1
    while len(tied):
        at = sa[tied]
        then = at + step
        key = rank[at].astype(np.int64) * (n + 1) + np.where(then < end[at], rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        sa[tied] = at  # a class keeps its slots
        fresh = np.r_[True, np.diff(key) != 0]
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        levels.append(rank.copy())
        tied = tied[~(fresh & np.r_[fresh[1:], True])]
        step *= 2
    lcp = np.zeros(n, np.int64)
    deep = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[deep - 1], sa[deep]
    same = np.zeros(len(deep), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + same, b + same
        fits = (i < end[a]) & (j < end[b])
        same += (fits & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])) * (1 << k)
    lcp[deep] = same
    return sa, lcp


def intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """(left, right, length) of every interval whose common prefix is ``least`` or longer."""
    found: list[tuple[int, int, int]] = []
    deep = np.flatnonzero(lcp >= least)
    stack: list[tuple[int, int]] = []  # (left, length), lengths rising
    last = -2
    for k, length in zip(deep.tolist(), lcp[deep].tolist(), strict=True):
        if k != last + 1:
            found.extend((left, last, size) for left, size in stack)
            stack = []
        left = k - 1
        while stack and stack[-1][1] > length:
            left, size = stack.pop()
            found.append((left, k - 1, size))
        if not stack or stack[-1][1] < length:
            stack.append((left, length))
        last = k
    found.extend((left, last, size) for left, size in stack)
    return np.array(found, np.int64).reshape(-1, 3)


def maximal_repeats(words: Words, sa: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Intervals whose occurrences do not all follow the same word."""
    found = intervals(lcp, least)
    if not len(found):
        return found
    starts = np.zeros(len(words.codes), bool)
    starts[words.offsets[:-1][words.lengths > 0]] = True
    before = np.where(starts[sa], -1 - np.arange(len(sa)), words.codes[sa - 1])
    turns = np.cumsum(np.r_[0, before[1:] != before[:-1]])
    return found[turns[found[:, 1]] > turns[found[:, 0]]]


def spans_of(found: np.ndarray, n: int) -> np.ndarray:
    """For each of n slots of the suffix array the length of the deepest of the (nested) intervals that hold it, or 0."""
    at, length, open_ends = [0], [0], [(n, 0)]
    for left, right, size in found[np.lexsort((-found[:, 1], found[:, 0]))].tolist():
        while open_ends[-1][0] <= left:
            at.append(open_ends.pop()[0])
            length.append(open_ends[-1][1])
        open_ends.append((right + 1, size))
        at.append(left)
        length.append(size)
    while len(open_ends) > 1:
        at.append(open_ends.pop()[0])
        length.append(open_ends[-1][1])
    return np.repeat(np.array(length, np.int64), np.diff(at, append=n))


def repetition(words: Words, least: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Per text: words covered by repeats of 3 words, by maximal ones of ``least``, the longest repeat, and the number of maximal ones."""
    n, texts = len(words.codes), len(words.offsets) - 1
    sa, lcp = suffix_array(words)
    doc = words.doc
    # an occurrence of a 3-word window that is there twice shares three words with a neighbour
    near = np.zeros(n, np.int64)
    near[sa] = np.maximum(lcp, np.r_[lcp[1:], 0]) if n else 0
    at = np.flatnonzero(near >= 3)
    out = {"n_repeat_words": np.bincount(doc[covered(at, near[at], n)], minlength=texts).astype(np.int64)}
    # the spans of the maximal repeats
    found = maximal_repeats(words, sa, lcp, least)
    reach = np.zeros(n, np.int64)
    reach[sa] = spans_of(found, n)
    at = np.flatnonzero(reach)
    out["n_covered"] = np.bincount(doc[covered(at, reach[at], n)], minlength=texts).astype(np.int64)
    longest, short = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    np.maximum.at(longest, doc, reach)
    np.maximum.at(short, doc, near)
    out["longest_repeat"] = np.where(longest > 0, longest, short)  # below ``least`` words there are no intervals
    out["n_maximal_repeats"] = np.bincount(doc[sa[found[:, 0]]], minlength=texts).astype(np.int64)
    return out


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat, n_maximal_repeats, base_failed, kept) of every text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_maximal_repeats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            text = texts_of(b.column(1))
            words = split(text)
            got = repetition(words, min_words) | {"n_words": words.lengths}
            got["word_chars"] = pc.utf8_length(text).to_numpy() - pc.count_substring_regex(text, r"[ \t\n\v\f\r]").to_numpy()
            got["n_symbols"] = pc.count_substring_regex(text, r"[#*$%&|<>]").to_numpy()
            got["n_dup_lines"] = np.fromiter(map(duplicate_lines, text.to_pylist()), np.int64, len(text))
            n = got["n_words"]
            failed = (n < 50) | (100 * got["n_repeat_words"] > 50 * n)
            kept = ~failed & (got["n_covered"] <= max_covered * n) & (got["longest_repeat"] <= max_longest)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[x].astype(np.int64)) for x in names), pa.array(failed), pa.array(kept)], [id_col, *names, "base_failed", "kept"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {', '.join(f'{x} long' for x in names)}, base_failed boolean, kept boolean")
