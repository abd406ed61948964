"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items and documents are compared as words, lower-cased and without
punctuation. The seeds of an item are its ``SEED``-word n-grams but those that are
common: a first pass counts over all documents in how many texts each n-gram is,
and one is common if that is over ``FEW``, over ``RARE`` of all texts, and over four
times the median of its item's n-grams that are in any text. (An item that itself
leaked widely, as it is or edited, has a high median and keeps its seeds.) In a second pass seeds join documents to items. Around each run
of hits a local alignment of the item's words with the passage, +2 for a match, -1
for another word or a gap, gives a score as a share of a perfect one; pairs of
``LEAST`` or more are reported. Before aligning, passages that hold too few of the
item's words for that score are left out, which loses nothing.

Items are taken in blocks of ``ITEM_BYTES`` of text, each against all documents, so
what is broadcast has a bound however many items there are.

Results for the odd cases: null or empty texts match nothing; items of fewer than
``SEED`` words are not looked for; repeated rows of documents or items are reported
for each; other columns are left out (``drop_contaminated`` keeps all columns and
rows that match nothing, whatever their identifiers).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, inside, slices, split, texts_of, windows

SEED, FEW, RARE, LEAST = 3, 64, 0.001, 0.5
ITEM_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK = 4 << 20


class Items(NamedTuple):
    """A block of test items."""

    ids: pa.Array
    words: list[np.ndarray]  #: hashes of each item's words
    seeds: np.ndarray  #: sorted distinct hashes of n-grams
    heads: np.ndarray  #: of each seed's places in the two below
    item: np.ndarray
    place: np.ndarray


def normal(column: pa.Array) -> Words:
    text = pc.replace_substring_regex(pc.utf8_lower(texts_of(column)), r"[^\p{L}\p{N}\s]+", "")
    return split(text)


def items_of(ids: pa.Array, texts: pa.Array) -> Items:
    words = normal(texts)
    h = words.hashes()
    fits = inside(words, SEED)
    gram, doc = windows(h, SEED)[: len(fits)][fits], words.doc[: len(fits)][fits]
    place = (np.arange(len(fits)) - words.offsets[:-1][words.doc[: len(fits)]])[fits]
    by = np.argsort(gram, kind="stable")
    seeds, first = np.unique(gram[by], return_index=True)
    return Items(ids, [h[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)], seeds, np.r_[first, len(by)], doc[by], place[by])


def without_common(items: Items, texts: np.ndarray, limit: float) -> Items:
    """The items without the seeds that too many texts have."""
    each = texts[np.repeat(np.arange(len(items.seeds)), np.diff(items.heads))]
    keep = np.zeros(len(each), bool)
    for i in np.unique(items.item):
        mine = np.flatnonzero(items.item == i)
        there = each[mine][each[mine] > 0]
        if len(there):
            keep[mine] = (each[mine] > 0) & (each[mine] <= max(limit, FEW, 4 * np.median(there)))
    seed = np.repeat(np.arange(len(items.seeds)), np.diff(items.heads))[keep]
    left, first = np.unique(seed, return_index=True)
    return items._replace(seeds=items.seeds[left], heads=np.r_[first, len(seed)], item=items.item[keep], place=items.place[keep])


def hits(words: Words, h: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words where a seed begins, and the seed's number."""
    fits = inside(words, SEED)
    gram = windows(h, SEED)[: len(fits)]
    if not len(items.seeds) or not len(gram):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(items.seeds, gram), len(items.seeds) - 1)
    found = np.flatnonzero(fits & (items.seeds[at] == gram))
    return found, at[found]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the position in the passage where it ends."""
    n = len(passage)
    steps = GAP * np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new - steps) + steps  # gaps along the row
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def matches(words: Words, items: Items, least: float) -> list[tuple[int, int, float, int]]:
    """(text, item, score, last word) of each pair that aligns well."""
    h = words.hashes()
    position, seed = hits(words, h, items)
    if not len(position):
        return []
    count = np.diff(items.heads)[seed]
    each = np.repeat(np.arange(len(seed)), count)
    entry = items.heads[seed][each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    item, place, at = items.item[entry], items.place[entry], position[each]
    doc = words.doc[at]
    size = np.array([len(w) for w in items.words])
    by = np.lexsort((at, item, doc))
    item, place, at, doc = item[by], place[by], at[by], doc[by]
    # hits of one item in one text, further apart than the item is long, are runs of their own
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * size[item[1:]])])
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
        i, d = int(item[a]), int(doc[a])
        mine, n = items.words[i], int(size[i])
        slack = n // 2
        low = max(int(words.offsets[d]), int((at[a:b] - place[a:b]).min()) - slack)
        high = min(int(words.offsets[d + 1]), int((at[a:b] - place[a:b]).max()) + n + slack)
        passage = h[low:high]
        if np.isin(mine, passage).sum() < least * n:  # a score is at most two for each of the item's words that are there
            continue
        score, end = align(mine, passage)
        share = score / (MATCH * n)
        if share >= least and share > best.get((d, i), (0.0, 0))[0]:
            best[d, i] = (share, low + end - int(words.offsets[d]))
    return [(d, i, s, e) for (d, i), (s, e) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, docs: DataFrame, item_col: str, item_text: str, text_col: str) -> Iterator[Items]:
    """The items in blocks, their common seeds taken out."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    total = docs.count()
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        items = items_of(got.column("id").combine_chunks(), got.column("text").combine_chunks())
        sent = spark.sparkContext.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col, BLOCK):
                words = normal(b.column(0))
                at, seed = hits(words, words.hashes(), sent.value)
                n = len(sent.value.seeds)
                each = np.unique(words.doc[at] * np.int64(max(n, 1)) + seed)
                seed, times = np.unique(each % max(n, 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(times)], ["seed", "n"])

        counted = docs.select(text_col).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        texts = np.zeros(len(items.seeds), np.int64)
        texts[counted.column("seed").to_numpy()] = counted.column("n").to_numpy()
        yield without_common(items, texts, RARE * total)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(id, item, score, last_word) of every document and item that align with ``least`` of a perfect score or more."""
    rows = docs.select(id_col, text_col)
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    id_kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_kind}, `{item_col}` {item_kind}, score double, last_word long"
    out = None
    for items in item_blocks(benchmark, rows, item_col, item_text, text_col):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col, BLOCK):
                found = matches(normal(b.column(1)), sent.value, least)
                d, i = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(d), sent.value.ids.take(i), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.int64())], [id_col, item_col, "score", "last_word"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows, with all their columns, that no test item aligns with."""
    out = docs
    for items in item_blocks(benchmark, docs, item_col, item_text, text_col):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col, BLOCK):
                clean = np.ones(b.num_rows, bool)
                clean[[x[0] for x in matches(normal(b.column(text_col)), sent.value, least)]] = False
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
