"""Substring dedup with repeated-phrase automata.

A window is ``width`` consecutive words of one text. A window whose word sequence
starts anywhere else too, in the same text or another, is recurring, and every
word that a recurring window covers is removed; windows are judged on the input.

1. Nominate. In every window the smallest hash of its ``GRAM``-word sequences is
   its anchor. Equal windows have equal anchors, so a window recurs only if its
   anchor occurs at two places. Anchors are about a fourteenth of all words.
2. Confirm. Only windows with such an anchor are hashed and counted.
3. Compile. Documents are dealt into shards of a few MB. The passages of a shard
   (its maximal runs of confirmed windows, each once, as text) are its dictionary.
   A dictionary is no larger than its shard.
4. Stream. The dictionary becomes one Aho-Corasick automaton of pyahocorasick over
   word numbers, and all documents of the shard run through it. Its hits are the only
   source of positions; the union of them is removed.

Counting is packed: a shard sends each bucket its distinct hashes as one binary
value, so a passage that a third of all documents share is one hash a shard, and
a bucket answers each shard with those that recur. A hash is one of 64 bits, and
a bucket's number is taken from bits of a second one.

The texts are shuffled once, by shard; all four passes read that exchange.

Results for the odd cases: null, empty and blank texts have 0 words, nothing
removed and an empty rest; texts shorter than a window lose nothing; repeated
rows are documents of their own, so their windows recur; extra columns stay where
``remove_repeats`` is used and are left out of ``repeat_spans``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import MIX2, Words, covered, give_back, inside, split, windows

WIDTH, GRAM = 35, 8
#: Text bytes in a shard.
SHARD = 4 << 20


def _least(x: np.ndarray, span: int, pick=np.minimum) -> np.ndarray:
    """Least (or, by ``pick``, greatest) of each ``span`` neighbours."""
    width = 1
    while width * 2 <= span:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = span - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(h: np.ndarray, whole: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Anchor of the window at each position; ``whole`` says which windows are inside a text."""
    return _least(windows(h, gram), width - gram + 1)[: len(whole)]


def anchor_places(h: np.ndarray, whole: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Hashes of all places that are the anchor of some window, one for each place."""
    g = windows(h, gram)
    span = width - gram + 1
    low = np.where(whole, _least(g, span), np.uint64(0))
    # a place is chosen if the greatest of the anchors of the windows that hold it is its own hash
    edge = np.zeros(span - 1, np.uint64)
    high = _least(np.concatenate((edge, low, edge)), span, np.maximum)
    return g[high[: len(g)] == g]


def pack(shard: int, keys: np.ndarray, buckets: int) -> list[tuple[int, int, bytes, bytes]]:
    """(bucket, shard, distinct keys, whether each is there more than once)."""
    if not len(keys):
        return []
    keys, count = np.unique(keys, return_counts=True)
    to = ((keys * MIX2) >> np.uint64(32)) % np.uint64(buckets)
    by = np.argsort(to, kind="stable")
    keys, many, to = keys[by], (count > 1)[by], to[by]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return [(int(to[i]), shard, keys[i:j].tobytes(), many[i:j].tobytes()) for i, j in zip(cuts, np.r_[cuts[1:], len(to)], strict=True)]


PACKED = "bucket int, shard long, keys binary, many binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])
_ANSWER = pa.schema([("shard", pa.int64()), ("keys", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def recurring(table: pa.Table) -> pa.Table:
    """For each shard those of its keys of a bucket that are at two places or more."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    many = np.concatenate([np.frombuffer(x, np.bool_) for x in table.column("many").to_pylist()])
    shard = table.column("shard").to_pylist()
    every = np.concatenate(keys)
    value, at = np.unique(every, return_inverse=True)
    twice = np.bincount(at, 1 + many, len(value)) > 1
    hit = twice[at]
    out, start = [], 0
    for s, x in zip(shard, keys, strict=True):
        mine = x[hit[start : start + len(x)]]
        start += len(x)
        if len(mine):
            out.append((s, mine.tobytes()))
    return _table(out, _ANSWER)


def among(values: np.ndarray, answer: pa.Table) -> np.ndarray:
    """Which of the values a shard's answers hold."""
    blobs = answer.column("keys").to_pylist()
    if not blobs or not len(values):
        return np.zeros(len(values), bool)
    known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs]))
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def passages(words: Words, starts: np.ndarray, width: int) -> dict[tuple[int, ...], int]:
    """Distinct maximal runs of confirmed windows as word numbers, with their lengths."""
    if not len(starts):
        return {}
    doc = words.doc[starts]
    fresh = np.r_[True, (np.diff(starts) != 1) | (np.diff(doc) != 0)]
    first = starts[fresh]
    last = starts[np.r_[fresh[1:], True]]
    codes = words.codes
    return {tuple(codes[a : b + width].tolist()): int(b - a) + width for a, b in zip(first, last, strict=True)}


def occurrences(words: Words, phrases: dict[tuple[int, ...], int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all occurrences of the phrases, found by one automaton."""
    import ahocorasick

    if not phrases:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for phrase, length in phrases.items():
        automaton.add_word(phrase, length)
    automaton.make_automaton()
    starts, lengths = [], []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        for end, length in automaton.iter(tuple(words.codes[a:b].tolist())) if b > a else ():
            starts.append(a + end - length + 1)
            lengths.append(length)
    return np.array(starts, np.int64), np.array(lengths, np.int64)


def dictionary(words: Words, starts: np.ndarray, width: int) -> bytes:
    """The passages of a shard as text, a line each."""
    vocab = words.vocab.to_pylist()
    return b"\n".join(b" ".join([vocab[c] for c in phrase]) for phrase in passages(words, starts, width))


def phrases_of(words: Words, lines: bytes) -> dict[tuple[int, ...], int]:
    """A dictionary's passages as word numbers of a block, with their lengths."""
    number = {w: c for c, w in enumerate(words.vocab.to_pylist())}
    found = [tuple([number[w] for w in x.split(b" ")]) for x in lines.split(b"\n")] if lines else []
    return {x: len(x) for x in found}


def _shards(df: DataFrame, text_col: str) -> int:
    """Two shards for each shuffle partition, and more for more text."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD)


def _scanned(docs: DataFrame, text_col: str, width: int, gram: int, finish, schema: T.StructType) -> DataFrame:
    """Runs the passes; ``finish(table, words, gone)`` makes the rows of a shard, of fields ``schema``.

    ``docs`` has its columns named c0, c1 ...; ``text_col`` is one of them.
    """
    spark = docs.sparkSession
    n = _shards(docs, text_col)
    shard = F.pmod(F.xxhash64(*docs.columns), F.lit(n)).alias("shard")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 2)
    dealt = docs.select(shard, *docs.columns).repartition(parts, "shard")

    def text(table: pa.Table) -> Words:
        give_back()
        return split(table.column(text_col).combine_chunks().cast(pa.large_string()))

    def nominate(table: pa.Table) -> pa.Table:
        words = text(table)
        whole = inside(words, width)
        keys = anchor_places(words.hashes(), whole, width, gram) if len(whole) else np.zeros(0, np.uint64)
        return _table(pack(table.column("shard")[0].as_py(), keys, parts), _PACKED)

    def confirm(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _PACKED)
        words = text(table)
        whole, h = inside(words, width), words.hashes()
        keys = np.zeros(0, np.uint64)
        if len(whole) and answer.num_rows:
            at = np.flatnonzero(whole)
            at = at[among(anchors(h, whole, width, gram)[at], answer)]
            keys = windows(h, width)[at]
        return _table(pack(table.column("shard")[0].as_py(), keys, parts), _PACKED)

    def compiled(table: pa.Table, answer: pa.Table) -> pa.Table:
        lines = b""
        if table.num_rows and answer.num_rows:
            words = text(table)
            at = np.flatnonzero(inside(words, width))
            lines = dictionary(words, at[among(windows(words.hashes(), width)[at], answer)], width)
        return _table([(table.column("shard")[0].as_py(), lines)] if lines else [], _ANSWER)

    def locate(table: pa.Table, known: pa.Table) -> pa.Table:
        words = text(table)
        phrases = phrases_of(words, known.column("keys")[0].as_py()) if known.num_rows else {}
        return finish(table, words, covered(*occurrences(words, phrases), len(words.codes)))

    def answers(packed: DataFrame) -> DataFrame:
        return packed.groupBy("bucket").applyInArrow(recurring, "shard long, keys binary")

    by_shard = dealt.groupBy("shard")
    first = answers(by_shard.applyInArrow(nominate, PACKED))
    second = answers(by_shard.cogroup(first.groupBy("shard")).applyInArrow(confirm, PACKED))
    third = by_shard.cogroup(second.groupBy("shard")).applyInArrow(compiled, "shard long, keys binary")
    return by_shard.cogroup(third.groupBy("shard")).applyInArrow(locate, schema)


def _named(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    names = {c: f"c{k}" for k, c in enumerate(columns)}
    return docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()]), names


def _kept_texts(words: Words, gone: np.ndarray) -> list[str]:
    vocab = words.vocab.to_pylist()
    left = np.flatnonzero(~gone)
    cuts = np.searchsorted(left, words.offsets)
    codes = words.codes[left].tolist()
    return [b" ".join([vocab[c] for c in codes[a:b]]).decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of every row: removed spans as [first, last] word numbers, and the words left, joined by a space."""
    rows, names = _named(docs, [id_col, text_col])
    fields = T.StructType([T.StructField(id_col, rows.schema["c0"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType())])

    def finish(table: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
        upto = np.r_[0, np.cumsum(gone)]
        doc = words.doc
        edge = gone & ~(np.r_[False, gone[:-1]] & np.r_[False, doc[1:] == doc[:-1]]) if len(gone) else gone
        stop = gone & ~(np.r_[gone[1:], False] & np.r_[doc[1:] == doc[:-1], False]) if len(gone) else gone
        base = words.offsets[:-1][doc] if len(doc) else doc
        pairs = np.stack([np.flatnonzero(edge) - base[edge], np.flatnonzero(stop) - base[stop]], axis=1).tolist()
        cuts = np.searchsorted(doc[edge], np.arange(len(words.offsets))) if len(gone) else np.zeros(len(words.offsets), np.int64)
        spans = [pairs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({
            id_col: table.column("c0"), "n_words": words.lengths, "n_removed": upto[words.offsets[1:]] - upto[words.offsets[:-1]],
            "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(_kept_texts(words, gone), pa.string()),
        })

    return _scanned(rows, names[text_col], width, gram, finish, fields)


def remove_repeats(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """All rows and columns; a text with recurring windows becomes its other words, joined by a space, and ``size_col`` its code points."""
    rows, names = _named(docs, docs.columns)
    size = names.get(size_col or "")

    def finish(table: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
        upto = np.r_[0, np.cumsum(gone)]
        hit = upto[words.offsets[1:]] > upto[words.offsets[:-1]]
        kept = _kept_texts(words, gone)
        text = [k if h else t for k, h, t in zip(kept, hit.tolist(), table.column(names[text_col]).to_pylist(), strict=True)]
        out = {x: table.column(x) for x in names.values()}
        out[names[text_col]] = pa.array(text, table.schema.field(names[text_col]).type)
        if size:
            out[size] = pa.array([len(k) if h else s for k, h, s in zip(kept, hit.tolist(), table.column(size).to_pylist(), strict=True)], table.schema.field(size).type)
        return pa.table({c: out[x] for c, x in names.items()})

    return _scanned(rows, names[text_col], width, gram, finish, docs.schema)


def kept_digest(kept: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the words left."""
    return F.sha2(F.encode(kept, "UTF-8"), 256)
