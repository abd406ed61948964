"""Class-conditional Kneser-Ney models over the whole vocabulary: every word and every word pair of the counted texts.

    P(w | h) = max(c(h, w) - D2, 0) / c(h .) + rest(h) * P(w)
    P(w)     = max(c(w) - D1, 0) / N + rest * S(w)

for each of two classes; c counts texts, c(h .) sums over what follows h, and S(w)
is the share of all pairs of either class that end in w, the same for both. A word
that was counted nowhere has the smallest S. D2 is 1, so a pair that one text of a
class has takes part by what it leaves to P(w) and by S. No word, pair or text is
left out, and nothing depends on the size of the input.

Both classes' log ratio of a text is a sum over its words and pairs, for S cancels
where nothing was counted: each counted word and each pair with a part of its own
has one value. Counts and values are packed by ranges of hashes. A block of texts
sends its distinct keys, with the texts that have them, to the ranges of the values,
and gets a sum a text from each: texts don't move, and the table of values is not
broadcast. Two things of bounded size spare sending without changing a sum: the
values of the most frequent words and pairs are at hand for every block, and a Bloom
filter of the others keeps most words and pairs without a value back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_of, passing
from .shared import discard, written
from .words import MIX1, MIX2, Words, give_back, scramble, slices, split

D1, D2 = 0.75, 1.0
BLOCK = 8 << 20
#: Ranges of keys in which words and pairs meet. Each block of texts gets a number a text from each.
RANGES = 32
#: Bits of a hash that a block of texts doesn't send; 56 are compared.
UNSENT = np.uint64(8)
#: Values at hand for every block; the others are met by range.
OFTEN = 1 << 18


class WholeModel(NamedTuple):
    values: DataFrame  #: (often, bucket, keys, values, n): log ratios of words, less an unknown word's, and of pairs
    often: tuple[np.ndarray, np.ndarray]  #: keys and values of the most frequent
    others: np.ndarray  #: Bloom filter of the other keys
    unknown: float  #: log ratio of a word that was not counted


def packed(x: np.ndarray) -> bytes:
    """Bytes of like place together, so that high bytes that are 0 take no room."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def read(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T).view(kind).ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def read_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(read(data, n, np.uint64), dtype=np.uint64)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)


def spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which ``word_counts`` has a word."""
    with np.errstate(over="ignore"):
        return (((keys * MIX2) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scramble(h * MIX1 + w)


def spans(sorted_ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(id, from, to) of the runs of equal ids."""
    if not len(sorted_ids):
        return []
    cuts = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    return list(zip(sorted_ids[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(sorted_ids)], strict=True))


def keys_of(words: Words) -> np.ndarray:
    return Words(np.arange(len(words.vocab), dtype=np.int32), words.vocab, words.offsets[:0]).hashes()


def places_of_pairs(words: Words) -> np.ndarray:
    """Positions whose next word is of the same text."""
    return np.flatnonzero(words.doc[1:] == words.doc[:-1])


def batch(rows: list[dict], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


PAIRS = "bucket int, n_h long, h binary, followers binary, n_w long, w binary, n long, at binary, toxic binary, plain binary"
PARTS = "kind int, bucket int, n long, total long, k binary, w binary, x binary"
VALUES = "often int, bucket int, keys binary, values binary, n long"
ASKED = "kind int, bucket int, block long, texts long, n long, m long, k binary, u binary, c binary"
ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
fields = lambda schema: [(c.split()[0], ARROW[c.split()[1]]) for c in schema.split(", ")]


def partial_pairs(rows: DataFrame, buckets: int) -> DataFrame:
    """Of every block of ``rows`` (text, toxic), its distinct pairs and the texts of both classes that have each, by ranges of h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK):
            words = split(b.column(0))
            at = places_of_pairs(words) if len(words.codes) else np.zeros(0, np.int64)
            if not len(at):
                continue
            v = np.int64(len(words.vocab))
            pairs, code = np.unique(words.codes[at] * v + words.codes[at + 1], return_inverse=True)
            n = np.int64(len(pairs))
            once = np.unique(words.doc[at] * n + code)
            toxic = b.column(1).to_numpy(zero_copy_only=False)[once // n]
            t, p = (np.bincount((once % n)[on], minlength=n).astype(np.uint32) for on in (toxic, ~toxic))
            keys = keys_of(words)
            h, w = keys[pairs // v], keys[pairs % v]
            by = np.argsort(h, kind="stable")
            h, w, t, p = h[by], w[by], t[by], p[by]
            out = []
            for bucket, i, j in spans(range_of(h, buckets)):
                own = spans(h[i:j])
                ends, places = np.unique(w[i:j], return_inverse=True)
                out.append(
                    {"bucket": bucket, "n_h": len(own), "h": packed_sorted(np.array([x for x, _, _ in own], np.uint64)), "followers": packed(np.array([y - x for _, x, y in own], np.uint32))}
                    | {"n_w": len(ends), "w": packed_sorted(ends), "n": j - i, "at": packed(places.astype(np.uint32)), "toxic": packed(t[i:j]), "plain": packed(p[i:j])}
                )
            yield batch(out, fields(PAIRS))
            give_back()

    return rows.select("text", "toxic").mapInArrow(run, PAIRS)


def pair_parts(rows: DataFrame, buckets: int, words_in: int) -> DataFrame:
    """What the words need to know of all pairs, by the words' buckets.

    Kind 1: the log ratio of what a word leaves as context. Kind 2: how many words
    it follows. Kind 3: pairs with a part of their own, by their second word: both
    classes' counts of the pair, of all that follows the first word, and of how many words follow it.
    """

    def merge(table: pa.Table) -> pa.Table:
        hs, ws, ts, ps = [], [], [], []
        for r in table.to_pylist():
            hs.append(np.repeat(read_sorted(r["h"], r["n_h"]), read(r["followers"], r["n_h"], np.uint32)))
            ws.append(read_sorted(r["w"], r["n_w"])[read(r["at"], r["n"], np.uint32)])
            ts.append(read(r["toxic"], r["n"], np.uint32))
            ps.append(read(r["plain"], r["n"], np.uint32))
        h, w, t, p = map(np.concatenate, (hs, ws, ts, ps))
        key = pair_keys(h, w)
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, h, w = key[first], h[by][first], w[by][first]
        t, p = (np.add.reduceat(x[by].astype(np.int64), first) for x in (t, p))
        contexts, of = np.unique(h, return_inverse=True)
        after = [np.bincount(of, c, len(contexts)) for c in (t, p)]
        kinds = [np.bincount(of, c > 0, len(contexts)) for c in (t, p)]
        ends, follows = np.unique(w, return_counts=True)
        out = []

        def put(kind: int, k: np.ndarray, x: np.ndarray, dealt: np.ndarray) -> None:
            to = spread(dealt, words_in)
            order = np.argsort(to, kind="stable")
            for bucket, i, j in spans(to[order]):
                on = order[i:j]
                out.append({"kind": kind, "bucket": bucket, "n": len(on), "total": int(x[on].sum()) if kind == 2 else len(on), "k": packed_sorted(k[on]), "w": b"", "x": packed(x[on].T.ravel())})
                if kind == 3:  # its second words once, and their places among these
                    words, at = np.unique(dealt[on], return_inverse=True)
                    out[-1] |= {"total": len(words), "w": packed_sorted(words), "x": packed(np.r_[x[on].T.ravel(), at.astype(np.uint32)])}

        b = np.log(left_by(after[0], kinds[0]) / left_by(after[1], kinds[1]))
        on = b != 0
        put(1, contexts[on], b[on], contexts[on])
        put(2, ends, follows.astype(np.uint32), ends)
        own = (t > D2) | (p > D2)
        put(3, key[own], np.stack([t, p, *(x[of] for x in (*after, *kinds))], axis=1)[own].astype(np.uint32), w[own])
        return pa.Table.from_batches([batch(out, fields(PARTS))])

    return written(partial_pairs(rows, buckets).groupBy("bucket").applyInArrow(merge, PARTS), "pair-parts")


def left_by(every: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """What a context leaves to P(w): D2 of each of the kinds that follow it, all where none does."""
    return np.where(every > 0, D2 * kinds / np.maximum(every, 1), 1.0)


def looked_up(known: np.ndarray, values: np.ndarray, keys: np.ndarray, otherwise: float) -> np.ndarray:
    """The values of keys among the sorted ``known``."""
    if not len(known):
        return np.full(len(keys), otherwise)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], otherwise)


def fit_whole(rows: DataFrame, words: DataFrame, words_in: int) -> WholeModel:
    """Model of ``rows`` (text, toxic). ``words`` has their words' counts in a multiple of ``words_in`` buckets."""
    spark = rows.sparkSession

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, p = (np.concatenate([np.frombuffer(x, np.uint32) for x in b.column(c).to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64) for c in ("toxic", "plain"))
            yield batch([{"t": int(t.sum()), "p": int(p.sum()), "lt": float(np.minimum(t, D1).sum()), "lp": float(np.minimum(p, D1).sum()), "v": len(t)}], [("t", pa.int64()), ("p", pa.int64()), ("lt", pa.float64()), ("lp", pa.float64()), ("v", pa.int64())])

    total = words.select("toxic", "plain").mapInArrow(sums, "t long, p long, lt double, lp double, v long").groupBy().sum().toDF("t", "p", "lt", "lp", "v").first()
    left = (total.lt / total.t, total.lp / total.p)
    unknown = math.log(left[0] / left[1])
    parts = pair_parts(rows, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / 2), words_in)
    counts = {r.kind: r.total for r in parts.groupBy("kind").agg(F.sum("total").alias("total")).collect()}
    shared = counts.get(2, 0) + 0.5 * (total.v + 1)

    def value(table: pa.Table) -> pa.Table:
        got = {kind: [] for kind in range(4)}
        for r in table.to_pylist():
            if r["kind"] == 0:
                got[0].append((np.frombuffer(r["k"], np.uint64), np.frombuffer(r["w"], np.uint32), np.frombuffer(r["x"], np.uint32)))
            else:
                x = read(r["x"], r["n"] * (7 if r["kind"] == 3 else 1), np.float64 if r["kind"] == 1 else np.uint32).reshape(-1, r["n"]).T
                got[r["kind"]].append((read_sorted(r["k"], r["n"]), read_sorted(r["w"], r["total"])[x[:, 6]] if r["kind"] == 3 else None, x[:, :6]))
        column = lambda kind, i, empty=np.uint64: np.concatenate([x[i] for x in got[kind]]) if got[kind] else np.zeros(0, empty)
        keys = column(0, 0)
        by = np.argsort(keys)
        keys, t, p = keys[by], column(0, 1, np.uint32)[by].astype(np.float64), column(0, 2, np.uint32)[by].astype(np.float64)
        ends, at = np.unique(column(2, 0), return_inverse=True)
        follows = looked_up(ends, np.bincount(at, column(2, 2, np.uint32).ravel(), len(ends)), keys, 0.0)
        contexts = column(1, 0)
        by = np.argsort(contexts)
        context = looked_up(contexts[by], column(1, 2, np.float64).ravel()[by], keys, 0.0)
        s = (follows + 0.5) / shared
        both = [np.maximum(c - D1, 0) / n + x * s for c, n, x in ((t, total.t, left[0]), (p, total.p, left[1]))]
        own = np.log(both[0] / both[1])
        second, x = column(3, 1), column(3, 2, np.uint32).reshape(-1, 6).astype(np.float64)
        at = np.searchsorted(keys, second)
        rest = [left_by(x[:, 2 + i], x[:, 4 + i]) for i in (0, 1)]
        parts = [np.maximum(x[:, i] - D2, 0) / np.maximum(x[:, 2 + i], 1) + rest[i] * both[i][at] for i in (0, 1)]
        pairs = np.log(parts[0] / parts[1]) - own[at] - np.log(rest[0] / rest[1])
        keys, values, texts = np.r_[keys, column(3, 0)], np.r_[own + context - unknown, pairs].astype(np.float32), np.r_[t + p, x[:, 0] + x[:, 1]]
        often = np.zeros(len(keys), bool)
        often[np.argsort(-texts, kind="stable")[: OFTEN // words_in]] = True
        out = []
        for flag in (True, False):
            by = np.flatnonzero(often == flag)
            by = by[np.argsort(keys[by])]
            k, v = keys[by], values[by]
            out += [{"often": int(flag), "bucket": r, "keys": packed_sorted(k[i:j]), "values": packed(v[i:j]), "n": j - i} for r, i, j in spans(range_of(k, RANGES))]
        return pa.Table.from_batches([batch(out, fields(VALUES))])

    zero = F.lit(0).cast("long")
    every = words.select(F.lit(0).alias("kind"), (F.col("bucket") % words_in).alias("bucket"), zero.alias("n"), zero.alias("total"), F.col("keys").alias("k"), F.col("toxic").alias("w"), F.col("plain").alias("x"))
    values = written(every.unionByName(parts).groupBy("bucket").applyInArrow(value, VALUES), "values")
    discard(parts)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(read_sorted(k, n).view(np.int64))], ["k"])

    others = values.where("often = 0")
    n = others.agg(F.sum("n").alias("n")).first().n or 0
    bits = min(28, max(24, math.ceil(math.log2(8 * max(1, n)))))
    held = values.where("often = 1").select("keys", "values", "n").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(read_sorted(r["keys"], r["n"]) for r in held)])
    by = np.argsort(keys)
    often = (keys[by], np.concatenate([np.zeros(0, np.float32), *(read(r["values"], r["n"], np.float32) for r in held)])[by])
    return WholeModel(others, often, bloom_of(others.select("keys", "n").mapInArrow(unpack, "k long"), bits), unknown)


def asked(rows: DataFrame, model: WholeModel) -> DataFrame:
    """Of every block of ``rows`` (th, text): its texts' hashes and sums of frequent values (kind 2), and by range the other keys and who has each how often (kind 1)."""
    sent = rows.sparkSession.sparkContext.broadcast((*model.often, model.others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches, "text", BLOCK)):
            block, m = (task << 32) + k, np.int64(b.num_rows)
            words = split(b.column("text"))
            out = [{"kind": 2, "bucket": (task + k) % RANGES, "block": block, "texts": b.num_rows, "n": 0, "m": 0, "k": b.column("th").to_numpy().tobytes()}]
            sums = np.zeros(b.num_rows)
            if len(words.codes):
                known, values, bloom = sent.value
                doc, at = words.doc, places_of_pairs(words)
                word = keys_of(words)
                pair, of = np.unique(pair_keys(word[words.codes[at]], word[words.codes[at + 1]]), return_inverse=True)
                left = []
                for keys, code, d in ((word, words.codes, doc), (pair, of, doc[at])):
                    v = looked_up(known, values, keys, np.nan)
                    ask = np.isnan(v)
                    sums += np.bincount(d, np.where(ask, 0.0, v)[code], b.num_rows)
                    ask[ask] = passing(bloom, keys[ask].view(np.int64))
                    on = ask[code]
                    left.append((keys, ask, code[on], d[on]))
                every = np.unique(np.concatenate([keys[ask] for keys, ask, _, _ in left]))
                u, c = np.unique(np.concatenate([np.searchsorted(every, keys)[code] * m + d for keys, _, code, d in left]), return_counts=True)
                cuts = spans(range_of(every, RANGES))
                ends = [0, *np.searchsorted(u, [j * m for _, _, j in cuts]).tolist()]
                for (bucket, i, j), x, y in zip(cuts, ends, ends[1:], strict=False):
                    out.append({"kind": 1, "bucket": bucket, "block": block, "texts": b.num_rows, "n": j - i, "m": y - x, "k": packed_sorted(every[i:j] >> UNSENT), "u": packed_sorted((u[x:y] - i * m).astype(np.uint64)), "c": packed(c[x:y].astype(np.uint32))})
            out[0]["u"] = sums.tobytes()
            yield batch(out, fields(ASKED))
            give_back()

    return rows.select("th", "text").mapInArrow(run, ASKED)


def whole_ratios(rows: DataFrame, model: WholeModel) -> DataFrame:
    """(th, whole): the texts' sums over their words and pairs, an unknown word counting 0. ``th`` is a hash of ``text``."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, keys, values = None, [], None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["kind"] == 2:
                    out += [{"block": r["block"], "bucket": -2, "sums": r["k"]}, {"block": r["block"], "bucket": -1, "sums": r["u"]}]
                    continue
                if r["bucket"] != held:
                    held, parts, keys = r["bucket"], [], None
                if r["kind"] == 0:
                    parts.append((read_sorted(r["k"], r["n"]), read(r["u"], r["n"], np.float32)))
                    continue
                if keys is None:
                    keys = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in parts)])
                    values = np.concatenate([np.zeros(0, np.float32), *(x for _, x in parts)]).astype(np.float64)
                    by = np.argsort(keys)
                    keys, values, parts = keys[by] >> UNSENT, values[by], []
                m = r["texts"]
                own = looked_up(keys, values, read_sorted(r["k"], r["n"]), 0.0)
                u, c = read_sorted(r["u"], r["m"]).astype(np.int64), read(r["c"], r["m"], np.uint32)
                out.append({"block": r["block"], "bucket": held, "sums": packed(np.bincount(u % m, own[u // m] * c, m).astype(np.float32))})
            yield batch(out, [("block", pa.int64()), ("bucket", pa.int32()), ("sums", pa.binary())])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        th, first, *rest = table.column("sums").to_pylist()  # the texts' hashes, the frequent values' sums, then every range's
        th, sums = np.frombuffer(th, np.int64), np.frombuffer(first, np.float64).copy()
        for x in rest:
            sums += read(x, len(th), np.float32)
        return pa.table({"th": th, "whole": sums})

    none = F.lit(None).cast("binary")
    zero = F.lit(0).cast("long")
    known = model.values.select(F.lit(0).alias("kind"), "bucket", zero.alias("block"), zero.alias("texts"), "n", zero.alias("m"), F.col("keys").alias("k"), F.col("values").alias("u"), none.alias("c"))
    met = known.unionByName(asked(rows, model)).repartition("bucket").sortWithinPartitions("bucket", "kind")
    sums = met.mapInArrow(answer, "block long, bucket int, sums binary").groupBy("block").applyInArrow(add, "th long, whole double")
    return sums.groupBy("th").agg(F.max("whole").alias("whole"))
