"""Toxicity from class-conditional Kneser-Ney language models.

The texts that have a word or a word pair are counted for toxic and ordinary
labelled texts apart (a text that repeats itself counts once). Two pairs of models
are read from these counts: of the whole vocabulary (``kneser_ney``), where every
rare word and pair is smoothed through the shared lower order, and of a lexicon.
Both classes' models are interpolated with absolute discounts, in the lexicon's:

    P(w | h) = max(c(h, w) - D, 0) / c(h) + rest(h) * P(w)
    P(w)     = max(c(w) - D, 0) / N + rest * S(w)

where S, the number of different words that w follows in both classes together,
is shared. What the labels do not tell apart is smoothed alike in both models: a
word or pair is an expression of its own if its toxic count is ``APART`` standard
deviations from the one expected and its odds differ by ``ODDS`` or more; all other
words are one common word here, and stand for themselves in the whole vocabulary's
models. (In the latter alone a text's language or subject, which differ a little
between the classes over all its words, outweigh a few toxic ones.) The
thresholds are the same for every size of input, and the number of expressions is
not bounded: words and pairs with their probabilities are tables, to which a
text's words are joined. A Bloom filter of fixed size keeps most common words out
of that join, which only spares work. The counts cover all labelled texts and are
made by packed partial counts. Tables that only the fit reads are deleted as soon as
what reads them is written, for they would fill the disk while the texts are scored.

A text's two log-likelihood ratios, of the lexicon and of the whole vocabulary, are
normalised by its length, by n and by the root of n. Logistic regression on a part
of the labelled texts that was not counted (fold 1 of the identifiers' crc32) turns
them into a score; it takes at most ``DEV`` texts, those of lowest hash.

Results for the odd cases: null, empty and blank texts have the ratio 0 and the
score that it stands for; without labelled texts of both classes every score is
0; rows of ``labels`` with a null identifier or label teach nothing, and a
repeated identifier is toxic if one of its rows is; every row of the documents,
repeated ones included, gives one row; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import bloom_of, passing
from .kneser_ney import WholeModel, fit_whole, whole_ratios
from .shared import discard, written
from .words import MIX2, Words, slices, split

DISCOUNT, APART, ODDS = 0.75, 4.0, 4.0
DEV = 20_000
BLOCK = 4 << 20
#: The common word, among hashes of words.
COMMON = 0
#: Buckets of words in which the whole vocabulary's counts meet; the counts' own are a multiple.
WORDS_IN = 64


class ToxicityModel(NamedTuple):
    words: DataFrame  #: (w, toxic, plain, toxic_rest, plain_rest): P(w) of the words told apart, and what they as contexts leave to P
    pairs: DataFrame  #: (h, w, toxic_part, plain_part): discounted parts of P(w | h) of the pairs told apart
    passing: np.ndarray  #: Bloom filter of the words
    common: tuple[float, float, float, float]  #: as in words, of the common word
    alone: tuple[float, float]  #: log ratio of the common word after itself, and as the first of a text
    weights: np.ndarray  #: of LLR / n and LLR / sqrt(n) of the lexicon, of both of the whole vocabulary, and the constant
    whole: WholeModel | None = None  #: models of every word and pair


def fold_of(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string")) % folds


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, toxic, fold) of the labelled texts outside fold 0, written to the shared folder."""
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y is not null").groupBy("i").agg((F.max("y") > 0).alias("toxic"))
    marks = marks.where(fold_of(F.col("i")) != 0)
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(marks.select(F.xxhash64("i"))))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passing(sent.value, b.column(2).to_numpy()))).select(["i", "text"])

    kind = rows.schema["i"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"i {kind}, text string")
    # labels grow with the documents, so they are merged at every size and never broadcast
    return written(rows.join(marks.hint("merge"), "i").select("i", "text", "toxic", fold_of(F.col("i")).cast("int").alias("fold")), "labelled", "zstd")


COUNTS = "bucket int, keys binary, toxic binary, plain binary"


def _packed(keys: np.ndarray, toxic: np.ndarray, plain: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Counts of distinct keys, a row for each bucket."""
    with np.errstate(over="ignore"):
        to = (((keys * MIX2) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(to, kind="stable")
    to, keys, toxic, plain = to[by], keys[by], toxic[by].astype(np.uint32), plain[by].astype(np.uint32)
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=False))
    return pa.RecordBatch.from_arrays([pa.array(to[cuts]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (keys, toxic, plain))], ["bucket", "keys", "toxic", "plain"])


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys with the sums of their counts."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    keys, at = np.unique(read("keys", np.uint64), return_inverse=True)
    return keys, np.bincount(at, read("toxic", np.uint32), len(keys)).astype(np.int64), np.bincount(at, read("plain", np.uint32), len(keys)).astype(np.int64)


def told_apart(toxic: Column, plain: Column, share: float) -> Column:
    """Whether counts differ from what the toxic share of all counts leads to expect."""
    expected = (toxic + plain) * share
    odds = (toxic + 0.5) / (plain + 0.5) * ((1 - share) / share)
    return (F.abs(toxic - expected) >= APART * F.sqrt(expected + 0.5)) & ((odds >= ODDS) | (odds <= 1 / ODDS))


def unpacked(packed: DataFrame, share: float) -> DataFrame:
    """(w, t, p) of the words that the classes tell apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t, p in zip(*(b.column(c).to_pylist() for c in ("keys", "toxic", "plain")), strict=True):
                k, t, p = np.frombuffer(k, np.int64), np.frombuffer(t, np.uint32).astype(np.int64), np.frombuffer(p, np.uint32).astype(np.int64)
                on = np.abs(t - (t + p) * share) >= APART * np.sqrt((t + p) * share + 0.5)  # most are left out before they are rows
                yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (k, t, p)], ["w", "t", "p"])

    rows = packed.select("keys", "toxic", "plain").mapInArrow(run, "w long, t long, p long")
    return rows.where(told_apart(F.col("t"), F.col("p"), share) & (F.col("w") != COMMON))


def word_counts(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK):
            words = split(b.column(0))
            if len(words.codes):
                n = len(words.vocab)
                once = np.unique(words.doc * np.int64(n) + words.codes)
                toxic = b.column(1).to_numpy(zero_copy_only=False)[once // n]
                keys = Words(np.arange(n, dtype=np.int32), words.vocab, words.offsets[:0]).hashes()
                yield _packed(keys, np.bincount((once % n)[toxic], minlength=n), np.bincount((once % n)[~toxic], minlength=n), buckets)

    def merge(table: pa.Table) -> pa.Table:
        keys, toxic, plain = _merged(table)
        return pa.Table.from_batches([_packed(keys, toxic, plain, 1).set_column(0, "bucket", table.column("bucket").combine_chunks()[:1].cast(pa.int32()))])

    return written(rows.select("text", "toxic").mapInArrow(run, COUNTS).groupBy("bucket").applyInArrow(merge, COUNTS), "word-counts")


def candidates(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(u, the other columns, n, at): instead of its text, a row has a number, its words' count, and place and hash of those that pass the filter."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)
    rest = [c for c in rows.columns if c != "text"]
    rows = rows.select(F.monotonically_increasing_id().alias("u"), *rest, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK):
            words = split(b.column("text"))
            keys = Words(np.arange(len(words.vocab), dtype=np.int32), words.vocab, words.offsets[:0]).hashes().view(np.int64)
            on = np.flatnonzero(passing(sent.value, keys)[words.codes]) if len(keys) else np.zeros(0, np.int64)
            doc = words.doc[on]
            at = pa.StructArray.from_arrays([pa.array((on - words.offsets[doc]).astype(np.int32)), pa.array(keys[words.codes[on]] if len(keys) else np.zeros(0, np.int64))], ["pos", "w"])
            ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=b.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("u", *rest)), pa.array(words.lengths), pa.ListArray.from_arrays(pa.array(ends), at)], ["u", *rest, "n", "at"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("u", *rest))
    return written(rows.mapInArrow(run, f"{kinds}, n long, at array<struct<pos:int,w:bigint>>"), "text-words")


def told_places(texts: DataFrame, words: DataFrame, common: tuple[float, float, float, float]) -> DataFrame:
    """(u, h, w, a, b) of every place where the word or the one before is told apart: both, and both classes' rest(h) * P(w). A text's first word has no h."""
    at = texts.select("u", "n", F.explode("at").alias("_at")).select("u", "n", "_at.pos", "_at.w").join(words, "w")
    by = Window.partitionBy("u").orderBy("pos")
    after = F.lag("pos").over(by) == F.col("pos") - 1

    def before(column: str, otherwise: float) -> Column:
        return F.when(F.col("pos") > 0, F.when(after, F.lag(column).over(by)).otherwise(F.lit(otherwise)))

    kind = "struct<h:bigint,w:bigint,a:double,b:double>"
    rest = lambda column, other: F.coalesce(before(column, other), F.lit(1.0))
    own = F.struct(before("w", COMMON), "w", F.col("toxic") * rest("toxic_rest", common[2]), F.col("plain") * rest("plain_rest", common[3])).cast(kind)
    alone = (F.col("pos") + 1 < F.col("n")) & ~F.coalesce(F.lead("pos").over(by) == F.col("pos") + 1, F.lit(False))
    following = F.when(alone, F.struct(F.col("w"), F.lit(COMMON), F.col("toxic_rest") * common[0], F.col("plain_rest") * common[1]).cast(kind))
    both = at.select("u", F.array(own, following).alias("_both"))
    return both.select("u", F.explode("_both").alias("_p")).where("_p is not null").select("u", "_p.*")


def pair_counts(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(h, w, t, p): the labelled texts of both classes that have each pair."""
    one = [F.lit(1.0).alias(c) for c in ("toxic", "plain", "toxic_rest", "plain_rest")]
    places = told_places(texts, lexicon.select("w", *one), (1.0, 1.0, 1.0, 1.0)).where("h is not null")
    marks = texts.select("u", "toxic", "n")
    classes = [F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("p")]
    some = places.groupBy("u", "h", "w").agg(F.count("*").alias("k")).join(marks, "u")
    told = some.groupBy("h", "w").agg(*classes)
    left = marks.join(places.groupBy("u").agg(F.count("*").alias("k")), "u", "left").where(F.col("n") - 1 > F.coalesce("k", F.lit(0)))
    return written(told.unionByName(left.agg(*classes).where("t + p > 0").select(F.lit(COMMON).cast("long").alias("h"), F.lit(COMMON).cast("long").alias("w"), "t", "p")), "pair-counts")


def estimate(lexicon: DataFrame, bits: np.ndarray, pairs: DataFrame, totals: tuple[int, int], share: float) -> ToxicityModel:
    """Probabilities from counts. ``totals`` sum over all words, ``lexicon`` and ``pairs`` are (w, t, p) and (h, w, t, p)."""
    cut = lambda c, total: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / float(total)
    told = lexicon.agg(F.count("*").alias("k"), *[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in (("t", F.col("t")), ("p", F.col("p")), ("ct", cut("t", totals[0])), ("cp", cut("p", totals[1])))]).first()
    counts = (totals[0] - told.t, totals[1] - told.p)
    cuts = [max(c - DISCOUNT, 0) / total for c, total in zip(counts, totals, strict=True)]
    left = (1 - told.ct - cuts[0], 1 - told.cp - cuts[1])
    follows = pairs.groupBy("w").agg(F.count("*").alias("follows"))
    shared = pairs.count() + 0.5 * (told.k + 1)
    context = lexicon.select(F.col("w").alias("h"), F.col("t").alias("ht"), F.col("p").alias("hp"))
    kept = pairs.where(told_apart(F.col("t"), F.col("p"), share)).join(context, "h", "left")
    part = lambda c, h, other: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.coalesce(h, F.lit(other)), F.lit(1))
    kept = written(kept.select("h", "w", part("t", "ht", counts[0]).alias("toxic_part"), part("p", "hp", counts[1]).alias("plain_part")), "pairs")
    taken = kept.groupBy("h").agg(F.sum("toxic_part").alias("rt"), F.sum("plain_part").alias("rp"))
    rest = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1.0), 1 - F.coalesce(c, F.lit(0.0))))
    base = (F.coalesce("follows", F.lit(0)) + 0.5) / shared
    words = lexicon.join(follows, "w", "left").join(taken.withColumnRenamed("h", "w"), "w", "left")
    words = words.select("w", (cut("t", totals[0]) + base * left[0]).alias("toxic"), (cut("p", totals[1]) + base * left[1]).alias("plain"), rest("rt").alias("toxic_rest"), rest("rp").alias("plain_rest"))
    f, r = follows.where(F.col("w") == COMMON).first(), taken.where(F.col("h") == COMMON).first()
    base0 = ((f.follows if f else 0) + 0.5) / shared
    common = (cuts[0] + left[0] * base0, cuts[1] + left[1] * base0, *(min(1.0, max(1e-6, 1 - x)) for x in ((r.rt, r.rp) if r else (0.0, 0.0))))
    q = kept.where((F.col("h") == COMMON) & (F.col("w") == COMMON)).first()
    again = math.log((common[0] * common[2] + (q.toxic_part if q else 0)) / (common[1] * common[3] + (q.plain_part if q else 0)))
    return ToxicityModel(written(words, "words"), kept, bits, common, (again, math.log(common[0] / common[1])), np.zeros(5))


def ratios(texts: DataFrame, m: ToxicityModel) -> DataFrame:
    """Adds ratio: log-likelihood ratio of every text of ``candidates``, toxic over ordinary."""
    places = told_places(texts, m.words, m.common).join(m.pairs, ["h", "w"], "left")
    ratio = F.log((F.col("a") + F.coalesce("toxic_part", F.lit(0.0))) / (F.col("b") + F.coalesce("plain_part", F.lit(0.0))))
    sums = places.groupBy("u").agg(F.sum(ratio).alias("_r"), F.count("h").alias("_k"), F.count_if(F.col("h").isNull()).alias("_f"))
    out = texts.drop("at").join(sums, "u", "left")
    common = F.greatest(F.col("n") - 1 - F.coalesce("_k", F.lit(0)), F.lit(0)) * m.alone[0] + F.when((F.col("n") > 0) & (F.coalesce("_f", F.lit(0)) == 0), m.alone[1]).otherwise(0.0)
    return out.withColumn("ratio", F.coalesce("_r", F.lit(0.0)) + common).drop("_r", "_k", "_f")


def both_ratios(rows: DataFrame, m: ToxicityModel) -> DataFrame:
    """Adds n, ratio and whole, the log-likelihood ratios of the lexicon and of the whole vocabulary, to ``rows`` with a text; it is left out."""
    rows = rows.withColumn("th", F.xxhash64("text"))
    whole = whole_ratios(rows, m.whole).withColumnRenamed("whole", "_w")
    out = ratios(candidates(rows, m.passing), m).join(whole, "th")
    return out.withColumn("whole", F.col("_w") + F.col("n") * m.whole.unknown).drop("_w", "th")


def normalised(ratio: np.ndarray, whole: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, 5): both by length and by its root, and 1."""
    n = np.maximum(n, 1)
    return np.stack([ratio / n, ratio / np.sqrt(n), whole / n, whole / np.sqrt(n), np.ones(len(n))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression in which both classes weigh alike, by Newton's method; columns are scaled first."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    weigh = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weigh * p * (1 - p))[:, None]).T @ z / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (weigh * (y - p)) / len(y) - l2 * w)
        size = np.abs(step).max()
        w += step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w / scale


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """Model of the labelled texts outside fold 0; None if one of the classes has no word."""
    spark = docs.sparkSession
    buckets = WORDS_IN * math.ceil(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) / WORDS_IN)
    rows = labelled(docs, labels, id_col, text_col, label_col)
    counted = rows.where("fold <> 1")
    words = word_counts(counted, buckets)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(np.frombuffer(x, np.uint32).sum(dtype=np.int64)) for x in c.to_pylist())], pa.int64()) for c in b.columns], ["t", "p"])

    total = words.select("toxic", "plain").mapInArrow(sums, "t long, p long").agg(F.sum("t").alias("t"), F.sum("p").alias("p")).first()
    if not total.t or not total.p:
        discard(words)
        discard(rows)
        return None
    share = total.t / (total.t + total.p)
    lexicon = written(unpacked(words, share), "lexicon")
    bits = bloom_of(lexicon.select("w"))
    texts = candidates(counted, bits)
    pairs = pair_counts(texts, lexicon)
    discard(texts)
    model = estimate(lexicon, bits, pairs, (total.t, total.p), share)
    discard(pairs)
    discard(lexicon)
    model = model._replace(whole=fit_whole(counted, words, WORDS_IN))
    discard(words)
    dev = rows.where("fold = 1").orderBy(F.xxhash64("i"), "i").select("i").limit(DEV)
    got = both_ratios(rows.where("fold = 1").join(F.broadcast(dev.distinct()), "i").select("i", "toxic", "text"), model).select("ratio", "whole", "n", F.col("toxic").alias("y")).toArrow()
    discard(rows)
    y = got.column("y").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        weights = logistic(normalised(*(got.column(c).to_numpy() for c in ("ratio", "whole", "n"))), y)
    else:  # one class only: the lexicon's ratio by the root of the length as it is
        weights = np.array([0.0, 1.0, 0.0, 0.0, -1.0])
    return model._replace(weights=weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    held = F.coalesce(fold_of(F.col(id_col)) == 0, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select(id_col, held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    rows = docs.select(F.col(id_col).alias("i"), held, F.col(text_col).alias("text"))
    a, b, c, d, e = map(float, model.weights)
    n = F.greatest("n", F.lit(1))
    x = F.col("ratio") / n * a + F.col("ratio") / F.sqrt(n) * b + F.col("whole") / n * c + F.col("whole") / F.sqrt(n) * d + e
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))
    out = both_ratios(rows, model).select(F.col("i").alias(id_col), "held_out", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
