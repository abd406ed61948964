"""Language identification with a linear-chain conditional random field.

Every word of a text is labelled with a language; affix, character n-gram and
lexicon features give its scores, learned transitions tie neighbours together,
and forward-backward gives the posterior of each word, so code-switched text is
labelled word by word. A text's language is the one with the most posterior
words, its score that share.

The model is fitted on the driver on a bounded sample, ``per_language`` rows of
each language (those of lowest hash of their identifier), by full-batch Adam on the
gradient of the likelihood: word posteriors for the features, pair marginals of
forward-backward for the transitions. No labelled text switches languages, so the sample's
texts are cut into phrases of 4 to 40 words, and sequences of phrases in a shuffled order are
what the model learns from. The lexicon holds which languages' texts (``IN_TEXTS`` or more)
have a word.
Prediction reads every text whole. Forward-backward runs over pieces of
``PIECE`` words at once: the product of a piece's transfer matrices carries the
messages from piece to piece, which gives the same posteriors as word by word.

Results for the odd cases: a null text or one without a letter is ``und`` with
score 0, and so is every text if no labelled row could be learned from; a null
identifier is in no fold (held_out false); every row, repeated ones included,
gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import MIX1, MIX2, Words, scramble, slices, split, texts_of

#: Text bytes labelled at once.
BLOCK = 3 << 20
BITS, PIECE, PER_LANGUAGE, ROUNDS = 16, 64, 100, 30
#: Words of a training sequence; least and most words of its phrases; texts of a language that put a word in its lexicon.
SEQUENCE, PHRASE, IN_TEXTS = 512, (4, 40), 3
UNKNOWN = "und"


class LanguageModel(NamedTuple):
    languages: list[str]
    weights: np.ndarray  #: (features, languages)
    transitions: np.ndarray  #: (languages, languages), log scores
    lexicon: tuple[np.ndarray, np.ndarray]  #: sorted word numbers, and the bits of the languages that have each


class Features(NamedTuple):
    """Feature numbers of the distinct words of a block: parallel arrays of words (rising) and numbers, one pair a kind."""

    owners: list[np.ndarray]
    numbers: list[np.ndarray]
    n: int
    words: np.ndarray  #: number of each lower-cased word


def word_features(vocab: pa.Array, lexicon: tuple[np.ndarray, np.ndarray] | None = None) -> Features:
    """Character 2- and 3-grams with word marks, affixes of 1 to 3 characters (grams at the marks), the word itself, and its languages in the lexicon."""
    strings = vocab.cast(pa.large_string())
    lower = pc.utf8_lower(strings)
    size = pc.utf8_length(lower).to_numpy().astype(np.int64) + 2
    points = np.full(int(size.sum()), 1, np.uint64)  # a mark on either side of each word
    last = np.cumsum(size) - 1
    first = last - size + 1
    inner = np.ones(len(points), bool)
    inner[last] = inner[first] = False
    points[inner] = np.frombuffer("".join(lower.to_pylist()).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(size), dtype=np.int32), size)
    shift = np.uint64(64 - BITS)
    owners, numbers = [], []

    def add(owner: np.ndarray, value: np.ndarray, kind: int) -> None:
        owners.append(owner)
        numbers.append((((value + np.uint64(kind)) * MIX2) >> shift).astype(np.int32))

    with np.errstate(over="ignore"):
        gram = points
        for n in (2, 3):
            gram = gram[:-1] * MIX1 + points[n - 1 :] if len(gram) else gram
            fits = word[: len(gram)] == word[n - 1 :] if len(gram) else np.zeros(0, bool)
            add(word[: len(gram)][fits], gram[fits], n << 40)
        long = np.flatnonzero(size >= 4)
        for kind, at in ((4, first[long]), (5, last[long] - 3)):
            add(long.astype(np.int32), gram[at] * MIX1 + points[at + 3], kind << 40)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(64, MIX1)])
        place = np.minimum(np.arange(len(points)) - first[word], 64)
        whole = np.add.reduceat(points * powers[place], first) if len(first) else np.zeros(0, np.uint64)
        whole = scramble(whole)
        add(np.arange(len(size), dtype=np.int32), whole, 6 << 40)
    out = Features(owners, numbers, len(size), whole)
    return out if lexicon is None else with_lexicon(out, lexicon)


def with_lexicon(f: Features, lexicon: tuple[np.ndarray, np.ndarray]) -> Features:
    """Adds one feature a word: the set of languages that the lexicon gives it."""
    known, bits = lexicon
    at = np.minimum(np.searchsorted(known, f.words), max(len(known) - 1, 0))
    mask = np.where(known[at] == f.words, bits[at], np.uint64(0)) if len(known) else np.zeros(f.n, np.uint64)
    with np.errstate(over="ignore"):
        number = ((scramble(mask + np.uint64(7 << 40)) * MIX2) >> np.uint64(64 - BITS)).astype(np.int32)
    return f._replace(owners=[*f.owners, np.arange(f.n, dtype=np.int32)], numbers=[*f.numbers, number])


def lexicon_of(words: Words, truth: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the languages of which ``IN_TEXTS`` texts or more have them; of over 64 languages, those numbered alike share a bit."""
    n = len(words.vocab)
    seen = np.unique(words.doc * np.int64(n) + words.codes)
    pair, texts = np.unique(truth[seen // n] * np.int64(n) + seen % n, return_counts=True)
    pair = pair[texts >= IN_TEXTS]
    known, at = np.unique(numbers[pair % n], return_inverse=True)
    bits = np.zeros(len(known), np.uint64)
    np.bitwise_or.at(bits, at, np.uint64(1) << (pair // n % 64).astype(np.uint64))
    return known, bits


def emissions(weights: np.ndarray, f: Features) -> np.ndarray:
    """Scores (words, languages)."""
    out = np.zeros((f.n, weights.shape[1]), weights.dtype)
    for owner, number in zip(f.owners, f.numbers, strict=True):
        if len(owner) == f.n or not len(owner):
            out[owner] += weights[number]
        else:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[starts]] += np.add.reduceat(weights[number], starts, axis=0)
    return out


class Pieces(NamedTuple):
    """Positions (PIECE, pieces) of the words of a block, and which cells are words."""

    cell: np.ndarray
    real: np.ndarray
    text: np.ndarray  #: the text of each piece
    place: np.ndarray  #: its place in the text


def pieces_of(words: Words) -> Pieces:
    n = -(-words.lengths // PIECE)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    cell = (words.offsets[:-1][text] + place * PIECE) + np.arange(PIECE)[:, None]
    real = cell < words.offsets[1:][text]
    return Pieces(np.where(real, cell, 0), real, text, place)


def _unit(x: np.ndarray) -> np.ndarray:
    x /= x @ np.ones((x.shape[-1], 1), x.dtype)
    return x


def posteriors(score: np.ndarray, transitions: np.ndarray, p: Pieces, weigh: np.ndarray | None = None, pairs: np.ndarray | None = None) -> np.ndarray:
    """Posterior (PIECE, pieces, languages) of every word from its scores of that shape.

    Cells after a text's end are in its last piece, whose messages onwards nobody reads. With ``weigh`` (PIECE, pieces),
    the marginals of every word with the one before it are added to ``pairs`` (languages, languages), weighed.
    """
    _, m, k = score.shape
    e = np.exp(np.maximum(score - score.max(axis=2, keepdims=True), -60)).astype(np.float32)
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    longest = int(p.place.max(initial=-1)) + 1
    ahead, behind = np.full((m, k), 1.0 / k, np.float32), np.full((m, k), 1.0 / k, np.float32)
    if longest > 1:
        # transfer matrix of each piece, from the message before its first word to that after its last
        carry = np.broadcast_to(np.eye(k, dtype=np.float32), (m, k, k))
        for t in range(PIECE):
            carry = (carry.reshape(-1, k) @ a).reshape(m, k, k)
            carry *= e[t, :, None, :]
            if t % 4 == 3:
                carry = _unit(carry.reshape(m, k * k)).reshape(m, k, k)
        by_place = np.argsort(p.place, kind="stable")
        cuts = np.searchsorted(p.place[by_place], np.arange(longest + 1))
        for c in range(1, longest):
            at = by_place[cuts[c] : cuts[c + 1]]
            ahead[at] = _unit(np.einsum("mi,mij->mj", ahead[at - 1], carry[at - 1]))
        # the last piece's own matrix would take in the cells after the end
        tail = np.r_[p.place[1:] == 0, True]
        for t in range(PIECE - 1, -1, -1):
            here = np.flatnonzero(tail & p.real[t])
            behind_of = behind[here] * e[t, here]
            behind[here] = _unit(behind_of @ a.T)
        message = behind
        behind = np.full((m, k), 1.0 / k, np.float32)
        for c in range(longest - 1, 0, -1):
            at = by_place[cuts[c] : cuts[c + 1]]
            through = np.where(tail[at, None], message[at], np.einsum("mij,mj->mi", carry[at], behind[at]))
            behind[at - 1] = _unit(through)
    out = np.empty_like(e)
    f = ahead
    for t in range(PIECE):
        f = _unit((f @ a) * e[t])
        out[t] = f
    b = behind
    for t in range(PIECE - 1, -1, -1):
        here = b * e[t]
        if pairs is not None:
            before = out[t - 1] if t else ahead  # forward messages up to here
            on = p.real[t] if t else p.real[t] & (p.place > 0)
            share = np.where(on, weigh[t] / np.maximum(((before @ a) * here).sum(axis=1), 1e-30), 0)
            pairs += ((before * share[:, None]).T @ here) * a
        out[t] *= b
        on = _unit(here @ a.T)
        b = on if p.real[t].all() else np.where(p.real[t, :, None], on, b)
    return _unit(out)


def fit(texts: list[str], labels: list[str], rounds: int = ROUNDS, l2: float = 1e-3, rate: float = 0.4) -> LanguageModel | None:
    """Model of labelled texts, each word taken to be in its text's language; None without any word."""
    languages = sorted(set(labels))
    words = split(pa.array(texts, pa.large_string()))
    if not len(words.codes):
        return None
    k = len(languages)
    truth = np.array([languages.index(x) for x in labels])
    f = word_features(words.vocab)
    lexicon = lexicon_of(words, truth, f.words)
    f = with_lexicon(f, lexicon)
    words, target = switched(words, truth)
    n = len(words.codes)
    p = pieces_of(words)
    code, target = words.codes[p.cell], target[p.cell]
    share = 1.0 / np.bincount(target[p.real], minlength=k).clip(1) / k  # each language counts alike
    weigh = np.where(p.real, share[target], 0.0)
    w, a = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, a)]
    # transitions that are there: from every word of a sequence but its last to the next one
    label = np.zeros(n, np.int64)
    label[p.cell[p.real]] = target[p.real]
    inner = np.ones(n, bool)
    inner[words.offsets[:-1][words.lengths > 0]] = False
    at = np.flatnonzero(inner)
    there = np.bincount(label[at - 1] * k + label[at], share[label[at]], k * k).reshape(k, k)
    pieces, cells = np.arange(code.shape[1]), np.arange(PIECE)[:, None]
    for turn in range(1, rounds + 1):
        pairs = np.zeros((k, k))
        q = posteriors(emissions(w, f)[code], a, p, weigh, pairs)
        gap = q * weigh[:, :, None]
        gap[cells, pieces, target] -= weigh
        per_word = np.stack([np.bincount(code.ravel(), gap[:, :, c].ravel(), f.n) for c in range(k)], axis=1)
        grad_w = l2 * w / n
        for owner, number in zip(f.owners, f.numbers, strict=True):
            for c in range(k):
                grad_w[:, c] += np.bincount(number, per_word[owner, c], 1 << BITS)
        grad_a = pairs - there + l2 * a / n
        for x, g, (m1, m2) in zip((w, a), (grad_w, grad_a), moments, strict=True):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            x -= rate * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-8)
    return LanguageModel(languages, w, a, lexicon)


def switched(words: Words, truth: np.ndarray) -> tuple[Words, np.ndarray]:
    """Sequences of phrases cut from all texts, in an order that is shuffled the same way each time, and the language of each word."""
    r = np.random.default_rng(0)
    starts, ends = [], []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        while a < b:
            starts.append(a)
            a = min(b, a + int(r.integers(PHRASE[0], PHRASE[1] + 1)))
            ends.append(a)
    order = r.permutation(len(starts))
    starts, ends = np.array(starts)[order], np.array(ends)[order]
    size = ends - starts
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return Words(words.codes[at], words.vocab, np.r_[np.arange(0, len(at), SEQUENCE), len(at)]), truth[words.doc[at]]


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, folds: int) -> list:
    """At most ``per_language`` rows of each language outside fold 0, those of the lowest hash of their identifier."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & (F.crc32(F.col("i").cast("string")) % folds != 0))
    # of each language first the share of lowest hashes that holds four times the rows wanted, so that few rows meet
    h, wide = F.xxhash64("i"), 1 << 64
    some = F.lit(False)
    for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect():
        share = min(wide, 4 * per_language * wide // r.n)
        some = some | ((F.col("l") == r.l) & (h <= F.lit(share - (wide >> 1) - 1)))
    order = Window.partitionBy("l").orderBy(h, "i")
    chosen = rows.where(some).select("i", "l").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("i", "l").collect()
    if not chosen:
        return []
    got = rows.where(F.col("i").isin([x.i for x in chosen])).groupBy("i", "l").agg(F.max("t").alias("t")).collect()
    wanted = {(x.i, x.l) for x in chosen}
    return sorted((x for x in got if (x.i, x.l) in wanted), key=lambda x: (x.l, str(x.i)))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, folds: int = 5) -> LanguageModel | None:
    rows = training_rows(docs, id_col, text_col, lang_col, per_language, folds)
    return fit([x.t or "" for x in rows], [x.l for x in rows]) if rows else None


def predict(column: pa.Array, model: LanguageModel | None) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of a column."""
    text = texts_of(column)
    n = len(text)
    label, score = np.full(n, UNKNOWN, object), np.zeros(n)
    words = split(text)
    if model is None or not len(words.codes):
        return label.tolist(), score
    p = pieces_of(words)
    q = posteriors(emissions(model.weights, word_features(words.vocab, model.lexicon))[words.codes[p.cell]], model.transitions, p)
    q[~p.real] = 0
    total = np.zeros((n, len(model.languages)))
    np.add.at(total, p.text, q.sum(axis=0, dtype=np.float64))
    lettered = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    best = total.argmax(axis=1)
    label[lettered] = np.array(model.languages, object)[best[lettered]]
    score[lettered] = (total[np.arange(n), best] / words.lengths.clip(1))[lettered]
    return label.tolist(), np.clip(score, 0, 1)


def label_words(text: str, model: LanguageModel) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of every word of a text."""
    words = split(pa.array([text], pa.large_string()))
    if not len(words.codes):
        return []
    p = pieces_of(words)
    q = posteriors(emissions(model.weights, word_features(words.vocab, model.lexicon))[words.codes[p.cell]], model.transitions, p)
    q = q.transpose(1, 0, 2)[p.real.T]
    vocab = words.vocab.to_pylist()
    return [(vocab[c].decode(), model.languages[r.argmax()], float(r.max())) for c, r in zip(words.codes, q, strict=True)]


def predict_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a language, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, BLOCK):
            label, score = predict(b.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(label, pa.string()), pa.array(score)], [id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(id_col, text_col, F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, BLOCK):
            label, score = predict(b.column(text_col), sent.value)
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(label, score, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
