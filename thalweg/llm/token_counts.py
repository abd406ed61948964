"""Token counts by rank-synchronous merging of ragged arrays.

Byte-pair encoding of a piece vocabulary (scores and byte fallback, as in a
sentencepiece BPE model) without the library's encoder. The distinct pre-tokens
of a block of texts are held as one ragged numpy array of symbols; in each round
every pre-token applies its own lowest-rank pair (the leftmost of equal ones),
all at once, until none is left; surviving symbols are counted. A symbol outside
the vocabulary counts its UTF-8 bytes, as byte fallback does.

Only pre-tokens are merged because no piece of the vocabulary has a word mark
after another character: then no merge crosses the start of a run of marks.
``PieceRanks`` checks that and refuses a model for which it is false.

Results for the odd cases: null and empty texts have 0 bytes and 0 tokens; every
row, repeated ones included, gives one row; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import slices, texts_of

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Text bytes whose distinct pre-tokens are merged together.
BLOCK = 6 << 20


class PieceRanks:
    """Merge tables of a sentencepiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = [model.id_to_piece(i) for i in usual]
        scores = np.array([model.get_score(i) for i in usual])
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece has a word mark after another character; pre-tokens can't be merged apart")
        chars = sorted({c for p in pieces for c in p})
        symbols = {p: k for k, p in enumerate(pieces)}
        for c in chars:
            symbols.setdefault(c, len(symbols))
        # ranks: 0 is the best score; equal scores share a rank
        rank = np.zeros(len(pieces), np.int64)
        order = np.argsort(-scores, kind="stable")
        rank[order] = np.cumsum(np.r_[0, np.diff(-scores[order]) > 0])
        left, right, made = [], [], []
        for k, p in enumerate(pieces):
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(k)
        self.n_pieces, self.width = len(pieces), len(symbols) + 1
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        by = np.argsort(keys)
        self.keys, self.made = keys[by], np.array(made, np.int32)[by]
        self.ranks = rank[self.made].astype(np.int32)
        #: code point -> symbol; the last symbol stands for every unknown character
        self.of_char = np.full(0x110000, len(symbols), np.int32)
        for c in chars:
            self.of_char[ord(c)] = symbols[c]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made symbol of each pair; NONE where there is no such piece."""
        if not len(self.keys):
            return np.full(len(a), NONE, np.int32), np.zeros(len(a), np.int32)
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def count(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, given the code points of all and the length (over 0) of each."""
        n = len(sizes)
        if not n:
            return np.zeros(0, np.int64)
        sym = self.of_char[points]
        # bytes that a symbol costs if it stays a character outside the vocabulary
        cost = np.where(sym >= self.n_pieces, 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int8) + (points > 0xFFFF), 1).astype(np.int8)
        word = np.repeat(np.arange(n, dtype=np.int32), sizes)
        counts = np.bincount(word, cost, n).astype(np.int64)
        counts_made = np.zeros(n, np.int64)  # every merge takes one piece away
        rank = np.full(len(sym), NONE, np.int32)
        made = np.zeros(len(sym), np.int32)
        joint = np.flatnonzero(word[:-1] == word[1:])
        rank[joint], made[joint] = self.pairs(sym[joint], sym[joint + 1])
        charged = cost
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            going = best != NONE
            if not going.all():  # finished pre-tokens leave
                stay = np.repeat(going, np.diff(np.r_[starts, len(sym)]))
                sym, word, rank, made, charged = (x[stay] for x in (sym, word, rank, made, charged))
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                best = best[going]
            hits = np.flatnonzero(rank == np.repeat(best, np.diff(np.r_[starts, len(sym)])))
            at = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]  # leftmost of each pre-token
            # the two symbols' costs give way to one piece
            counts_made[word[at]] += charged[at] + charged[at + 1] - 1
            sym[at], charged[at] = made[at], 1
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # each pre-token loses one symbol before the next one's hit
            sym, word, rank, made, charged = (x[keep] for x in (sym, word, rank, made, charged))
            rank[at] = NONE
            for p in (at - 1, at):  # pairs on both sides are new
                p = p[(p >= 0) & (p + 1 < len(sym))]
                same = word[p] == word[p + 1]
                p = p[same]
                rank[p], made[p] = self.pairs(sym[p], sym[p + 1])
        return counts - counts_made


@lru_cache(maxsize=2)
def piece_ranks(path: str) -> PieceRanks:
    return PieceRanks(path)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def count_texts(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of every text of a column."""
    ranks = piece_ranks(path)
    text = texts_of(column)
    n = len(text)
    # a text is a mark and then its pieces joined by marks; runs of marks go with what follows them
    empty = pc.binary_length(text).to_numpy() == 0
    odd = pc.match_substring_regex(text, f"  |{MARK}|^ | $").to_numpy(zero_copy_only=False) & ~empty
    out = np.zeros(n, np.int64)
    simple = text.filter(pa.array(~(odd | empty)))
    if len(simple):
        pieces = pc.split_pattern(simple, " ")
        sizes = np.diff(pieces.offsets.to_numpy())
        coded = pieces.flatten().dictionary_encode()
        vocab = coded.dictionary
        size = pc.utf8_length(vocab).to_numpy().astype(np.int64) + 1
        points = np.full(int(size.sum()), ord(MARK), np.uint32)
        rest = np.ones(len(points), bool)
        rest[np.cumsum(size) - size] = False
        points[rest] = _points("".join(vocab.to_pylist()))
        per = ranks.count(points, size)[coded.indices.to_numpy()]
        out[~(odd | empty)] = np.add.reduceat(per, np.cumsum(sizes) - sizes)
    if odd.any():
        runs = [re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK)) for t in text.filter(pa.array(odd)).to_pylist()]
        code = {w: k for k, w in enumerate(dict.fromkeys(w for ws in runs for w in ws))}
        per = ranks.count(_points("".join(code)), np.fromiter(map(len, code), np.int64, len(code)))
        out[odd] = [int(per[[code[w] for w in ws]].sum()) for ws in runs]
    return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text; ``model`` is a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model or default_model()
        for b in slices(batches, text_col, BLOCK):
            n = count_texts(b.column(1), path)
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(id_col, text_col)
    kind = kept.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
