"""Set-similarity join of word n-grams by partition and pigeonhole.

Two sets r and s with 100 * |r & s| >= p * |r | s| differ in at most
H = (100 - p)(|r| + |s|) / (100 + p) elements. Sizes fall in bands whose ends are
in the proportion p : 100, so linked sets are in one band or in neighbouring
ones. For each band the universe of hashed tokens is cut into H + 1 segments, H
that of two sets of the band's largest size: then one segment at least holds the
same subset of both. Every set indexes its subsets under its own band and, to
meet larger sets, under the next.

Allocation of the H + 1 errors by cost: the cost of a subset is the number of
sets that have it, and that number is counted. Every set sends each signature to
a bucket, which answers with the frequencies of those that more than one set has.
Some segments, as a share of the band's, are doubled: they are wide, and count for two errors, as a
set indexes their one-deletion neighbourhoods too. So a set may leave out as many
of the other subsets, the dearest ones: those at the least of a row of fixed frequencies at which
there are few enough of them. Of two linked sets, the one with the lower such frequency
keeps a signature that the other one keeps as well, for a subset is as dear to both. Empty
subsets and those of passages that much text has are left out in this way; texts that
share few subsets keep none.

Signatures only say which sets may be linked. The sets that keep a signature are a
group. Each set has a bitmap of about as many bits as tokens; pairs of a
group whose bitmaps differ in more bits than linked sets can in tokens are ruled out, and
a spanning forest of the other pairs goes into the candidates' graph, which so has fewer edges than kept
signatures. Its components are then verified exactly: sets of a component (a bounded number of
tokens; larger components as pairs of blocks) meet in one task, where a prefix
filter on the rarest tokens and a union-find, which skips sets already joined,
give a spanning forest of the true links. Components of that forest are the result.

Copies count as one set throughout. A Bloom filter of bounded size spares most
texts that are no candidates the second look; where it fills up, more texts pass
and the result stays the same.

Results for the odd cases: null, empty and blank texts have 0 shingles and are
linked with nothing, their component is their own identifier; a text of fewer
words than n has one shingle, the whole sequence; null identifiers are components
of their own unless linked; every row, repeated ones included, gives one row;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_of, passing
from .components import connected_components, spanning
from .shared import written
from .words import MIX2, give_back, inside, scramble, slices, split, windows

#: Text bytes of a block of signatures.
BLOCK = 2 << 20
#: Least bytes that a row counts for in a block, so that the units of a block's sets fit in 16 bits.
ROW = 128
ROWS_AT_MOST = 1 << 15
#: Width of doubled segments, in widths of the others; frequencies from which subsets are left out.
WIDE = 3
LEVELS = (2, 3, 4, 6, 8, 12, 16, 32, 64, 128, 512, 2048, 1 << 14, 1 << 20)
#: Groups of so few sets are compared pair by pair, those of so many not at all (all their sets are candidates).
FEW, MANY = 16, 20_000
#: Words of bitmaps compared at once.
PAIR_WORDS = 1 << 20
#: Tokens verified in one task; components of more are verified as pairs of blocks of half that.
TOKENS = 1_000_000


def bands(p: int, most: int) -> np.ndarray:
    """Largest size of each band up to one that holds ``most``."""
    ends = [100 // p]
    while ends[-1] < most:
        ends.append((ends[-1] + 1) * 100 // p)
    return np.array(ends, np.int64)


def shingle_sets(column: pa.Array, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of every text (sorted), and the offsets of the texts."""
    words = split(column, lower)
    h, n = words.hashes(), len(words.lengths)
    grams, fits = windows(h, k), inside(words, k)
    doc = words.doc
    owner, value = doc[: len(grams)][fits], grams[fits]
    short = np.flatnonzero((words.lengths > 0) & (words.lengths < k))
    if len(short):
        extra = [windows(h[words.offsets[i] : words.offsets[i + 1]], int(words.lengths[i]), MIX2)[0] for i in short]
        owner, value = np.concatenate((owner, short)), np.concatenate((value, np.array(extra, np.uint64)))
    by = np.argsort(value)
    by = by[np.argsort(owner[by], kind="stable")]
    owner, value = owner[by], value[by]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])] if len(owner) else np.zeros(0, bool)
    owner, value = owner[first], value[first]
    return value, np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int64)


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """int64 identity of each set, from its tokens and size; 0 for the empty set."""
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(scramble(tokens), dtype=np.uint64)]
        size = np.diff(offsets)
        ids = scramble((total[offsets[1:]] - total[offsets[:-1]]) * MIX2 + size.astype(np.uint64))
    return np.where(size > 0, ids, np.uint64(0)).view(np.int64)


def rooms(p: int, band_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments, doubled segments) of bands by their largest size.

    As many segments are doubled, so as many others can be left out, as twice what
    chance leaves empty (each of which all sets without tokens there would share),
    and a fortieth more for subsets that much text has.
    """
    m = (100 - p) * 2 * band_end // (100 + p) + 1
    empty = m * np.exp(-0.9 * band_end / (m * (1 + 0.1 * (WIDE - 1))))
    return m, np.where(m > 1, np.minimum(m // 2, 1 + np.ceil(empty + 2 * np.sqrt(empty) + m / 40).astype(np.int64)), 0)


def signatures(tokens: np.ndarray, offsets: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, signature, whether it may be left out) of all non-empty sets; unit is 2 * set, and 1 more under the next band."""
    size = np.diff(offsets)
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    ends = bands(p, int(size.max()))
    ends = np.r_[ends, (ends[-1] + 1) * 100 // p]
    own = np.searchsorted(ends, size)
    units, values, singles = [], [], []
    mixed = scramble(tokens)
    with np.errstate(over="ignore"):
        for shift in (0, 1):
            band = own + shift
            lowest = np.where(band > 0, ends[np.maximum(band - 1, 0)] + 1, 1)
            takes = np.flatnonzero((size > 0) & (100 * size >= p * lowest)) if shift else np.flatnonzero(size > 0)
            if not len(takes):
                continue
            count, doubled = rooms(p, ends[band[takes]])
            start = np.cumsum(count) - count
            at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in takes]) if len(takes) < len(size) else np.arange(len(tokens))
            mine = np.repeat(np.arange(len(takes)), size[takes])
            # doubled segments come first and are WIDE times as wide as the others
            cell = (tokens[at] % (count + (WIDE - 1) * doubled).astype(np.uint64)[mine]).astype(np.int64)
            segment = np.where(cell < doubled[mine] * WIDE, cell // WIDE, cell - doubled[mine] * (WIDE - 1))
            cell = start[mine] + segment
            total = np.zeros(int(count.sum()), np.uint64)
            np.add.at(total, cell, mixed[at])
            of = np.repeat(np.arange(len(takes)), count)
            place = np.arange(len(total)) - start[of]
            label = scramble((band[takes][of].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
            units.append(2 * takes[of] + shift)
            values.append(scramble(total * MIX2 + label))
            singles.append(place >= doubled[of])
            # one-deletion neighbourhoods of the doubled segments
            twice = np.flatnonzero(segment < doubled[mine])
            less = total[cell[twice]] - mixed[at[twice]]
            units.append(2 * takes[mine[twice]] + shift)
            values.append(scramble(less * MIX2 + label[cell[twice]]))
            singles.append(np.zeros(len(twice), bool))
    return np.concatenate(units), np.concatenate(values), np.concatenate(singles)


def allocated(p: int, n: np.ndarray, unit: np.ndarray, single: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Which signatures that are shared their units keep; ``n`` are the sizes of the sets.

    A unit leaves out the subsets of undoubled segments that LEVELS[i] sets or more have,
    with the least i for which these are no more than its doubled segments.
    """
    size = n.clip(1)
    ends = bands(p, int(size.max(initial=1)))
    ends = np.r_[ends, (ends[-1] + 1) * 100 // p]
    own = np.searchsorted(ends, size)
    room = np.stack([rooms(p, ends[own])[1], rooms(p, ends[own + 1])[1]], axis=1).ravel()
    limit = np.full(len(room), np.iinfo(np.int64).max)
    for level in reversed(LEVELS):
        dear = np.bincount(unit[single & (frequency >= level)], minlength=len(room))
        limit[dear <= room] = level
    return ~single | (frequency < limit[unit])


#: Columns of the rows that go between a block of texts and the buckets. Kind 0: a text with its set; 1 and 2:
#: signatures of a block after and before their bucket counts them; 3: those that several sets of a block have;
#: 4: a set and a group of sets (in node) that have a signature.
COLUMNS = {"kind": "int", "block": "long", "bucket": "int", "rid": "long", "doc": "long", "n": "long", "node": "long", "singles": "int", "keys": "binary", "units": "binary", "counts": "binary", "groups": "binary", "bits": "binary"}
ROWS = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(kind: int, rows: int, **columns: pa.Array | int) -> pa.RecordBatch:
    columns["kind"] = kind
    arrays = []
    for c, t in COLUMNS.items():
        x = columns.get(c)
        x = np.full(rows, x) if isinstance(x, int) else x
        arrays.append(pa.nulls(rows, _ARROW[t]) if x is None else pa.array(x, _ARROW[t]))
    return pa.RecordBatch.from_arrays(arrays, list(COLUMNS))


def sign(docs: DataFrame, id_col: str, text_col: str, k: int, p: int, lower: bool, buckets: int) -> DataFrame:
    """Rows of kinds 0, 2 and 3 of every block of texts; a block sends each bucket a signature once, with the sets that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        for b in slices(batches, text_col, BLOCK, ROW):
            tokens, offsets = shingle_sets(b.column(1), k, lower)
            ids = set_ids(tokens, offsets)
            first = np.unique(ids, return_index=True)[1]
            place = np.zeros(len(ids), np.int64)
            place[first] = np.arange(len(first))
            place = place[first[np.searchsorted(ids[first], ids)]]
            size = np.diff(offsets)
            here = base // ROWS_AT_MOST % buckets
            yield _rows(0, len(ids), block=base, bucket=here, rid=base + place, doc=b.column(0), n=size, node=ids, bits=bitmaps(tokens, offsets))
            kept = np.zeros(len(ids), bool)
            kept[first] = True
            kept &= size > 0
            at = np.flatnonzero(kept)
            if len(at):
                inner = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in at])
                unit, key, single = signatures(tokens[inner], np.r_[0, np.cumsum(size[at])], p)
                unit = 2 * place[at][unit >> 1] + (unit & 1)
                to = (key >> np.uint64(32)) % np.uint64(buckets)
                name = (to << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
                by = np.lexsort((unit, name))
                name, unit, single, to = name[by], unit[by].astype(np.uint16), single[by], to[by].astype(np.int32)
                fresh = np.r_[True, name[1:] != name[:-1]]
                if not fresh.all():
                    yield _rows(3, 1, block=base, bucket=here, keys=[name[~fresh].tobytes()], units=[unit[~fresh].tobytes()])
                count = np.diff(np.r_[np.flatnonzero(fresh), len(name)]).clip(max=255).astype(np.uint8)
                name, unit, single, to = name[fresh].astype(np.uint32), unit[fresh], single[fresh], to[fresh]
                by = np.lexsort((unit, ~single, to))
                name, unit, single, to, count = name[by], unit[by], single[by], to[by], count[by]
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                spans = list(zip(cuts, np.r_[cuts[1:], len(to)], strict=True))
                # rising units are sent as steps, which Spark compresses
                blobs = {"keys": [name[i:j].tobytes() for i, j in spans], "units": [np.diff(unit[i:j], prepend=unit[:1] * 0).tobytes() for i, j in spans], "counts": [count[i:j].tobytes() if count[i:j].max() > 1 else b"" for i, j in spans]}
                yield _rows(2, len(cuts), block=base, bucket=to[cuts], singles=np.add.reduceat(single.astype(np.int32), cuts), **blobs)
            base += ROWS_AT_MOST

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias(text_col))
    return rows.mapInArrow(run, ROWS)


def _read(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of packed arrays, one after another, and the number in each row."""
    blobs = [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]
    return np.concatenate(blobs) if blobs else np.zeros(0, kind), np.array([len(x) for x in blobs], np.int64)


def meet(table: pa.Table) -> pa.Table:
    """A bucket's signatures that more than one set has, for each block, with their frequency and the group of sets; other rows as they are."""
    give_back()
    kind = table.column("kind").to_numpy()
    out = [table.filter(pa.array(kind != 2))]
    table = table.filter(pa.array(kind == 2))
    if table.num_rows:
        key, sizes = _read(table, "keys", np.uint32)
        unit = np.concatenate([np.cumsum(np.frombuffer(x, np.uint16), dtype=np.uint16) for x in table.column("units").to_pylist()])
        count = np.concatenate([np.frombuffer(x, np.uint8) if x else np.ones(n, np.uint8) for x, n in zip(table.column("counts").to_pylist(), sizes.tolist(), strict=True)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes) - sizes
        single = np.arange(len(key)) - ends[row] < table.column("singles").to_numpy()[row]
        block = table.column("block").to_numpy()
        by = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        number = np.empty(len(key), np.int64)
        number[by] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
        frequency = np.add.reduceat(count[by].astype(np.int64), starts)
        # signatures of the same sets have one group
        with np.errstate(over="ignore"):
            sets = scramble((block[row] + (unit >> 1)).astype(np.uint64))
            group = (scramble(np.add.reduceat(sets[by], starts)) >> np.uint64(1)).astype(np.int64)
        on = np.flatnonzero(frequency[number] > 1)
        name = (np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)) | key.astype(np.uint64)
        cuts = np.searchsorted(row[on], np.arange(len(sizes) + 1))
        spans = [(r, i, j) for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        arrays = (("keys", name[on]), ("units", unit[on]), ("counts", frequency[number[on]]), ("groups", group[number[on]]))
        blobs = {c: [x[i:j].tobytes() for _, i, j in spans] for c, x in arrays}
        leading = [int(single[on[i:j]].sum()) for _, i, j in spans]
        out.append(pa.Table.from_batches([_rows(1, len(spans), block=block[[r for r, _, _ in spans]], singles=leading, **blobs)]).cast(out[0].schema))
    return pa.concat_tables(out)


def bitmaps(tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set a bitmap in which every token turns one bit over, about as many bits as tokens.

    Two sets' bitmaps differ in no more bits than the sets in tokens.
    """
    size = np.diff(offsets)
    words = np.where(size >= 64, 1 << np.log2(np.maximum(size // 64, 1)).astype(np.int64), 1)
    start = np.cumsum(words) - words
    owner = np.repeat(np.arange(len(size)), size)
    place = (scramble(tokens ^ MIX2) >> np.uint64(7)) % (64 * words[owner]).astype(np.uint64)
    bits = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(bits, start[owner] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return [bits[a : a + w].tobytes() for a, w in zip(start.tolist(), words.tolist(), strict=True)]


class Group:
    """Sets of a group by their sizes and bitmaps."""

    def __init__(self, p: int, n: np.ndarray, blobs: list[bytes]):
        self.p, self.n = p, n
        self.words = np.array([len(x) // 8 for x in blobs], np.int64)
        self.start = np.cumsum(self.words) - self.words
        self.bits = np.frombuffer(b"".join(blobs), np.uint64)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes and bitmaps of sets a[i] and b[i] allow a link."""
        n, p = self.n, self.p
        less, more = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok = 100 * less >= p * more
        most = (100 - p) * (less + more) // (100 + p)
        wide = np.minimum(self.words[a], self.words[b])
        for w in np.unique(wide[ok]).tolist():
            at = np.flatnonzero(ok & (wide == w))
            for i in range(0, len(at), max(1, PAIR_WORDS // w)):
                part = at[i : i + max(1, PAIR_WORDS // w)]
                ok[part] = np.bitwise_count(self.folded(a[part], w) ^ self.folded(b[part], w)).sum(axis=1, dtype=np.int64) <= most[part]
        return ok

    def folded(self, sets: np.ndarray, w: int) -> np.ndarray:
        """Bitmaps of w words; a wider one is the sum of its parts."""
        out = self.bits[self.start[sets][:, None] + np.arange(w)]
        for k in range(1, int(self.words[sets].max(initial=w)) // w):
            has = np.flatnonzero(self.words[sets] > k * w)
            out[has] ^= self.bits[self.start[sets[has]][:, None] + k * w + np.arange(w)]
        return out


def join_groups(p: int):
    def run(table: pa.Table) -> pa.Table:
        """Of the groups of a bucket a spanning forest of the pairs that bitmaps don't rule out."""
        give_back()
        group, rid = table.column("node").to_numpy(), table.column("rid").to_numpy()
        by = np.lexsort((rid, group))
        starts = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])
        sizes = np.diff(np.r_[starts, len(by)])
        members = by[np.repeat(sizes > 1, sizes)]
        table = table.select(["rid", "n", "bits"]).take(pa.array(members))
        rid, sizes = table.column("rid").to_numpy(), sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        sets = Group(p, table.column("n").to_numpy(), table.column("bits").to_pylist())
        u, v = [], []
        for step in range(1, int(sizes[sizes <= FEW].max(initial=1))):
            some = np.flatnonzero((sizes <= FEW) & (sizes > step))
            a = np.repeat(starts[some], sizes[some] - step)
            a = a + np.arange(len(a)) - np.repeat(np.cumsum(sizes[some] - step) - (sizes[some] - step), sizes[some] - step)
            ok = sets.may_link(a, a + step)
            u.append(rid[a[ok]])
            v.append(rid[a[ok] + step])
        for a, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            if n > MANY:
                u.append(np.full(n - 1, rid[a]))
                v.append(rid[a + 1 : a + n])
                continue
            label = np.arange(n)
            for i in range(n - 1):
                other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                if len(other):
                    near = other[sets.may_link(np.full(len(other), a + i), a + other)]
                    if len(near):
                        u.append(np.full(len(near), rid[a + i]))
                        v.append(rid[a + near])
                        label[np.isin(label, label[near])] = label[i]
        if not u:
            return _edges([], [])
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
        found = np.array(spanning(pairs[:, 0].tolist(), pairs[:, 1].tolist()), np.int64).reshape(-1, 2)
        return _edges(found[:, 0], found[:, 1])

    return run


def allocate(p: int):
    def run(table: pa.Table) -> pa.Table:
        """A block's texts (kind 0), and its sets with the groups that they keep (kind 4)."""
        give_back()
        kind = table.column("kind").to_numpy()
        texts, asked, local = (table.filter(pa.array(kind == k)) for k in (0, 1, 3))
        if not asked.num_rows:
            return texts.set_column(texts.schema.get_field_index("bits"), "bits", pa.nulls(len(texts), pa.binary()))
        base = table.column("block")[0].as_py()
        key, sizes = _read(asked, "keys", np.uint64)
        unit, frequency, group = (_read(asked, c, t)[0] for c, t in (("units", np.uint16), ("counts", np.int64), ("groups", np.int64)))
        row = np.repeat(np.arange(len(sizes)), sizes)
        single = np.arange(len(key)) - (np.cumsum(sizes) - sizes)[row] < asked.column("singles").to_numpy()[row]
        also, more = _read(local, "keys", np.uint64)[0], _read(local, "units", np.uint16)[0]
        if len(also):
            by = np.argsort(key)
            at = by[np.searchsorted(key, also, sorter=by)]
            unit, frequency, group, single = (np.concatenate(x) for x in ((unit, more), (frequency, frequency[at]), (group, group[at]), (single, single[at])))
        place = texts.column("rid").to_numpy() - base
        n = np.zeros(int(place.max()) + 1, np.int64)
        n[place] = texts.column("n").to_numpy()
        unit = unit.astype(np.int64)
        keep = allocated(p, n, unit, single, frequency)
        pairs = np.unique(np.stack([unit[keep] >> 1, group[keep]], axis=1), axis=0)
        of = np.zeros(len(n), np.int64)
        of[place] = np.arange(len(place))
        bits = texts.column("bits").combine_chunks().take(pa.array(of[pairs[:, 0]]))
        edges = pa.Table.from_batches([_rows(4, len(pairs), rid=base + pairs[:, 0], n=n[pairs[:, 0]], node=pairs[:, 1], bits=bits)])
        plain = texts.set_column(texts.schema.get_field_index("bits"), "bits", pa.nulls(len(texts), pa.binary()))
        return pa.concat_tables([plain, edges.cast(plain.schema)])

    return run


def _edges(u: list, v: list) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def similar_forest(tokens: np.ndarray, offsets: np.ndarray, p: int, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with ``part``, of links between different parts only."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    vocab, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.empty(len(vocab), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(vocab))
    code = rank[code]
    owner = np.repeat(np.arange(n), size)
    by = np.lexsort((code, owner))
    code = code[by]  # rarest first in each set
    lead = size - -(-size * p // 100) + 1
    place = np.arange(len(code)) - offsets[:-1][owner]
    fore = np.flatnonzero(place < lead[owner])
    post = fore[np.argsort(code[fore], kind="stable")]
    heads = np.searchsorted(code[post], np.arange(len(vocab) + 1))
    post = owner[post]
    up = np.arange(n)
    members: dict[int, list[int]] = {}
    seen = np.zeros(len(vocab), bool)
    out = []
    for x in np.argsort(size, kind="stable").tolist():
        mine = code[offsets[x] : offsets[x + 1]]
        near = np.concatenate([post[heads[c] : heads[c + 1]] for c in mine[: lead[x]]])
        near = near[(size[near] < size[x]) | (size[near] == size[x]) & (near < x)]
        near = near[(100 * size[near] >= p * size[x])]
        if part is not None:
            near = near[part[near] != part[x]]
        near = np.unique(near)
        near = near[up[near] != up[x]]
        if not len(near):
            continue
        seen[mine] = True
        length = size[near]
        cuts = np.cumsum(length) - length
        at = np.repeat(offsets[near] - cuts, length) + np.arange(int(length.sum()))
        both = np.add.reduceat(seen[code[at]].astype(np.int64), cuts)
        seen[mine] = False
        linked = near[100 * both >= p * (size[x] + length - both)]
        for y in linked.tolist():
            a, b = int(up[x]), int(up[y])
            if a != b:
                out.append((x, y))
                big, less = (a, b) if len(members.get(a, (a,))) >= len(members.get(b, (b,))) else (b, a)
                moved = members.pop(less, [less])
                up[moved] = big
                members.setdefault(big, [big]).extend(moved)
    return out


def verify(p: int):
    def run(table: pa.Table) -> pa.Table:
        give_back()
        blobs = table.column("tokens").to_pylist()
        node = table.column("node").to_numpy()
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs])
        offsets = np.r_[0, np.cumsum([len(x) // 8 for x in blobs])].astype(np.int64)
        part = table.column("part").to_numpy()
        crossed = bool((table.column("i").to_numpy() != table.column("j").to_numpy()).any())
        found = similar_forest(tokens, offsets, p, part if crossed else None)
        return _edges([node[a] for a, _ in found], [node[b] for _, b in found])

    return run


def candidate_sets(docs: DataFrame, text_col: str, k: int, lower: bool, bloom: np.ndarray) -> DataFrame:
    """(node, tokens) of the sets that the filter lets pass, at least once each."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, BLOCK):
            tokens, offsets = shingle_sets(b.column(0), k, lower)
            ids, first = np.unique(set_ids(tokens, offsets), return_index=True)
            at = np.flatnonzero(passing(sent.value, ids) & (ids != 0))
            for a in range(0, len(at), 500):
                part = at[a : a + 500]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array([tokens[offsets[i] : offsets[i + 1]].tobytes() for i in first[part]], pa.binary())], ["node", "tokens"])

    return docs.select(text_col).mapInArrow(run, "node long, tokens binary")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, lower: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc, n, node) of every row, node null for empty sets; and a spanning forest (u, v) of links between different sets."""
    spark = docs.sparkSession
    buckets = max(256, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = sign(docs, id_col, text_col, k, percent, lower, buckets).groupBy("bucket").applyInArrow(meet, ROWS)
    kept = written(met.groupBy("block").applyInArrow(allocate(percent), ROWS).select("kind", "rid", "doc", "n", "node", "bits"), "allocated")
    rows = kept.where("kind = 0").select("doc", "n", "rid", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    grouped = kept.where("kind = 4").select("rid", "n", "node", "bits").groupBy(F.pmod("node", F.lit(buckets)).alias("bucket"))
    roots = connected_components(grouped.applyInArrow(join_groups(percent), "u long, v long"), "candidates")
    whole = roots.select(F.col("node").alias("rid"), "root").unionByName(roots.select(F.col("root").alias("rid"), "root").distinct())
    nodes = rows.where("node is not null").groupBy("rid").agg(F.first("node").alias("node"), F.first("n").alias("n"))
    # copies of a set have one signature each, so all their rows have one root
    nodes = written(whole.join(nodes, "rid").groupBy("node").agg(F.min("root").alias("root"), F.first("n").alias("n")), "candidate-sets")
    sizes = nodes.groupBy("root").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets")).where("sets > 1")
    batches = F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("long")
    blocks = F.ceil(F.col("tokens") * 2 / TOKENS).cast("int")
    nodes = nodes.join(sizes, "root").withColumn("blocks", F.when(F.col("tokens") > TOKENS, blocks).otherwise(1)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    nodes = nodes.withColumn("task", F.when(F.col("blocks") > 1, F.col("root")).otherwise(-1 - batches))
    sets = candidate_sets(docs, text_col, k, lower, bloom_of(nodes.select("node"))).groupBy("node").agg(F.first("tokens").alias("tokens"))
    spread = nodes.select("node", "task", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("node", "task", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    found = spread.join(sets, "node").groupBy("task", "i", "j").applyInArrow(verify(percent), "u long, v long")
    return rows.select("doc", "n", "node"), found


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, lower: bool = True) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    rows, found = links(docs, id_col, text_col, k, percent, lower)
    roots = connected_components(found, "linked")
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc").alias("least"))
    group = F.coalesce("root", "node")
    named = least.join(roots, "node", "left").select("node", group.alias("g"), "least")
    ends = named.groupBy("g").agg(F.min("least").alias("component_id"))
    named = named.join(ends, "g").select("node", "component_id")
    out = rows.join(named, "node", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """All columns of one row of each group of linked rows, that of smallest identifier (null last, ties by row).

    Rows without words are linked with nothing and stay. ``docs`` must be read from files, for rows are
    told apart by their numbers in the reading, which are the same each time. A Bloom filter
    of the numbers that go lets most rows that stay through without a shuffle of their texts.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("row", F.monotonically_increasing_id())
    found, linked = links(rows, "row", names[text_col], k, percent, lower)
    roots = connected_components(linked, "linked")
    member = found.where("node is not null").join(roots, "node", "left").select(F.col("doc").alias("row"), F.coalesce("root", "node").alias("g"))
    member = member.join(rows.select("row", F.col(names[id_col]).alias("id")), "row")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    first = member.groupBy("g").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = written(member.join(first, "g").where(F.col("row") != F.col("first.row")).select("row"), "gone")
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(gone))

    def side(suspect: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = passing(sent.value, b.column("row").to_numpy())
                yield b.filter(pa.array(hit if suspect else ~hit))

        return rows.mapInArrow(run, rows.schema)

    kept = side(False).unionByName(side(True).join(gone, "row", "left_anti"))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
