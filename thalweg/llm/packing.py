"""Conflict-constrained best-fit packing of documents into token bins.

Documents are cut into pieces of at most ``capacity`` tokens (a longer document
has full pieces, which are bins of their own, and a rest). The pieces that are
left are dealt into shards and packed in each shard on its own, longest first. A
bin carries a bitmap of its sources and one of its duplicate clusters; a piece
conflicts with a bin that has its source or its cluster. Bins of one residual and
one pair of bitmaps stand together, and a bit set of the residuals in use gives
the successor of any residual: from the tightest residual that a piece fits in,
the search goes on to the next until a bin without conflict is found, or a bin is
opened. So each piece goes to the tightest compatible bin of its shard.

A shard has a bounded number of pieces, dealt evenly by hash, so one source or
cluster with a third of all documents makes no task larger. Clusters are the
groups of documents with equal words (lower-cased) where no column (``cluster_col``,
as of the near-duplicate operator) names them.

Results for the odd cases: documents with no tokens (null, empty, blank) have no
place in a bin and give one row with bin null and 0 tokens; a null source or
cluster conflicts with none; repeated rows are documents of their own, of one
cluster; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import give_back, slices, split

CAPACITY = 4096
#: Pieces packed together.
SHARD = 4000


class Bins:
    """Open bins of a shard, ordered by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.used = 0  #: bit r is set if a bin has residual r
        self.by_residual: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.count = 0

    def _put(self, residual: int, bitmaps: tuple[int, int], number: int) -> None:
        self.by_residual.setdefault(residual, {}).setdefault(bitmaps, []).append(number)
        self.used |= 1 << residual

    def place(self, size: int, source: int, cluster: int) -> int:
        """Number of the bin for a piece; source and cluster are bit masks, 0 for none."""
        left = self.used >> size << size
        while left:
            residual = (left & -left).bit_length() - 1
            groups = self.by_residual[residual]
            for bitmaps, bins in groups.items():
                if not (bitmaps[0] & source or bitmaps[1] & cluster):
                    number = bins.pop()
                    if not bins:
                        del groups[bitmaps]
                        if not groups:
                            del self.by_residual[residual]
                            self.used &= ~(1 << residual)
                    self._put(residual - size, (bitmaps[0] | source, bitmaps[1] | cluster), number)
                    return number
            left &= left - 1
        number, self.count = self.count, self.count + 1
        self._put(self.capacity - size, (source, cluster), number)
        return number


def _masks(values: list) -> list[int]:
    """A bit for each value; a value that is there once only conflicts with none, nor does null."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    bit = {v: 1 << k for k, v in enumerate(v for v, n in seen.items() if n > 1 and v is not None)}
    return [bit.get(v, 0) for v in values]


def pack_pieces(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each piece, in the order given."""
    source, cluster, bins = _masks(sources), _masks(clusters), Bins(capacity)
    return [bins.place(n, s, c) for n, s, c in zip(sizes, source, cluster, strict=True)]


def word_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, cluster_col: str | None = None) -> DataFrame:
    """(id, source, tokens, cluster): words as tokens, and the cluster column's value or a hash of the lower-cased words."""
    if cluster_col is not None:

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(split(b.column(2)).lengths), b.column(3)], ["id", "source", "tokens", "cluster"])

        named = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias(text_col), F.col(cluster_col).alias("cluster"))
        kinds = {c: named.schema[c].dataType.simpleString() for c in ("id", "cluster")}
        return named.mapInArrow(sizes, f"id {kinds['id']}, source string, tokens long, cluster {kinds['cluster']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            words = split(b.column(2), lower=True)
            data = words.vocab.to_pylist()
            codes = words.codes.tolist()
            cluster = [xxhash.xxh3_64_intdigest(b" ".join([data[c] for c in codes[x:y]])) - (1 << 63) if y > x else None for x, y in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words.lengths), pa.array(cluster, pa.int64())], ["id", "source", "tokens", "cluster"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias(text_col))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, source string, tokens long, cluster long")


def best_fit(sized: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(id, piece, first, tokens, bin) of all pieces of rows (id, source, tokens, cluster); bin is a string."""
    kind = sized.schema["id"].dataType.simpleString()
    whole = F.floor(F.col("tokens") / capacity)
    pieces = sized.withColumn("rest", F.col("tokens") % capacity)
    # rows are numbered by their place in the reading, so that repeated rows have full bins of their own
    lone = pieces.withColumn("h", F.monotonically_increasing_id()).where(whole > 0).select("id", "h", F.posexplode(F.array_repeat(F.lit(capacity).cast("long"), whole.cast("int"))).alias("piece", "size"))
    lone = lone.select("id", F.col("piece").cast("long"), (F.col("piece") * capacity).cast("long").alias("first"), F.col("size").alias("tokens"), F.concat_ws("-", F.lit("full"), F.hex("h"), "piece").alias("bin"))
    none = sized.where("tokens = 0").select("id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("bin"))
    rest = pieces.where("rest > 0").select("id", "source", "cluster", whole.cast("long").alias("piece"), (whole * capacity).cast("long").alias("first"), F.col("rest").alias("tokens"))
    shards = max(1, -(-rest.count() // shard))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("id", "source", "tokens", "cluster", "first"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        give_back()
        # longest first; ties by all that tells pieces apart, so that a repeated run gives the same bins
        order = sorted(range(table.num_rows), key=lambda k, t=table.column("tokens").to_pylist(), i=table.column("id").to_pylist(), c=table.column("cluster").to_pylist(), s=table.column("source").to_pylist(): (-t[k], str(i[k]), str(c[k]), str(s[k])))
        table = table.take(pa.array(order, pa.int64()))
        bins = pack_pieces(table.column("tokens").to_pylist(), table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity)
        name = table.column("shard")[0].as_py() if table.num_rows else 0
        return pa.table({"id": table.column("id"), "piece": table.column("piece"), "first": table.column("first"), "tokens": table.column("tokens"), "bin": pa.array([f"{name}-{b}" for b in bins], pa.string())})

    packed = rest.groupBy("shard").applyInArrow(run, f"id {kind}, piece long, first long, tokens long, bin string")
    return packed.unionByName(lone).unionByName(none)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, cluster_col: str | None = None) -> DataFrame:
    """(id, piece, first_token, n_tokens, bin_id) of every document."""
    # sizes are read three times, texts once
    rows = best_fit(written(word_sizes(docs, id_col, text_col, source_col, cluster_col), "sizes"), capacity)
    return rows.select(F.col("id").alias(id_col), "piece", F.col("first").alias("first_token"), F.col("tokens").alias("n_tokens"), F.col("bin").alias("bin_id"))
