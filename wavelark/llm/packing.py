"""Best-fit packing of documents into sequences of fixed length, under constraints.

Documents are dealt into groups of about ``GROUP`` by a hash of id, cluster, length, source and, where rows repeat one
another, number of the copy, so that no source or cluster of copies meets in one group and the same rows give the same
bins however they are partitioned. In a group, documents go from longest to shortest into open bins, which are ordered by residual: the search
begins at the least residual that fits and continues until it finds a bin that does not conflict, the tightest one there
is. Every bin carries bitmaps of its sources and of its clusters of copies: a bin takes no two documents of a cluster,
and of a source no more than if its documents were spread over as many bins as the group needs at least.

A document longer than a bin fills whole bins, and its rest is packed like any other. Lengths are words plus one end
mark. A cluster is the documents of one text, or of one value of a column of clusters if that is named (a null there is
a cluster of its text). Null or empty text has the end mark alone; a null source is a source of its own, as a null id is
an id; repeated rows are each packed, as copies; an empty table gives no rows; other columns are ignored. Ids and sources
come out as they went in, of whatever type: they pass through Arrow alone.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
#: Documents packed together, about.
GROUP = 8192


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, first token, tokens, bin, place in the bin) of every piece."""
    least_bins = max(1, -(-sum(lengths) // capacity))
    numbers = Counter(sources)
    source_bit = {s: i for i, s in enumerate(numbers)}
    limit = {s: max(1, -(-n // least_bins)) for s, n in numbers.items()}
    cluster_bit = {c: i for i, c in enumerate(c for c, n in Counter(clusters).items() if n > 1)}
    pieces: list[tuple[int, int, int, int, int]] = []
    open_bins: list[tuple[int, int]] = []
    planes: list[list[int]] = []  # of each bin: plane k has the bits of the sources with more than k documents
    copies: list[int] = []

    def new() -> int:
        planes.append([])
        copies.append(0)
        return len(planes) - 1

    order = sorted(range(len(lengths)), key=lambda i: -(lengths[i] % capacity))
    shortest = min((n % capacity for n in lengths if n % capacity), default=0)
    for i in order:
        whole, rest = divmod(lengths[i], capacity)
        for k in range(whole):
            pieces.append((i, k * capacity, capacity, new(), 0))
        if not rest:
            continue
        own, plane = 1 << source_bit[sources[i]], limit[sources[i]] - 1
        copy = 1 << cluster_bit[clusters[i]] if clusters[i] in cluster_bit else 0
        for at in range(bisect.bisect_left(open_bins, (rest, -1)), len(open_bins)):
            residual, b = open_bins[at]
            if not copies[b] & copy and not (len(planes[b]) > plane and planes[b][plane] & own):
                del open_bins[at]
                break
        else:
            residual, b = capacity, new()
        pieces.append((i, whole * capacity, rest, b, capacity - residual))
        copies[b] |= copy
        level = next((k for k, bits in enumerate(planes[b]) if not bits & own), len(planes[b]))
        if level == len(planes[b]):
            planes[b].append(0)
        planes[b][level] |= own
        if residual - rest >= shortest:
            bisect.insort(open_bins, (residual - rest, b))
    return pieces


def _packer(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "cluster", "length", "source")])
        pieces = best_fit(table["length"].to_pylist(), table["source"].to_pylist(), table["cluster"].to_pylist(), capacity)
        at, start, length, bins, place = zip(*pieces, strict=True)
        picked = table.select(["doc_id", "source", "cluster"]).take(pa.array(at, pa.int64()))
        first = key[0].as_py() << 32
        numbers = {"doc_start": start, "length": length, "bin": [first + b for b in bins], "bin_start": place}
        for name, column in numbers.items():
            picked = picked.append_column(name, pa.array(column, pa.int64()))
        return picked

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, cluster: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, source, cluster (hash of the text), doc_start, length, bin, bin_start (in tokens).

    cluster: the column that tells near-duplicates, if not the text does."""
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    if cluster is not None:
        own = F.when(F.col(cluster).isNull(), own).otherwise(F.xxhash64(cluster))
    rows = docs.select("doc_id", "source", (F.size(common.words(F.col("text").cast("string"))) + 1).cast("bigint").alias("length"), own.alias("cluster"))
    rows = common.written(common.copies(rows), "lengths")
    groups = max(1, -(-rows.count() // group))
    rows = rows.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "cluster", "length", "source", "copy"), F.lit(groups)))
    kind, source = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    return rows.groupBy("dealt").applyInArrow(_packer(capacity), f"doc_id {kind}, source {source}, cluster long, doc_start long, length long, bin long, bin_start long")
