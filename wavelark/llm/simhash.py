"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most ``THRESHOLD`` (3) of 64 bits differ in at most one bit in one of their two
halves. The lower 31 bits of a half are covered by the anchors of the Hamming code [31, 26]: every point is within its
covering radius, 1, of exactly one anchor, its home. A fingerprint goes to every anchor within the covering radius plus
the half's threshold, 2 bits away, of which there are at most 16; if two halves differ in at most one bit, each
fingerprint therefore meets the other at the other's home. So all anchors are compared, and no link is lost. The other
halves of two that are linked differ in at most 3 bits, so one of their four bytes is the same: an anchor's fingerprints
are dealt out further by each of these bytes, which spreads a crowded anchor over tasks and parts it 256 ways.

Only distinct fingerprints are dealt out, so exact copies never meet. The fingerprints of an anchor and byte are compared
in blocks by XOR and bit counts; of the links found there, those that join what was not yet joined (a spanning forest)
are passed on, so a large group of near copies gives no more rows than it has members. Components come from label
propagation with pointer jumping over these links, written to the shared folder in each round.

Words are maximal runs of anything but ASCII white space, A-Z lower-cased. Null text counts as empty; a text without
words has fingerprint zero, linked like any other; repeated rows and ids are each given their component; null ids never
name a component unless it has no other; an empty table gives no rows; ``keep`` passes all columns through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from . import common

SHINGLE = 3
SEED = 42
#: The two halves of the code, and the bytes of the other half, are made for this.
THRESHOLD = 3
_BITS = 31
#: How many tasks share the documents of one fingerprint in a join, at least.
SALT = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends + 1 - sizes
    ends = ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 15):
        some = [digest(joined[s:e], SEED) for s, e in zip(starts[a : min(n, a + (1 << 15))].tolist(), ends[a : a + (1 << 15)].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):  # so few that a byte can hold the sum
            ones += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("__text")], np.uint64).view(np.int64)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=[*names, "__fingerprint"])

    return run


def _syndrome(points: np.ndarray) -> np.ndarray:
    """XOR of the places (1 to 31) of the bits that are set; 0 for a code word."""
    out = np.zeros(len(points), np.int64)
    for place in range(1, _BITS + 1):
        out ^= np.where((points >> np.uint64(place - 1)) & np.uint64(1), place, 0)
    return out


def anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, anchor) for every anchor within 2 bits, of both halves; an anchor's top bit tells the half."""
    who, keys = [], []
    rows = np.arange(len(fingerprints))
    for half in (0, 1):
        points = (fingerprints >> np.uint64(32 * half)) & np.uint64((1 << _BITS) - 1)
        tag = np.uint64(half << 40)
        wrong = _syndrome(points)
        bit = np.where(wrong > 0, np.uint64(1) << np.maximum(wrong - 1, 0).astype(np.uint64), 0).astype(np.uint64)
        who.append(rows)
        keys.append((points ^ bit) | tag)
        # two bits whose places XOR to the syndrome lead to a code word
        for i in range(1, _BITS + 1):
            j = wrong ^ i
            pick = np.flatnonzero((wrong > 0) & (j > i))
            if len(pick):
                flip = np.uint64(1 << (i - 1)) ^ (np.uint64(1) << (j[pick] - 1).astype(np.uint64))
                who.append(pick)
                keys.append((points[pick] ^ flip) | tag)
    return np.concatenate(who), np.concatenate(keys)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at every anchor of its own, once for each byte of the half that the anchor is not of."""
    for batch in batches:
        own = batch.column("__fingerprint").to_numpy().view(np.uint64)
        who, keys = anchors(own)
        other = own[who] >> np.where(keys >> np.uint64(40), 0, 32).astype(np.uint64)
        for byte in range(4):
            value = (other >> np.uint64(8 * byte)) & np.uint64(255)
            place = (keys << np.uint64(10)) | np.uint64(byte << 8) | value
            yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(own[who].view(np.int64))], names=["anchor", "fingerprint"])


def links(points: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: from each (by breadth-first search) to the one that
    first reached it. Compares blocks of 256 with blocks of 16384 at a time."""
    left, right = [], []
    waiting = points
    while len(waiting) > 1:
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            near = np.full(len(waiting), -1)
            for a in range(0, len(front), 256):
                open_ = np.flatnonzero(near < 0)
                for b in range(0, len(open_), 1 << 14):
                    some = open_[b : b + (1 << 14)]
                    close = np.bitwise_count(waiting[some, None] ^ front[None, a : a + 256]) <= threshold
                    hit = close.any(axis=1)
                    near[some[hit]] = a + close[hit].argmax(axis=1)
            found = near >= 0
            left.append(front[near[found]])
            right.append(waiting[found])
            front, waiting = waiting[found], waiting[~found]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor: the links of each anchor."""
    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def compare(keys: np.ndarray, points: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        many = np.flatnonzero(ends - starts > 1)
        two = many[(ends - starts)[many] == 2]
        a, b = points[starts[two]], points[starts[two] + 1]
        near = np.bitwise_count(a ^ b) <= THRESHOLD
        left, right = [a[near]], [b[near]]
        for k in many[(ends - starts)[many] > 2].tolist():
            one, other = links(points[starts[k] : ends[k]])
            left.append(one)
            right.append(other)
        found = [np.concatenate(x).view(np.int64) for x in (left, right)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["a", "b"]) if len(found[0]) else None

    for batch in batches:
        keys = np.concatenate([held_key, batch.column("anchor").to_numpy()])
        points = np.concatenate([held, batch.column("fingerprint").to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last and (out := compare(keys[:last], points[:last])):
            yield out
        held_key, held = keys[last:], points[last:]
    if len(held_key) and (out := compare(held_key, held)):
        yield out


def components(edges: DataFrame) -> DataFrame:
    """(fingerprint, root) of every fingerprint that has a link: the least of its component.

    Each round gives a node the least label among its own and its neighbours', then that label's own label, until
    nothing changes; the rounds needed grow with the logarithm of the longest chain."""
    # written first: evaluated twice, the two directions could come from different forests
    edges = common.written(edges, "links")
    both = common.written(edges.union(edges.select("b", "a")).toDF("fingerprint", "other").distinct(), "edges")
    labels = common.written(both.groupBy("fingerprint").agg(F.min("other").alias("other")).select("fingerprint", F.least("fingerprint", "other").alias("root")), "labels")
    while True:
        near = both.join(labels.toDF("other", "near"), "other").groupBy("fingerprint").agg(F.min("near").alias("near"))
        # hooking: a root takes the least label that any node of its tree has next to it
        own = labels.join(near, "fingerprint").select("fingerprint", "root", F.least("root", "near").alias("low"))
        hooks = own.groupBy("root").agg(F.min("low").alias("hook"))
        stepped = common.written(own.join(hooks, "root").select("fingerprint", F.least("low", "hook").alias("next"), F.col("root").alias("was")), "labels")
        jump = stepped.select(F.col("fingerprint").alias("next"), F.col("next").alias("far"))
        moved = common.written(stepped.join(jump, "next").select("fingerprint", F.least("next", "far").alias("root"), "was"), "labels")
        labels = moved.select("fingerprint", "root")
        if moved.filter("root <> was").isEmpty():
            return labels


def linked(distinct: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, at least, of the links among distinct fingerprints (__fingerprint)."""
    n = common.parts(distinct.sparkSession)
    dealt = distinct.select("__fingerprint").repartition(n).mapInArrow(_dealt, "anchor long, fingerprint long")
    return dealt.repartition(n, "anchor").sortWithinPartitions("anchor", "fingerprint").mapInArrow(_compared, "a long, b long")


def _components(prints: DataFrame) -> DataFrame:
    """(fingerprint, root, component_id) of every distinct fingerprint in prints (doc_id, __fingerprint). The root is the
    component's own; with repeated or null ids, two components may have one component_id."""
    least = common.written(prints.groupBy("__fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints")
    labels = components(linked(least)).toDF("__fingerprint", "root")
    joined = common.written(least.join(labels, "__fingerprint", "left").select("__fingerprint", F.coalesce("root", "__fingerprint").alias("root"), "least"), "roots")
    first = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(first, "root").select("__fingerprint", F.col("root").alias("__root"), "component_id")


def _salted(prints: DataFrame, found: DataFrame) -> DataFrame:
    """prints joined with what was found of each fingerprint; the rows of a hot one are dealt to SALT tasks."""
    found = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    return prints.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALT)).cast("int")).join(found, ["__fingerprint", "__salt"])


def _fingerprinted(docs: DataFrame, whole: bool) -> DataFrame:
    """A table of doc_id, fingerprint, number of the row and, if asked for, the row itself (__whole)."""
    rows = docs.select(F.struct("*").alias("__whole"), "doc_id", F.col("text").cast("string").alias("__text"))
    names = ["__whole", "doc_id"] if whole else ["doc_id"]
    schema = StructType([rows.schema[c] for c in names]).add("__fingerprint", LongType())
    found = rows.select(*names, "__text").mapInArrow(_fingerprints(names), schema)
    return common.written(found.withColumn("__row", F.monotonically_increasing_id()), "simhash")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    prints = _fingerprinted(docs.select("doc_id", "text"), False)
    found = _salted(prints, _components(prints).select("__fingerprint", "component_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """The document of least id of each component, its columns unchanged; of rows with that very id, the one whose text
    has the least hash."""
    rows = _fingerprinted(docs, True)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("__whole.text").alias("tie"), "__row")
    # one row for each fingerprint before any join
    small = rows.groupBy("__fingerprint").agg(F.min(order).alias("first"))
    found = small.join(_components(rows.select("doc_id", "__fingerprint")), "__fingerprint")
    first = found.groupBy("__root").agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(first, "__row", "left_semi").select("__whole.*")
