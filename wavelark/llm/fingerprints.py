"""One-permutation MinHash of word shingles, in DataFrame functions alone.

Every shingle (``SHINGLE`` words; a text of fewer words is one shingle) is hashed once; the top bits choose one of
``BINS`` bins, and each bin keeps its least hash. An empty bin borrows from the first filled bin of its own fixed random
order of all bins (optimal densification). The low ``BITS`` bits of each bin are the fingerprint, in hex; likeness is the
share of equal bins, corrected for those equal by chance (2^-BITS).

All of it happens within a row; only ``edited`` shuffles texts, once, by ranges of id and hash of the text, whose bounds
come from the ids and hashes alone: sparse, repeated and null ids are cut into even ranges like dense ones. Each range
also gets the first row of the range that follows, so that every row finds its next one within its range. Null text
counts as empty; the empty text has one empty shingle, so that two empty texts are alike; equal texts have equal
fingerprints; repeated rows and ids each give a row (ordered by id, then hash of the text); null ids come last in
descending order; an empty table gives no rows; other columns are ignored. Rows that are equal in id and text are not
told apart, so they are one range at least.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
#: A power of two.
BINS = 128
BITS = 8
_SHIFT = 64 - (BINS.bit_length() - 1)
#: Ranges of ids for each partition of a shuffle; as many keys go to the driver and to every task, whatever the table.
RANGES = 4


def _orders() -> Column:
    """For each bin, its own order of all bins."""
    rng = np.random.Generator(np.random.PCG64(20))
    return F.from_json(F.lit(json.dumps([rng.permutation(BINS).tolist() for _ in range(BINS)])), "array<array<int>>")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with an array of BINS small numbers in column out; names that begin with out are taken."""
    words, hashes, least, bins = (f"{out}_{x}" for x in ("words", "hashes", "least", "bins"))
    df = df.withColumn(words, common.words(F.col(text)))
    w, n = F.col(words), F.size(words)
    shingles = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(w[i + k] for k in range(SHINGLE))))
    df = df.withColumn(hashes, F.sort_array(F.when(n < SHINGLE, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(shingles)))
    h = F.col(hashes)
    of = lambda x: F.shiftrightunsigned(x, _SHIFT)
    df = df.withColumn(least, F.filter(h, lambda x, i: (i == 0) | (of(x) != of(F.get(h, i - 1)))))
    df = df.withColumn(bins, F.transform(least, lambda x: of(x).cast("int")))
    low = F.transform(least, lambda x: x.bitwiseAND((1 << BITS) - 1).cast("int"))
    df = df.withColumn(f"{out}_low", low)
    at, orders = F.col(bins), _orders()
    own = lambda b: F.array_position(at, b)
    found = lambda b: F.when(own(b) > 0, own(b)).otherwise(F.array_position(at, F.array_intersect(F.get(orders, b), at)[0]))
    value = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(F.col(f"{out}_low"), (found(b) - 1).cast("int")))
    return df.withColumn(out, value).drop(words, hashes, least, bins, f"{out}_low")


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the two shingle sets, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(BINS)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def _place(doc_id: Column, tie: Column) -> Column:
    """Greatest first is the order of the rows: descending ids, null ids last, descending hashes."""
    return F.struct(doc_id.isNotNull().alias("known"), doc_id.alias("doc_id"), tie.alias("tie"))


def _ranges(rows: DataFrame) -> list[tuple[dict, dict]]:
    """The first and last place of even ranges of the rows (doc_id, tie), in order."""
    n = RANGES * common.parts(rows.sparkSession)
    dealt = rows.select("doc_id", "tie").repartitionByRange(n, F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    place = _place(F.col("doc_id"), F.col("tie"))
    found = dealt.withColumn("range", F.spark_partition_id()).groupBy("range").agg(F.max(place).alias("first"), F.min(place).alias("last")).collect()
    return [(r["first"].asDict(), r["last"].asDict()) for r in sorted(found, key=lambda r: r["range"])]


def _range_of(lasts: list[dict], kind: str) -> Column:
    """How many of the ranges' last places the row comes after, by binary search."""
    if not lasts:
        return F.lit(0)
    bounds = F.from_json(F.lit(json.dumps(lasts, default=str)), f"array<struct<known:boolean,doc_id:{kind},tie:bigint>>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(lasts).bit_length()))))
    after = lambda at: (at <= len(lasts)) & (_place(F.col("doc_id"), F.col("tie")) < F.get(bounds, at - 1))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(after(at + step), at + step).otherwise(at))


def edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the last third replaced by the start of the next document (by
    descending id; after the last, the first), and the likeness of its own to that and to the next document's."""
    text, kind = F.coalesce(F.col("text").cast("string"), F.lit("")), docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    ranges = _ranges(rows)
    begins = [first for first, _ in ranges]
    guests = [(i, x["doc_id"], x["tie"]) for i, x in enumerate(begins[1:] + begins[:1])]
    guests = docs.sparkSession.createDataFrame(guests, f"range int, guest_id {kind}, guest_tie bigint")
    # as many as there are ranges, which no table makes more
    guests = F.broadcast(guests)
    found = rows.join(guests, rows["doc_id"].eqNullSafe(F.col("guest_id")) & (F.col("tie") == F.col("guest_tie")))
    found = found.select("range", "doc_id", "text", "tie").dropDuplicates(["range"]).withColumn("guest", F.lit(1))
    own = rows.select(_range_of([last for _, last in ranges], kind).alias("range"), "doc_id", "text", "tie", F.lit(0).alias("guest"))
    both = with_fingerprint(own.unionByName(found).repartition("range"), "text", "own")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    both = both.withColumn("next", F.lead(F.struct("text", "own")).over(order)).filter("guest = 0")
    cut = F.floor(F.length("text") / 3).cast("int")
    text = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.col("next.text"), F.lit(1), cut))
    both = both.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "own", F.col("next.own").alias("after"), text.alias("edited"))
    both = with_fingerprint(both, "edited", "changed")
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), hexed(F.col("own")).alias("fingerprint"), hexed(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))
