"""The verbs of value-change streams.

Rows are (stream_id, t, seq, value columns); seq orders rows of the same time. Values are told from their absence by a
struct around them. Probes are (probe, stream_id, t). Each verb is one shuffle by stream at most; time filters are on the
raw column, below every window, where the scan can use them.

Verbs that look at neighbours take bucket, a number of ticks (of seq, in ``unsorted``) after which a stream is cut, so
that a hot stream is spread over tasks; what a cut parts is carried over through a table of one row per stream and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import slice_bits
from ..functions.timing import WHOLE, TimeRange, within
from ..sources.scratch import scratch_dir

KEYS = ("stream_id", "t", "seq")
#: The order of a merge.
MERGE = ("t", "source", "seq")


def values(changes: DataFrame) -> list[str]:
    return [c for c in changes.columns if c not in KEYS]


def _cut(column: Column, bucket: int | None) -> Column:
    return F.coalesce(F.floor(column / bucket), F.lit(WHOLE.begin)) if bucket else F.lit(0).cast("bigint")


def _beside(rows: DataFrame, keys: list[str], order: list[str], value: Column, after: bool, cut: Column, bucket: int | None) -> DataFrame:
    """rows with a column beside: the value (a struct) of the row before, or after, in the order within the keys; cut never
    falls in that order."""
    step = F.lead if after else F.lag
    rows = rows.withColumns({"cut": cut, "own": value})
    found = rows.withColumn("beside", step("own").over(Window.partitionBy(*keys, "cut").orderBy(*order)))
    if bucket:
        edge = rows.groupBy(*keys, "cut").agg((F.min if after else F.max)(F.struct(*order, "own")).alias("edge"))
        carried = edge.select(*keys, "cut", step("edge.own").over(Window.partitionBy(*keys).orderBy("cut")).alias("carried"))
        found = found.join(carried, [*keys, "cut"]).withColumn("beside", F.coalesce("beside", "carried")).drop("carried")
    return found.drop("cut", "own")


def in_range(changes: DataFrame, time: TimeRange = WHOLE, streams: list[int] | DataFrame | None = None) -> DataFrame:
    """Real changes in the range, of the streams, if any are given as a list or as a table with a column stream_id;
    nothing is carried in."""
    picked = changes.filter(within(F.col("t"), time))
    if isinstance(streams, DataFrame):
        return picked.join(streams.select("stream_id").distinct(), "stream_id", "left_semi").select(*changes.columns)
    return picked if streams is None else picked.filter(F.col("stream_id").isin(streams))


def ordered(rows: DataFrame, *order: str) -> DataFrame:
    """rows in one total order, by default that of a merge: by t, source and seq. Dealt by ranges, so no task sorts all."""
    return rows.orderBy(*(order or MERGE))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their place in the order, from 0. Ranges are sorted and written to a scratch table; only the number of
    rows of each range goes through the driver."""
    order = order or MERGE
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range_row", F.monotonically_increasing_id())
    path = scratch_dir(spark, "numbered")
    dealt.write.option("compression", "zstd").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    part = F.shiftright("range_row", 33).cast("int")
    begins, total = [], 0
    for r in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():
        begins.append((r.part, total))
        total += r["count"]
    known = spark.createDataFrame(begins, "range_part int, range_begin bigint")
    place = F.col("range_begin") + F.col("range_row").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("range_part", part).join(known, "range_part").select(*rows.columns, place.alias(name))


def snapshot(changes: DataFrame, at: int) -> DataFrame:
    """The last value of each stream at or before a time; streams without one are absent."""
    last = F.max(F.struct("t", "seq", F.struct(*values(changes)).alias("v"))).alias("last")
    return changes.filter(F.col("t") <= at).groupBy("stream_id").agg(last).select("stream_id", F.col("last.t").alias("t"), "last.v.*")


def _both(changes: DataFrame, probes: DataFrame, probes_first: bool) -> DataFrame:
    seq = changes.schema["seq"].dataType
    given = changes.select("stream_id", "t", F.lit(int(probes_first)).alias("kind"), "seq", F.struct(*values(changes)).alias("v"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"))
    asked = probes.select("stream_id", "t", F.lit(1 - int(probes_first)).alias("kind"), F.lit(None).cast(seq).alias("seq"), F.lit(None).cast(given.schema["v"].dataType).alias("v"), "probe")
    return given.unionByName(asked).withColumn("asked", F.col("kind") == 1 - int(probes_first))


def as_of(changes: DataFrame, probes: DataFrame, strict: bool = False, bucket: int | None = None) -> DataFrame:
    """For each probe the last change at or before its time (strict: before it), or nulls."""
    rows = _both(changes, probes, strict).withColumn("bucket", _cut(F.col("t"), bucket))
    change = F.when(~F.col("asked"), F.struct("t", "seq", "v"))
    order = Window.partitionBy("stream_id", "bucket").orderBy("t", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("found", F.last(change, ignorenulls=True).over(order))
    if bucket:
        ends = rows.groupBy("stream_id", "bucket").agg(F.max(change).alias("end"))
        before = Window.partitionBy("stream_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("stream_id", "bucket", F.last("end", ignorenulls=True).over(before).alias("carried"))
        found = found.join(ends, ["stream_id", "bucket"]).withColumn("found", F.coalesce("found", "carried"))
    return found.filter("asked").select("probe", "stream_id", "t", F.col("found.t").alias("change_t"), "found.v.*")


def following(changes: DataFrame, probes: DataFrame, bucket: int | None = None) -> DataFrame:
    """For each probe the first change after its time, or nulls."""
    rows = _both(changes, probes, False).withColumn("bucket", _cut(F.col("t"), bucket))
    change = F.when(~F.col("asked"), F.struct("t", "seq", "v"))
    order = Window.partitionBy("stream_id", "bucket").orderBy("t", "kind", "seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = rows.withColumn("found", F.first(change, ignorenulls=True).over(order))
    if bucket:
        begins = rows.groupBy("stream_id", "bucket").agg(F.min(change).alias("begin"))
        later = Window.partitionBy("stream_id").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
        begins = begins.select("stream_id", "bucket", F.first("begin", ignorenulls=True).over(later).alias("carried"))
        found = found.join(begins, ["stream_id", "bucket"]).withColumn("found", F.coalesce("found", "carried"))
    return found.filter("asked").select("probe", "stream_id", "t", F.col("found.t").alias("change_t"), "found.v.*")


def next_change(changes: DataFrame, after: int) -> DataFrame:
    return changes.filter(F.col("t") > after).groupBy("stream_id").agg(F.min("t").alias("t"))


def prev_change(changes: DataFrame, before: int) -> DataFrame:
    return changes.filter(F.col("t") < before).groupBy("stream_id").agg(F.max("t").alias("t"))


def settled(changes: DataFrame) -> DataFrame:
    """The last value of each stream at each of its times."""
    last = F.max(F.struct("seq", F.struct(*values(changes)).alias("v"))).alias("last")
    return changes.groupBy("stream_id", "t").agg(last).select("stream_id", "t", "last.seq", "last.v.*")


def held(changes: DataFrame, bucket: int | None = None) -> DataFrame:
    """Each settled value with the time it holds until (t_end, null for the last)."""
    rows = settled(changes)
    found = _beside(rows, ["stream_id"], ["t"], F.struct("t"), True, _cut(F.col("t"), bucket), bucket)
    return found.select(*rows.columns, F.col("beside.t").alias("t_end"))


def _changed(rows: DataFrame, keys: list[str], bucket: int | None = None) -> DataFrame:
    """Rows whose bits differ from those of the row before; the first row is a change."""
    found = _beside(rows, keys, ["t", "seq"], F.struct("bits"), False, _cut(F.col("t"), bucket), bucket)
    return found.filter(F.col("beside").isNull() | ~F.col("beside.bits").eqNullSafe(F.col("bits"))).select(*rows.columns)


def sliced(changes: DataFrame, slices: DataFrame) -> DataFrame:
    """Logic rows of each slice (slice, stream_id, slice_offset, slice_width), not yet told from repeats."""
    return changes.filter("bits IS NOT NULL").join(slices, "stream_id").select("slice", "stream_id", "t", "seq", slice_bits("bits", F.col("slice_offset"), F.col("slice_width")).alias("bits"))


def slice_changes(changes: DataFrame, slices: DataFrame, time: TimeRange = WHOLE, bucket: int | None = None) -> DataFrame:
    """Changes of bit slices in the range. The scan is of the range and, per stream, of the last row before it."""
    rows = in_range(changes, time).select(*KEYS, "bits")
    if time.begin > WHOLE.begin:
        carried = changes.filter((F.col("t") < time.begin) & F.col("bits").isNotNull()).groupBy("stream_id").agg(F.max(F.struct("t", "seq", "bits")).alias("c"))
        rows = rows.unionByName(carried.select("stream_id", "c.t", "c.seq", "c.bits"))
    return _changed(sliced(rows, slices), ["slice"], bucket).filter(F.col("t") >= time.begin)


def slice_edges(changes: DataFrame, slices: DataFrame, bucket: int | None = None) -> DataFrame:
    """Times at which the settled value of a slice changes; a glitch within one time is none."""
    return _changed(sliced(settled(changes.filter("bits IS NOT NULL").select(*KEYS, "bits")), slices), ["slice"], bucket)


def merged(changes: DataFrame, request: DataFrame, time: TimeRange = WHOLE) -> DataFrame:
    """Changes of the requested streams (source, stream_id), tagged with the source, in no order: ``ordered`` and
    ``numbered`` give that of a merge. A stream asked for twice comes twice; one that is unknown keeps its number and has
    no rows."""
    rows = in_range(changes, time)
    return rows.join(request, "stream_id").select("source", *changes.columns)


def mixed(changes: DataFrame, plain: DataFrame, slices: DataFrame, time: TimeRange = WHOLE) -> DataFrame:
    """As merged, of plain streams (source, stream_id) and slices (source, slice, stream_id, slice_offset, slice_width)."""
    one = merged(changes, plain, time).select("source", "t", "seq", *values(changes))
    two = slice_changes(changes, slices, time).join(slices.select("slice", "source"), "slice").select("source", "t", "seq", "bits")
    return one.unionByName(two, allowMissingColumns=True)


def composite(snapshots: DataFrame, leaves: DataFrame) -> DataFrame:
    """An ordered array of child values for each composite (composite, ord, stream_id); children without one are null."""
    v = F.struct("ord", F.struct(*(c for c in snapshots.columns if c not in KEYS)).alias("v"))
    rows = leaves.join(snapshots, "stream_id", "left").groupBy("composite").agg(F.sort_array(F.collect_list(v)).alias("items"))
    return rows.select("composite", F.transform("items", lambda x: x["v"]).alias("values"))


def composite_next(changes: DataFrame, leaves: DataFrame, after: int) -> DataFrame:
    return leaves.join(next_change(changes, after), "stream_id").groupBy("composite").agg(F.min("t").alias("t"))


def composite_prev(changes: DataFrame, leaves: DataFrame, before: int) -> DataFrame:
    return leaves.join(prev_change(changes, before), "stream_id").groupBy("composite").agg(F.max("t").alias("t"))


def time_range(changes: DataFrame) -> DataFrame:
    """[first time, last time + 1); nulls if there is no change."""
    return changes.agg(F.min("t").alias("t_begin"), (F.max("t") + 1).alias("t_end"))


def density(changes: DataFrame, time: TimeRange = WHOLE) -> DataFrame:
    return in_range(changes, time).groupBy("stream_id").agg(F.count("*").alias("n"))


def blocks(changes: DataFrame, size: int = 4096, bucket: int | None = None) -> DataFrame:
    """Every size changes of a stream: the time they span, and how many they are."""
    rows = changes.select("stream_id", "t", "seq", _cut(F.col("t"), bucket).alias("cut"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("stream_id", "cut").orderBy("t", "seq")) - 1)
    if bucket:
        before = Window.partitionBy("stream_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
        begins = rows.groupBy("stream_id", "cut").agg(F.count("*").alias("n")).select("stream_id", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
        rows = rows.join(begins, ["stream_id", "cut"]).withColumn("place", F.col("place") + F.col("begin"))
    return rows.groupBy("stream_id", F.floor(F.col("place") / size).alias("block")).agg(F.min("t").alias("t_begin"), F.max("t").alias("t_end"), F.count("*").alias("n"))


def sub_block(changes: DataFrame, low: int, high: int, bucket: int | None = None) -> DataFrame:
    """The changes at places low (inclusive) to high (exclusive) of each stream, as a slice of a decoded block has them."""
    rows = changes.withColumn("cut", _cut(F.col("t"), bucket))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("stream_id", "cut").orderBy("t", "seq")) - 1)
    if bucket:
        before = Window.partitionBy("stream_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
        begins = rows.groupBy("stream_id", "cut").agg(F.count("*").alias("n")).select("stream_id", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
        rows = rows.join(begins, ["stream_id", "cut"]).withColumn("place", F.col("place") + F.col("begin"))
    return rows.filter((F.col("place") >= low) & (F.col("place") < high)).select(*changes.columns)


def unsorted(changes: DataFrame, bucket: int | None = None) -> DataFrame:
    """Rows whose time is before that of the row written before them, within their stream."""
    found = _beside(changes, ["stream_id"], ["seq", "t"], F.struct("t"), False, _cut(F.col("seq"), bucket), bucket)
    return found.withColumn("before_t", F.col("beside.t")).drop("beside").filter("t < before_t")


def violations(changes: DataFrame, streams: DataFrame) -> DataFrame:
    """Rows that break a rule of ingestion, with the rule: no time, unknown stream, wrong kind, wrong width."""
    known = streams.select("stream_id", "kind", "width")
    kind = F.when(F.col("bits").isNotNull(), "logic").when(F.col("real").isNotNull(), "real").when(F.col("str").isNotNull(), "string")
    rule: Column = F.when(F.col("t").isNull(), "no time").when(F.col("kind").isNull(), "unknown stream").when(~kind.eqNullSafe(F.col("kind")), "wrong kind").when((F.col("kind") == "logic") & (F.length("bits") != F.col("width")), "wrong width")
    return changes.join(known, "stream_id", "left").withColumn("rule", rule).filter("rule IS NOT NULL").select(*changes.columns, "rule")
