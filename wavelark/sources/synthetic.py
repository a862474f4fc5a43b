"""A synthetic waveform for measurements: streams that toggle at different rates, made by Spark from their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ticks between changes, and the percentage of streams up to which they hold.
PERIODS = ((2, 2), (8, 10), (64, 40), (1024, 100))
WIDTHS = (1, 8, 16, 32, 64)
REAL_EVERY = 64


def waveform(spark: SparkSession, streams: int = 1024, ticks: int = 200_000, seed: int = 1) -> DataFrame:
    """stream_id, t, seq, bits, real, str: about 5.2 million changes at the given size; one stream of each REAL_EVERY is of
    reals, and the one after it of strings."""
    share = F.col("stream_id") * 100 / streams
    period = F.when(share < PERIODS[0][1], PERIODS[0][0])
    for ticks_apart, upto in PERIODS[1:]:
        period = period.when(share < upto, ticks_apart)
    width = F.get(F.array(*map(F.lit, WIDTHS)), F.col("stream_id") % len(WIDTHS))
    rows = spark.range(streams).select(F.col("id").cast("int").alias("stream_id")).withColumns({"period": period, "width": width})
    rows = rows.repartition(spark.sparkContext.defaultParallelism).select("stream_id", "width", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1), F.col("period"))).alias("at"))
    rows = rows.select("stream_id", "width", F.col("at").cast("bigint").alias("t"))
    draw = F.xxhash64("stream_id", "t", F.lit(seed))
    bits = F.right(F.lpad(F.bin(draw), 64, "0"), F.col("width"))
    bits = F.when(F.pmod(draw, F.lit(997)) == 0, F.repeat(F.lit("x"), F.col("width"))).otherwise(bits)
    kind = F.col("stream_id") % REAL_EVERY
    real = F.when(kind == REAL_EVERY - 2, F.pmod(draw, F.lit(10_000)) / 16)
    text = F.when(kind == REAL_EVERY - 1, F.concat(F.lit("state"), F.pmod(draw, F.lit(12)).cast("string")))
    bits = F.when(kind < REAL_EVERY - 2, bits)
    return rows.select("stream_id", "t", (F.col("t") * streams + F.col("stream_id")).alias("seq"), bits.alias("bits"), real.alias("real"), text.alias("str"))


def wide_design(spark: SparkSession, arrays: int = 4, elements: int = 250_000) -> DataFrame:
    """nodes of unpacked arrays, a row for each array and element: node_id, name, scope_id, parent_id, stream_id, ord."""
    n = arrays * elements
    tops = spark.range(arrays).select("id", F.concat(F.lit("mem"), F.col("id")).alias("name"), F.lit(0).cast("bigint").alias("scope_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(None).cast("bigint").alias("stream_id"), F.col("id").alias("ord"))
    cells = spark.range(n).select((F.col("id") + arrays).alias("id"), F.concat(F.lit("["), F.col("id") % elements, F.lit("]")).alias("name"), F.lit(None).cast("bigint").alias("scope_id"), F.floor(F.col("id") / elements).alias("parent_id"), F.col("id").alias("stream_id"), (F.col("id") % elements).alias("ord"))
    return tops.unionByName(cells).withColumnRenamed("id", "node_id")
