"""Export of merged changes as text: a line for each time, then one for each change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def firsts(rows: DataFrame, *order: str) -> DataFrame:
    """t and the least values of the order at it: the rows that a new time begins with. Partial least values meet, so a
    time at which every stream changes is no more than any other."""
    least = rows.groupBy("t").agg(F.min(F.struct(*order)).alias("least"))
    return least.select("t", *(F.col(f"least.{c}").alias(c) for c in order), F.lit(True).alias("begins"))


def change_lines(merged: DataFrame) -> DataFrame:
    """source, t, seq, line, and header where the time is a new one; order by t, source, seq.

    The row that begins a time is found by its own t, source and seq, so that no order over all rows, or over those of a
    time, is needed."""
    text = [F.concat(F.lit(mark), F.col(c).cast("string")) for mark, c in (("b", "bits"), ("r", "real"), ("s", "str")) if c in merged.columns]
    line = F.concat(F.coalesce(*text), F.lit(" s"), F.col("source").cast("string"))
    rows = merged.select("source", "t", "seq", line.alias("line")).join(firsts(merged, "source", "seq"), ["t", "source", "seq"], "left")
    return rows.select("source", "t", "seq", F.when(F.col("begins"), F.concat(F.lit("#"), F.col("t").cast("string"))).alias("header"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Sorted by ranges of time: the part files, in order of name, are the whole dump."""
    ordered = lines.orderBy("t", "source", "seq")
    ordered.select(F.concat(F.coalesce(F.concat("header", F.lit("\n")), F.lit("")), "line").alias("value")).write.mode("errorifexists").text(path)
