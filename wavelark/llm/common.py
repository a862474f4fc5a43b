"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which alone separates words, as a pattern.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run on one machine
    (tests) a fresh one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wavelark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/wavelark-{label}-{uuid.uuid4().hex}"
    jvm, context = spark._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def copies(df: DataFrame) -> DataFrame:
    """df with a column copy: 0 for a row, and 1, 2 and so on for those that repeat it. The same rows give the same numbers
    however they are partitioned; a row that a third of the table repeats is counted before it is dealt, and dealt in runs."""
    run = 4096
    n = df.groupBy(*df.columns).agg(F.count("*").alias("copy_n"))
    runs = n.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copy_n") - 1, F.lit(run).cast("bigint"))).alias("copy_at"))
    runs = runs.repartition(parts(df.sparkSession), *df.columns, "copy_at")
    return runs.select(*df.columns, F.explode(F.sequence("copy_at", F.least(F.col("copy_at") + run, F.col("copy_n")) - 1)).alias("copy"))


def parts(spark: SparkSession) -> int:
    """How many partitions the session deals a shuffle into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_text(column: str = "doc_id") -> Column:
    """The id as text; a null id counts as empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of anything but ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def distinct_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of data, and the place of every word of data among them."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACES[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    ends = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
