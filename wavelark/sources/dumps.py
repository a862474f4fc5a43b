"""Large value-change dumps (VCD, IEEE 1364), read and written by all tasks.

A dump is one file, or a directory of files that are one dump in order of name. Spark's text reader cuts it into blocks
of lines. The task that reads a block carries times on within it; nothing is shuffled. What it finds goes to a scratch
table, so that a dump is parsed once, however often it is asked. The time that holds at a block's start comes from the
blocks before it, through a table of one row per block. The header alone, which is the design, goes through the driver.

A vector, real or string change must have its identifier on its own line, which is checked, and a comment among the
changes must end on the line where it begins. ``VcdReader`` reads what breaks these rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..builder import Builder
from ..database import Database
from ..errors import WaveError
from ..hierarchy import Hierarchy
from ..types import Vector
from .export import firsts
from .scratch import scratch_dir
from .vcd import VcdReader

#: A change with a blank before its identifier, or any other word.
_WORD = re.compile(r"[bBrRsS]\S*[^\S\n]+\S+|\S+")
_COMMENT = re.compile(r"\$comment\s.*?\$end")
_TIME = re.compile(r"#-?\d+")
_END = "$enddefinitions"
#: Bits of a change's number that tell the words of a block; those above tell the block.
_WORD_BITS = 36
_CHUNK = 1 << 20


def _files(spark: SparkSession, path: str) -> list:
    """The file, or the files of the directory in order of name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise WaveError(f"there is no {path}")
    found = [s.getPath() for s in fs.listStatus(at) if s.isFile()]
    return sorted((f for f in found if f.getName()[0] not in "._"), key=lambda f: f.getName())


def _head(spark: SparkSession, path: str) -> Iterator[str]:
    """Lines from the start on, fetched as they are needed."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    rest = b""
    for f in _files(spark, path):
        stream = f.getFileSystem(conf).open(f)
        codec = codecs.getCodec(f)
        stream = stream if codec is None else codec.createInputStream(stream)
        try:
            while chunk := bytes(stream.readNBytes(_CHUNK)):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from (x.decode() for x in lines)
        finally:
            stream.close()
        yield rest.decode()
        rest = b""


def _cleaned(bits: Column) -> Column:
    return F.when(bits.rlike("[^01xz]"), F.regexp_replace(F.translate(F.lower(bits), "lhwu-", "01xxx"), "[^01z]", "x")).otherwise(bits)


def _widened(b: Column, width: Column) -> Column:
    """To the width by the format's rule: the highest bit is repeated if it is x or z, else zeros go before it."""
    top = F.left(b, F.lit(1))
    return F.when(F.length(b) == width, b).when(F.length(b) > width, F.right(b, width)).otherwise(F.lpad(b, width, F.when(top.isin("x", "z"), top).otherwise("0")))


def _split(word: str) -> tuple[str | None, str]:
    """Identifier (None if it is missing, or at the header's end) and value."""
    if word[0] in "bBrRsS":
        value, *code = word.split(None, 1)
        return (code[0], value[1:]) if code else (None, word)
    return (None, word) if word == _END else (word[1:], word[0])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines (value, file, start), a block's in order: what is a change or ends the header, with its place in the
    block and the last time before it, and at the end of each block a row without a value."""
    block, n, time = None, 0, None

    def rows(found: list[tuple[str | None, str | None]], places: np.ndarray, times: pa.Array) -> pa.RecordBatch:
        codes, values = (pa.array(x, pa.string()) for x in zip(*found, strict=True))
        columns = [pa.array(np.full(len(found), x)) for x in block]
        return pa.RecordBatch.from_arrays([*columns, pa.array(places), codes, values, times], names=["file", "start", "n", "code", "value", "time"])

    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column("value")
        keys = np.stack([batch.column("file").to_numpy(), batch.column("start").to_numpy()])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (own := (int(keys[0, a]), int(keys[1, a]))) != block:
                if block:
                    yield rows([(None, None)], np.array([n + 1]), pa.array([time], pa.int64()))
                block, n, time = own, 0, None
            text = "\n".join(value.slice(a, b - a).to_pylist())
            words = _WORD.findall(_COMMENT.sub("", text) if "$comment" in text else text)
            mark = np.fromiter((w[0] == "#" or w == _END for w in words), bool, len(words))
            marks = np.flatnonzero(mark)
            # identifiers in the header may look like times: its end takes the time away
            seen = [time, *(int(w[1:]) if _TIME.fullmatch(w := words[i]) else None for i in marks.tolist())]
            keep = np.flatnonzero(np.fromiter((w[0] not in "$#" or w == _END for w in words), bool, len(words)))
            times = pa.array(seen, pa.int64()).take(pa.array(np.cumsum(mark)[keep]))
            if len(keep):
                yield rows([_split(words[i]) for i in keep.tolist()], n + 1 + keep, times)
            n, time = n + len(words), seen[-1]
    if block:
        yield rows([(None, None)], np.array([n + 1]), pa.array([time], pa.int64()))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table whose size Spark knows, so that a join broadcasts it only where it is small."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _words(spark: SparkSession, path: str) -> DataFrame:
    """What _parsed gives of all blocks, in a scratch table, with the number of the file."""
    names = [f.getName() for f in _files(spark, path)]
    files = spark.createDataFrame(list(enumerate(names)), "number int, name string").select("number", F.xxhash64("name").alias("file"))
    if files.select("file").distinct().count() < len(names):
        raise WaveError(f"{path} has two files whose names have one hash")
    lines = spark.read.text(path).select("value", F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    scratch = scratch_dir(spark, "dump-words")
    lines.mapInArrow(_parsed, "file bigint, start bigint, n bigint, code string, value string, time bigint").write.option("compression", "zstd").parquet(scratch)
    return spark.read.parquet(scratch).join(_stored(files, "dump-files"), "file").drop("file").withColumnRenamed("number", "file")


def _blocks(words: DataFrame) -> DataFrame:
    """file, start, their number, begun (whether the changes began before), header (place of its end) and carried."""
    ends = words.filter(F.col("value").isNull() | (F.col("value") == _END))
    found = ends.groupBy("file", "start").agg(F.min(F.when(F.col("value") == _END, F.col("n"))).alias("header"), F.max(F.when(F.col("value").isNull(), F.struct("time")))["time"].alias("last"))
    # one task, of a row per block
    order = Window.orderBy("file", "start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("*", F.row_number().over(order).alias("number"), (F.count("header").over(before) > 0).alias("begun"))
    own = F.when(F.col("begun") | F.col("header").isNotNull(), F.col("last"))
    return found.select("file", "start", "number", "begun", "header", F.last(own, ignorenulls=True).over(before).alias("carried"))


def _changes(words: DataFrame, codes: dict[str, int], streams: dict[int, tuple[str, int]]) -> DataFrame:
    known = words.sparkSession.createDataFrame([(c, s, *streams[s]) for c, s in codes.items()], "code string, stream_id int, kind string, width int")
    rows = words.filter(F.col("value") != _END).join(_blocks(words), ["file", "start"]).filter("begun OR n > header")
    seq = F.shiftleft(F.col("number").cast("bigint"), _WORD_BITS) + F.col("n")
    rows = rows.select(F.coalesce("time", "carried", F.lit(0)).cast("bigint").alias("t"), seq.alias("seq"), "code", "value").join(_stored(known, "dump-codes"), "code", "left")
    missing = F.when(F.col("code").isNull(), F.concat(F.lit("no identifier on the line of "), "value")).otherwise(F.concat(F.lit("no variable has the identifier "), "code"))
    value, logic = F.col("value"), F.col("kind") == "logic"
    rows = rows.select("t", "seq", "kind", "width", "value", F.coalesce("stream_id", F.raise_error(missing).cast("int")).alias("stream_id"), F.when(logic, _cleaned(value)).alias("bits"))
    real, text = F.when(F.col("kind") == "real", value.cast("double")), F.when(F.col("kind") == "string", value)
    return rows.select("stream_id", "t", "seq", F.when(logic, _widened(F.col("bits"), F.col("width"))).alias("bits"), real.alias("real"), text.alias("str"))


def read_dump(spark: SparkSession, path: str) -> Database:
    """The design and the changes of a dump. Changes before the first time are at 0; seq orders all changes."""
    builder = Builder(spark)
    reader = VcdReader(path, _head(spark, path))
    reader.read_header(builder)
    return Database(builder.hierarchy, _changes(_words(spark, path), reader.streams, builder.streams), builder.streams, builder.scale)


def _header(db: Database) -> str:
    """Declarations of all scopes, and of all nodes that have a stream."""
    h: Hierarchy = db.hierarchy
    lines = [f"$timescale {str(db.scale).replace(' ', '')} $end"]

    def scope(at: int) -> None:
        own = h.scope(at)
        if own.parent is not None:
            lines.append(f"$scope {own.kind} {own.name} $end")
        above = len(h.scope_path(at)) + 1 if h.scope_path(at) else 0
        for node in (x for s in own.signals for x in h.leaves(s)):
            n = h.node(node)
            kind, width = db.streams[n.stream]
            bounds = f" [{n.type.msb}:{n.type.lsb}]" if isinstance(n.type, Vector) else ""
            size = width if kind == "logic" else 64
            lines.append(f"$var {'wire' if kind == 'logic' else kind} {size} s{n.stream} {h.path(node)[above:]}{bounds} $end")
        for s in own.scopes:
            scope(s)
        if own.parent is not None:
            lines.append("$upscope $end")

    scope(0)
    return "\n".join([*lines, f"{_END} $end"])


def write_dump(db: Database, path: str) -> None:
    """Write a directory of files that are, in order of name, one dump; blanks in strings become underscores.

    Changes go out by ranges of time, stream and number. A node's name is its path below its scope."""
    spark = db.rows.sparkSession
    changes = db.rows.join(firsts(db.rows, "stream_id", "seq"), ["t", "stream_id", "seq"], "left")
    first = F.col("begins").isNotNull()
    value = F.coalesce(F.concat(F.lit("b"), "bits"), F.concat(F.lit("r"), F.col("real").cast("string")), F.concat(F.lit("s"), F.regexp_replace("str", r"\s", "_")))
    line = F.concat(F.when(first, F.concat(F.lit("#"), F.col("t").cast("string"), F.lit("\n"))).otherwise(""), value, F.lit(" s"), F.col("stream_id").cast("string"))
    rows = changes.select(F.lit(1).alias("part"), "t", "stream_id", "seq", line.alias("value"))
    head = spark.createDataFrame([(0, 0, 0, 0, _header(db))], "part int, t bigint, stream_id int, seq bigint, value string")
    head.unionByName(rows).orderBy("part", "t", "stream_id", "seq").select("value").write.mode("errorifexists").text(path)
