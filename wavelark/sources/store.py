"""A store: a directory of Parquet tables, the changes clustered by stream and sorted by time.

``meta`` is written last, so a store without it is incomplete. It has the row counts and checksums of the other tables
and the range of time, taken while they are written; the design's are checked whenever a store is opened, the changes' on
demand. Batches appended later are folders among the changes, each with a row of its own in ``meta``. Times and numbers
are stored as differences (delta encoding), in which a sorted column of either takes few bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..database import CHANGES, Database
from ..errors import StoreError
from ..functions.timing import TimeRange, TimeScale
from ..hierarchy import Hierarchy
from ..types import from_json, to_json

VERSION = (2, 0)
_SCOPES = "scope_id int, parent_id int, name string, kind string"
_NODES = "node_id int, name string, type string, scope_id int, parent_id int, stream_id int, slice_offset int, slice_width int"
_STREAMS = "stream_id int, kind string, width int"
META = "version_major int, version_minor int, exponent int, scale bigint, t_begin bigint, t_end bigint, table string, n bigint, checksum bigint"


KEYS = ("stream_id", "t", "seq")
#: How the changes are written.
_FORMAT = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#t": "false", "parquet.enable.dictionary#seq": "false"}


def _sums(df: DataFrame) -> list:
    """Rows, and a sum of hashes that no order changes."""
    return [F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).bitwiseAND((1 << 31) - 1)).alias("c")]


def _checksum(df: DataFrame) -> tuple[int, int]:
    row = df.agg(*_sums(df)).first()
    return row.n, row.c or 0


def write_changes(changes: DataFrame, path: str, mode: str = "errorifexists") -> dict:
    """Write sorted changes; their number n, checksum c and first and last time, observed on the way."""
    seen = Observation()
    watched = changes.observe(seen, *_sums(changes), F.min("t").alias("first"), F.max("t").alias("last"))
    watched.write.mode(mode).options(**_FORMAT).parquet(path)
    return seen.get


def is_store(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def store_scale(spark: SparkSession, path: str) -> TimeScale:
    row = spark.read.schema(META).option("recursiveFileLookup", "true").parquet(f"{path}/meta").first()
    return TimeScale(row.exponent, row.scale)


def meta_row(scale: TimeScale, table: str, seen: dict) -> tuple:
    begin, end = (0, 0) if seen.get("first") is None else (seen["first"], seen["last"] + 1)
    return *VERSION, scale.exponent, scale.scale, begin, end, table, seen["n"], seen["c"] or 0


def write_store(db: Database, path: str, partitions: int | None = None) -> None:
    """Write a database. Changes are dealt by stream and split further by time where a stream is large, so that a hot
    stream is many files; row groups have the bounds of stream and time that a reader prunes by."""
    spark, h = db.rows.sparkSession, db.hierarchy
    tables = {
        "scopes": spark.createDataFrame([(s.id, s.parent, s.name, s.kind) for s in h.scopes], _SCOPES),
        "nodes": spark.createDataFrame([(n.id, n.name, to_json(n.type), n.scope, n.parent, n.stream, *(n.slice or (None, None))) for n in h.nodes], _NODES),
        "streams": spark.createDataFrame([(i, k, w) for i, (k, w) in db.streams.items()], _STREAMS),
    }
    dealt = db.rows.repartitionByRange(partitions, *KEYS) if partitions else db.rows.repartitionByRange(*KEYS)
    meta = [meta_row(db.scale, "changes", write_changes(dealt.sortWithinPartitions(*KEYS), f"{path}/changes"))]
    for name, table in tables.items():
        table.coalesce(1).write.mode("errorifexists").parquet(f"{path}/{name}")
        n, checksum = _checksum(spark.read.parquet(f"{path}/{name}"))
        meta.append(meta_row(db.scale, name, {"n": n, "c": checksum}))
    spark.createDataFrame(meta, META).coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")


def open_store(spark: SparkSession, path: str, verify: bool = False) -> Database:
    """The database of a store; verify: check the changes too."""

    def table(name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")
        except AnalysisException as e:
            raise StoreError(f"{path} is no store, or incomplete: it has no {name}") from e

    rows = table("meta", META).collect()
    if not rows:
        raise StoreError(f"{path} is incomplete: its meta table is empty")
    first = rows[0]
    if first.version_major != VERSION[0]:
        raise StoreError(f"{path} has version {first.version_major}.{first.version_minor}, not {VERSION[0]}")
    if first.version_minor > VERSION[1]:
        raise StoreError(f"{path} has version {first.version_major}.{first.version_minor}, newer than {VERSION[0]}.{VERSION[1]}")
    known = {name: [r for r in rows if r.table == name] for name in {r.table for r in rows}}
    tables = {name: table(name, schema) for name, schema in (("scopes", _SCOPES), ("nodes", _NODES), ("streams", _STREAMS), ("changes", CHANGES))}
    for name, df in tables.items():
        if name != "changes" or verify:
            if name not in known:
                raise StoreError(f"{path}: meta has no row of {name}")
            if _checksum(df) != (sum(r.n for r in known[name]), sum(r.checksum for r in known[name])):
                raise StoreError(f"{path}: {name} is damaged")
    spans = [TimeRange(r.t_begin, r.t_end) for r in known.get("changes", ()) if r.n]
    time = reduce(TimeRange.hull, spans) if spans else TimeRange(0, 0)
    h = Hierarchy()
    for s in tables["scopes"].orderBy("scope_id").toLocalIterator():
        if s.parent_id is not None:
            h.add_scope(s.parent_id, s.name, s.kind)
    for n in tables["nodes"].orderBy("node_id").toLocalIterator():
        cut = None if n.slice_offset is None else (n.slice_offset, n.slice_width)
        kind = from_json(n.type)
        h.add_member(n.parent_id, n.name, kind, n.stream_id, cut) if n.parent_id is not None else h.add_signal(n.scope_id, n.name, kind, n.stream_id)
    streams = {r.stream_id: (r.kind, r.width) for r in tables["streams"].toLocalIterator()}
    return Database(h, tables["changes"], streams, TimeScale(first.exponent, first.scale), time)
