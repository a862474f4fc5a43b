"""The operators as queries over the given tables, each with what DuckDB says to it.

Events are a waveform: a stream per user, time in microseconds, a 16-bit value with some x and z. Line items are one with
repeated times: a stream per part, an 8-bit value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logic, timing
from ..functions.timing import WHOLE, TimeRange
from ..operators import changes as ops

#: Times within the events and the line items, in microseconds.
EVENTS_AT, ITEMS_AT = 1_705_000_000_000_000, 800_000_000_000_000
EVENTS_RANGE = TimeRange(1_704_500_000_000_000, 1_705_500_000_000_000)
ITEMS_RANGE = TimeRange(750_000_000_000_000, 850_000_000_000_000)
#: Fields of the 16-bit value: name, offset, width.
FIELDS = (("hdr", 12, 4), ("addr", 4, 8), ("cmd", 4, 3), ("valid", 0, 1))

_EVENTS = """(SELECT user_id AS stream_id, epoch_us(ts) AS t, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'zzzz' ELSE left(b, 4) END || substr(b, 5, 11)
    || CASE WHEN event_id % 64 = 0 THEN 'x' ELSE right(b, 1) END AS bits
    FROM (SELECT *, lpad(bin(round(value * 100)::BIGINT & 65535), 16, '0') AS b FROM events))"""
_ITEMS = "(SELECT l_partkey AS stream_id, epoch_us(l_shipdate) AS t, l_orderkey * 8 + l_linenumber AS seq, lpad(bin(l_quantity::BIGINT & 255), 8, '0') AS bits FROM lineitem)"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str, time: TimeRange = WHOLE) -> DataFrame:
    """The events as changes. time: what a query needs; its bounds are also on the column as it is stored, so that the
    scan can use them, which it cannot do with the time that is computed here."""
    b = F.lpad(F.bin(F.round(F.col("value") * 100).cast("bigint").bitwiseAND(65535)), 16, "0")
    rows = _read(spark, sf_dir, "events")
    stored = lambda t: F.timestamp_micros(F.lit(t)).cast(rows.schema["ts"].dataType)
    if time.begin > WHOLE.begin:
        rows = rows.filter(F.col("ts") >= stored(time.begin))
    if time.end < WHOLE.end:
        rows = rows.filter(F.col("ts") < stored(time.end))
    rows = rows.select("user_id", "ts", "event_id", b.alias("b"))
    bits = F.concat(F.when(F.col("event_id") % 97 == 0, "zzzz").otherwise(F.left("b", F.lit(4))), F.substr("b", F.lit(5), F.lit(11)), F.when(F.col("event_id") % 64 == 0, "x").otherwise(F.right("b", F.lit(1))))
    return rows.select(F.col("user_id").alias("stream_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"), bits.alias("bits"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    bits = F.lpad(F.bin(F.col("l_quantity").cast("bigint").bitwiseAND(255)), 8, "0")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("stream_id"), t.alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), bits.alias("bits"))


_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def add(f):
        _found[f.__name__] = (f, sql)
        return f

    return add


def _scalars(name: str, source: Callable[[SparkSession, str], DataFrame], table: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query of column functions over every row of a view."""
    f = lambda spark, sf_dir: source(spark, sf_dir).select("seq", *(c().alias(k) for k, (c, _) in columns.items()))
    _found[name] = (f, f"SELECT seq, {', '.join(f'{sql} AS {k}' for k, (_, sql) in columns.items())} FROM {table}")


# point in time


@_query(f"SELECT stream_id, max(t) AS t, arg_max(bits, (t, seq)) AS bits FROM {_EVENTS} WHERE t <= {EVENTS_AT} GROUP BY stream_id")
def snapshot_at(spark, sf_dir):
    return ops.snapshot(events(spark, sf_dir, TimeRange(WHOLE.begin, EVENTS_AT + 1)), EVENTS_AT)


@_query(f"SELECT stream_id, max(t) AS t, arg_max(bits, (t, seq)) AS bits FROM {_ITEMS} WHERE t <= {ITEMS_AT} GROUP BY stream_id")
def snapshot_repeated_times(spark, sf_dir):
    return ops.snapshot(items(spark, sf_dir), ITEMS_AT)


def _probes(spark, sf_dir):
    """Orders ask for the value of a user's stream at a time."""
    streams = _read(spark, sf_dir, "events").select("user_id").distinct().count()
    asked = _read(spark, sf_dir, "orders").select("o_orderkey")
    return asked.select(F.col("o_orderkey").alias("probe"), (F.col("o_orderkey") % streams).alias("stream_id"), (F.lit(1_704_067_200_000_000) + (F.col("o_orderkey") * 7_919_000_003) % 2_592_000_000_000).alias("t"))


_PROBES = "(SELECT o_orderkey AS probe, o_orderkey % (SELECT count(DISTINCT user_id) FROM events) AS stream_id, 1704067200000000 + (o_orderkey * 7919000003) % 2592000000000 AS t FROM orders)"


def _as_of_sql(comparison: str) -> str:
    """Times within a stream of events are unique, so DuckDB's own as-of join applies."""
    return f"SELECT p.probe, p.stream_id, p.t, c.t AS change_t, c.bits FROM {_PROBES} p ASOF LEFT JOIN {_EVENTS} c ON p.stream_id = c.stream_id AND p.t {comparison} c.t"


@_query(_as_of_sql(">="))
def asof_batch(spark, sf_dir):
    return ops.as_of(events(spark, sf_dir), _probes(spark, sf_dir))


@_query(_as_of_sql(">="))
def asof_bucketed(spark, sf_dir):
    return ops.as_of(events(spark, sf_dir), _probes(spark, sf_dir), bucket=86_400_000_000)


@_query(_as_of_sql(">"))
def prev_change_batch(spark, sf_dir):
    return ops.as_of(events(spark, sf_dir), _probes(spark, sf_dir), strict=True, bucket=86_400_000_000)


@_query(_as_of_sql("<"))
def next_change_batch(spark, sf_dir):
    return ops.following(events(spark, sf_dir), _probes(spark, sf_dir), bucket=86_400_000_000)


@_query(f"SELECT stream_id, min(t) AS t FROM {_EVENTS} WHERE t > {EVENTS_AT} GROUP BY stream_id")
def next_change(spark, sf_dir):
    return ops.next_change(events(spark, sf_dir, TimeRange(EVENTS_AT + 1, WHOLE.end)), EVENTS_AT)


@_query(f"SELECT stream_id, max(t) AS t FROM {_EVENTS} WHERE t < {EVENTS_AT} GROUP BY stream_id")
def prev_change(spark, sf_dir):
    return ops.prev_change(events(spark, sf_dir, TimeRange(WHOLE.begin, EVENTS_AT)), EVENTS_AT)


# ranges and slices


def _in(time: TimeRange) -> str:
    return f"t >= {time.begin} AND t < {time.end}"


@_query(f"SELECT stream_id, t, seq, bits FROM {_EVENTS} WHERE {_in(EVENTS_RANGE)}")
def range_changes_all(spark, sf_dir):
    return ops.in_range(events(spark, sf_dir, EVENTS_RANGE), EVENTS_RANGE)


@_query(f"SELECT stream_id, t, seq, bits FROM {_EVENTS} WHERE {_in(EVENTS_RANGE)} AND stream_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def range_changes_of_set(spark, sf_dir):
    """The set of streams is a table: the users that have bought something."""
    buyers = _read(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("stream_id"))
    return ops.in_range(events(spark, sf_dir, EVENTS_RANGE), EVENTS_RANGE, buyers)


@_query(f"SELECT stream_id, t, seq, bits FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) - 1 AS place FROM {_EVENTS}) WHERE place >= 8 AND place < 24")
def sub_block(spark, sf_dir):
    return ops.sub_block(events(spark, sf_dir), 8, 24, bucket=86_400_000_000)


def _slices(spark, sf_dir):
    """Every field of every stream."""
    fields = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(o).alias("slice_offset"), F.lit(w).alias("slice_width")) for n, o, w in FIELDS))
    rows = events(spark, sf_dir).select("stream_id").distinct().select("stream_id", F.explode(fields).alias("f"))
    return rows.select(F.concat_ws(".", F.col("stream_id").cast("string"), "f.field").alias("slice"), "stream_id", "f.slice_offset", "f.slice_width")


_CASES = "(VALUES " + ", ".join(f"('{n}', {o}, {w})" for n, o, w in FIELDS) + ") f(field, o, w)"


def _sliced_sql(table: str, width: int = 16) -> str:
    return f"(SELECT stream_id || '.' || field AS slice, stream_id, t, seq, substr(bits, {width} - o - w + 1, w) AS bits FROM {table}, {_CASES})"


def _changed_sql(rows: str) -> str:
    return f"(SELECT *, lag(bits) OVER (PARTITION BY slice ORDER BY t, seq) AS p FROM {rows})"


@_query(f"SELECT slice, stream_id, t, seq, bits FROM {_changed_sql(_sliced_sql(_EVENTS))} WHERE p IS DISTINCT FROM bits AND {_in(EVENTS_RANGE)}")
def slice_changes(spark, sf_dir):
    return ops.slice_changes(events(spark, sf_dir, TimeRange(WHOLE.begin, EVENTS_RANGE.end)), _slices(spark, sf_dir), EVENTS_RANGE)


def _low(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("stream_id").cast("string").alias("slice"), "stream_id", F.lit(0).alias("slice_offset"), F.lit(3).alias("slice_width")).distinct()


_LOW_ROWS = f"(SELECT stream_id::VARCHAR AS slice, stream_id, t, seq, right(bits, 3) AS bits FROM {_ITEMS})"
_LOW_SETTLED = f"(SELECT slice, stream_id, t, max(seq) AS seq, arg_max(bits, seq) AS bits FROM {_LOW_ROWS} GROUP BY slice, stream_id, t)"


@_query(f"SELECT slice, stream_id, t, seq, bits FROM {_changed_sql(_LOW_ROWS)} WHERE p IS DISTINCT FROM bits AND {_in(ITEMS_RANGE)}")
def slice_changes_repeated_times(spark, sf_dir):
    return ops.slice_changes(items(spark, sf_dir), _low(spark, sf_dir), ITEMS_RANGE, bucket=10_000_000_000_000)


@_query(f"SELECT slice, min(t) AS t FROM {_changed_sql(_LOW_SETTLED)} WHERE p IS DISTINCT FROM bits AND t > {ITEMS_AT} GROUP BY slice")
def slice_next(spark, sf_dir):
    return ops.slice_edges(items(spark, sf_dir), _low(spark, sf_dir)).filter(F.col("t") > ITEMS_AT).groupBy("slice").agg(F.min("t").alias("t"))


@_query(f"SELECT slice, max(t) AS t FROM {_changed_sql(_LOW_SETTLED)} WHERE p IS DISTINCT FROM bits AND t < {ITEMS_AT} GROUP BY slice")
def slice_prev(spark, sf_dir):
    return ops.slice_edges(items(spark, sf_dir), _low(spark, sf_dir)).filter(F.col("t") < ITEMS_AT).groupBy("slice").agg(F.max("t").alias("t"))


@_query(f"SELECT stream_id, t, max(seq) AS seq, arg_max(bits, seq) AS bits FROM {_ITEMS} GROUP BY stream_id, t")
def settled_values(spark, sf_dir):
    return ops.settled(items(spark, sf_dir))


@_query(f"SELECT *, lead(t) OVER (PARTITION BY stream_id ORDER BY t) AS t_end FROM (SELECT stream_id, t, max(seq) AS seq, arg_max(bits, seq) AS bits FROM {_ITEMS} GROUP BY stream_id, t)")
def hold_intervals(spark, sf_dir):
    return ops.held(items(spark, sf_dir), bucket=10_000_000_000_000)


# merges

def _streams(spark, sf_dir):
    return events(spark, sf_dir).select("stream_id").distinct()


_STREAMS = "(SELECT DISTINCT user_id AS stream_id FROM events)"


@_query(f"""SELECT r.source, c.stream_id, c.t, c.seq, c.bits, row_number() OVER (ORDER BY c.t, r.source, c.seq) - 1 AS ord FROM {_EVENTS} c
    JOIN (SELECT 2 * stream_id AS source, stream_id FROM {_STREAMS} UNION ALL SELECT 2 * stream_id + 1, stream_id FROM {_STREAMS} WHERE stream_id % 3 = 0 UNION ALL SELECT -2, -1) r USING (stream_id)""")
def merge_tagged_all(spark, sf_dir):
    """Every stream, each third one twice, and one that is unknown."""
    streams = _streams(spark, sf_dir)
    twice = streams.filter("stream_id % 3 = 0").select((2 * F.col("stream_id") + 1).alias("source"), "stream_id")
    unknown = spark.range(1).select(F.lit(-2).cast("bigint").alias("source"), F.lit(-1).cast("bigint").alias("stream_id"))
    merged = ops.merged(events(spark, sf_dir), streams.select((2 * F.col("stream_id")).alias("source"), "stream_id").union(twice).union(unknown))
    return ops.numbered(merged, "ord")


@_query(f"""SELECT *, row_number() OVER (ORDER BY t, source, seq) - 1 AS ord FROM (SELECT 5 * stream_id AS source, t, seq, bits FROM {_EVENTS} WHERE {_in(EVENTS_RANGE)}
    UNION ALL SELECT 5 * stream_id + CASE split_part(slice, '.', 2) {' '.join(f"WHEN '{n}' THEN {k}" for k, (n, _, _) in enumerate(FIELDS, 1))} END, t, seq, bits FROM {_changed_sql(_sliced_sql(_EVENTS))} WHERE p IS DISTINCT FROM bits AND {_in(EVENTS_RANGE)})""")
def mixed_merge_all(spark, sf_dir):
    """Every stream, and every field of every stream."""
    plain = _streams(spark, sf_dir).select((5 * F.col("stream_id")).alias("source"), "stream_id")
    place = F.array_position(F.array(*(F.lit(n) for n, _, _ in FIELDS)), F.substring_index("slice", ".", -1))
    slices = _slices(spark, sf_dir).withColumn("source", 5 * F.col("stream_id") + place)
    return ops.numbered(ops.mixed(events(spark, sf_dir, TimeRange(WHOLE.begin, EVENTS_RANGE.end)), plain, slices, EVENTS_RANGE), "ord")


@_query(f"""SELECT stream_id AS source, t, seq, CASE WHEN t IS DISTINCT FROM lag(t) OVER (ORDER BY t, stream_id, seq) THEN '#' || t END AS header, 'b' || bits || ' s' || stream_id AS line,
    row_number() OVER (ORDER BY t, stream_id, seq) - 1 AS ord FROM {_EVENTS}""")
def export_lines_all(spark, sf_dir):
    from ..sources.export import change_lines

    lines = change_lines(ops.merged(events(spark, sf_dir), _streams(spark, sf_dir).select(F.col("stream_id").alias("source"), "stream_id")))
    return ops.numbered(lines, "ord")


@_query(f"SELECT stream_id, t, bits FROM {_EVENTS}")
def dump_round_trip(spark, sf_dir):
    """The events as a database, written as a dump and read back; the design, a signal per stream, is the driver's."""
    from ..builder import Builder
    from ..database import Database
    from ..sources.dumps import read_dump, write_dump
    from ..sources.scratch import scratch_dir
    from ..types import Vector

    rows, builder = events(spark, sf_dir), Builder(spark)
    builder.begin_scope("top")
    users = [r.stream_id for r in rows.select("stream_id").distinct().orderBy("stream_id").toLocalIterator()]
    place = spark.createDataFrame([(u, builder.hierarchy.node(builder.declare(f"u{u}", Vector(15, 0))).stream) for u in users], "user_id bigint, stream_id int")
    rows = rows.withColumnRenamed("stream_id", "user_id").join(place, "user_id").select("stream_id", "t", "seq", "bits", F.lit(None).cast("double").alias("real"), F.lit(None).cast("string").alias("str"))
    path = scratch_dir(spark, "dump")
    write_dump(Database(builder.hierarchy, rows, builder.streams, builder.scale), path)
    db = read_dump(spark, path)
    names = [(db.hierarchy.node(n).stream, int(db.hierarchy.node(n).name[1:])) for n in db.leaf_nodes()]
    return db.rows.join(spark.createDataFrame(names, "stream_id int, user_id bigint"), "stream_id").select(F.col("user_id").alias("stream_id"), "t", "bits")


# composites: the users 10g to 10g + 9 are a group


def _groups(spark, sf_dir):
    return events(spark, sf_dir).select("stream_id").distinct().select(F.floor(F.col("stream_id") / 10).alias("composite"), (F.col("stream_id") % 10).alias("ord"), "stream_id")


@_query(f"""WITH s AS (SELECT stream_id, arg_max(bits, (t, seq)) AS bits FROM {_EVENTS} WHERE t <= {EVENTS_AT} GROUP BY stream_id)
    SELECT stream_id // 10 AS composite, string_agg(coalesce(bits, '-'), ',' ORDER BY stream_id) AS vals FROM (SELECT DISTINCT user_id AS stream_id FROM events) LEFT JOIN s USING (stream_id) GROUP BY composite""")
def composite_snapshot(spark, sf_dir):
    found = ops.composite(ops.snapshot(events(spark, sf_dir), EVENTS_AT), _groups(spark, sf_dir))
    return found.select("composite", F.array_join(F.transform("values", lambda v: v["bits"]), ",", "-").alias("vals"))


@_query(f"SELECT stream_id // 10 AS composite, min(t) AS t FROM {_EVENTS} WHERE t > {EVENTS_AT} GROUP BY composite")
def composite_next(spark, sf_dir):
    return ops.composite_next(events(spark, sf_dir), _groups(spark, sf_dir), EVENTS_AT)


@_query(f"SELECT stream_id // 10 AS composite, max(t) AS t FROM {_EVENTS} WHERE t < {EVENTS_AT} GROUP BY composite")
def composite_prev(spark, sf_dir):
    return ops.composite_prev(events(spark, sf_dir), _groups(spark, sf_dir), EVENTS_AT)


# counts and checks


@_query(f"SELECT min(t) AS t_begin, max(t) + 1 AS t_end FROM {_EVENTS}")
def time_range(spark, sf_dir):
    return ops.time_range(events(spark, sf_dir))


@_query(f"SELECT stream_id, count(*) AS n FROM {_EVENTS} WHERE {_in(EVENTS_RANGE)} GROUP BY stream_id")
def density(spark, sf_dir):
    return ops.density(events(spark, sf_dir, EVENTS_RANGE), EVENTS_RANGE)


@_query(f"SELECT stream_id, block, min(t) AS t_begin, max(t) AS t_end, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) - 1) // 16 AS block FROM {_EVENTS}) GROUP BY stream_id, block")
def block_index(spark, sf_dir):
    return ops.blocks(events(spark, sf_dir), 16, bucket=86_400_000_000)


@_query(f"SELECT stream_id, t, seq, bits, before_t FROM (SELECT *, lag(t) OVER (PARTITION BY stream_id ORDER BY seq, t) AS before_t FROM {_ITEMS}) WHERE t < before_t")
def validate_monotonic(spark, sf_dir):
    return ops.unsorted(items(spark, sf_dir), bucket=100_000)


def _declared(spark, sf_dir):
    """Even streams are declared 16 bits wide, those divisible by 3 and not by 2 eight; the rest are not declared."""
    s = events(spark, sf_dir).select("stream_id").distinct().filter("stream_id % 2 = 0 OR stream_id % 3 = 0")
    return s.select("stream_id", F.lit("logic").alias("kind"), F.when(F.col("stream_id") % 2 == 0, 16).otherwise(8).alias("width"))


@_query(f"""SELECT *, CASE WHEN t IS NULL THEN 'no time' WHEN stream_id % 2 <> 0 AND stream_id % 3 <> 0 THEN 'unknown stream' WHEN bits IS NULL THEN 'wrong kind' ELSE 'wrong width' END AS rule
    FROM (SELECT stream_id, CASE WHEN seq % 11 <> 0 THEN t END AS t, seq, CASE WHEN seq % 13 <> 0 THEN bits END AS bits FROM {_EVENTS}) WHERE t IS NULL OR stream_id % 2 <> 0 OR bits IS NULL""")
def validate_streams(spark, sf_dir):
    """Each 11th row has no time, and each 13th a real in place of bits."""
    rows = events(spark, sf_dir).withColumn("t", F.when(F.col("seq") % 11 != 0, F.col("t"))).withColumn("real", F.when(F.col("seq") % 13 == 0, 1.5))
    rows = rows.withColumn("bits", F.when(F.col("real").isNull(), F.col("bits"))).withColumn("str", F.lit(None).cast("string"))
    return ops.violations(rows, _declared(spark, sf_dir)).drop("real", "str")


#: The polynomial of CRC-32 (IEEE 802.3), low bit first, and what the sum begins with.
_POLYNOMIAL, _ONES = 0xEDB88320, 0xFFFFFFFF
_CRC = f"list_reduce(list_concat([{_ONES}], list_transform(string_split(bits, ''), lambda c: ascii(c)::BIGINT)), lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN {_POLYNOMIAL} ELSE 0 END)))"


@_query(f"SELECT seq, xor({_CRC}, {_ONES})::BIGINT AS crc FROM {_EVENTS}")
def crc_rows(spark, sf_dir):
    return events(spark, sf_dir).select("seq", F.crc32("bits").alias("crc"))


# scalar functions

_scalars("logic_not", events, _EVENTS, {"r": (lambda: logic.invert("bits"), "translate(bits, '01z', '10x')")})
_scalars("slice_project", events, _EVENTS, {**{n: (lambda o=o, w=w: logic.slice_bits("bits", o, w), f"substr(bits, {16 - o - w + 1}, {w})") for n, o, w in FIELDS}, "beyond": (lambda: logic.slice_bits("bits", 12, 8), "'xxxx' || left(bits, 4)")})
_scalars("two_state_filter", events, _EVENTS, {"two_state": (lambda: logic.is_two_state("bits"), "NOT regexp_matches(bits, '[xz]')")})
_scalars("planes", events, _EVENTS, {"a": (lambda: logic.aval("bits"), "translate(bits, 'xz', '10')"), "b": (lambda: logic.bval("bits"), "translate(bits, '01xz', '0011')"), "back": (lambda: logic.from_planes(logic.aval("bits"), logic.bval("bits")), "bits"), "a0": (lambda: F.get(logic.plane_words(logic.aval("bits")), F.lit(0)), "list_sum([substr(translate(bits, 'xz', '10'), 16 - i, 1)::BIGINT << i FOR i IN range(16)])::BIGINT")})


def _radix_sql(k: int) -> str:
    n = -(-16 // k)
    groups = [f"substr(bits, {max(1, 16 - d * k - k + 1)}, {min(k, 16 - d * k)})" for d in range(n - 1, -1, -1)]
    digit = lambda g: f"CASE WHEN NOT regexp_matches({g}, '[xz]') THEN lower(to_base(('0b' || {g})::INT, 16)) WHEN NOT regexp_matches({g}, '[^z]') THEN 'z' ELSE 'x' END"
    return " || ".join(digit(g) for g in groups)


_scalars("radix_hex", events, _EVENTS, {"hex": (lambda: logic.to_hex("bits"), _radix_sql(4))})
_scalars("radix_oct", events, _EVENTS, {"oct": (lambda: logic.to_oct("bits"), _radix_sql(3))})
_number = "list_sum([substr(bits, 16 - i, 1)::BIGINT << i FOR i IN range(16)])::BIGINT"
_scalars("radix_dec_unsigned", events, _EVENTS, {"dec": (lambda: logic.to_dec("bits"), f"CASE WHEN regexp_matches(bits, '[xz]') THEN 'x' ELSE ({_number})::VARCHAR END")})
_scalars("radix_dec_signed", events, _EVENTS, {"dec": (lambda: logic.to_dec("bits", signed=True), f"CASE WHEN regexp_matches(bits, '[xz]') THEN 'x' ELSE (({_number}) - CASE WHEN left(bits, 1) = '1' THEN 65536 ELSE 0 END)::VARCHAR END")})
_wide = "list_reduce(list_transform(range(97), lambda i: substr('0' || repeat(bits, 6), i::INT + 1, 1)::HUGEINT), lambda a, x: a * 2 + x)"
_wide_sql = lambda signed: f"CASE WHEN regexp_matches(bits, '[xz]') THEN 'x' ELSE ({_wide}{' - CASE WHEN left(bits, 1) = $$1$$ THEN 1::HUGEINT << 96 ELSE 0 END' if signed else ''})::VARCHAR END"
_repeated = lambda: F.repeat("bits", F.lit(6))
_scalars("radix_dec_wide", events, _EVENTS, {f"{name}_{sign}": (lambda f=f, signed=sign == "signed": f(_repeated(), signed), _wide_sql(sign == "signed")) for name, f in (("jvm", logic.to_dec), ("python", logic.to_dec_wide)) for sign in ("unsigned", "signed")})
_doubled = "list_reduce(list_concat([[0 FOR i IN range(44)]], [[c::INT] FOR c IN string_split({0}, '')]), lambda d, b: [(2 * d[i]) % 10 + CASE WHEN i = 1 THEN b[1] WHEN d[i - 1] >= 5 THEN 1 ELSE 0 END FOR i IN range(1, 45)])"
_digits_sql = lambda bits: f"regexp_replace(array_to_string(list_reverse({_doubled.format(bits)}), ''), '^0+(.)', '\\1')"
# the magnitude of a negative number: all bits above its lowest 1 are flipped
_magnitude = "(translate(regexp_extract(w, '^(.*)10*$', 1), '01', '10') || regexp_extract(w, '(10*)$', 1))"
_found["radix_dec_long"] = (
    lambda spark, sf_dir: events(spark, sf_dir).select("seq", logic.to_dec(F.repeat("bits", F.lit(9))).alias("plain"), logic.to_dec(F.repeat("bits", F.lit(9)), signed=True).alias("signed")),
    f"SELECT seq, CASE WHEN x THEN 'x' ELSE {_digits_sql('w')} END AS plain, CASE WHEN x THEN 'x' WHEN left(w, 1) = '1' THEN '-' || {_digits_sql(_magnitude)} ELSE {_digits_sql('w')} END AS signed FROM (SELECT seq, regexp_matches(bits, '[xz]') AS x, translate(repeat(bits, 9), 'xz', '00') AS w FROM {_EVENTS})",
)
_scalars("to_uint64", events, _EVENTS, {"n": (lambda: logic.to_uint64("bits").cast("bigint"), f"CASE WHEN NOT regexp_matches(bits, '[xz]') THEN {_number} END")})
_scalars("bit_test", events, _EVENTS, {"b0": (lambda: logic.get("bits", 0), "right(bits, 1)"), "b15": (lambda: logic.test("bits", 15), "left(bits, 1)"), "b16": (lambda: logic.get("bits", 16), "'x'")})
_scalars("bit_set_flip", events, _EVENTS, {"s": (lambda: logic.set_bit("bits", 3), "left(bits, 12) || '1' || right(bits, 3)"), "r": (lambda: logic.reset_bit("bits", 0), "left(bits, 15) || '0'"), "f": (lambda: logic.flip_bit("bits", 15), "translate(left(bits, 1), '01z', '10x') || right(bits, 15)")})
_scalars("resize_coerce", events, _EVENTS, {"cut": (lambda: logic.resize("bits", 5), "right(bits, 5)"), "grown": (lambda: logic.resize("bits", 20, "z"), "'zzzz' || bits"), "coerced": (lambda: logic.coerce("bits", 18), "'xx' || bits"), "pushed": (lambda: logic.push_back("bits", F.lit("1")), "'1' || bits"), "popped": (lambda: logic.pop_back("bits"), "substr(bits, 2)")})
_scalars("assign_bits", events, _EVENTS, {"chars": (lambda: logic.assign_chars("bits", F.lit("1Z?0")), "left(bits, 12) || '1zx0'"), "number": (lambda: logic.assign_uint64("bits", F.col("seq") % 65536), "lpad(bin(seq % 65536), 16, '0')")})
_scalars("mvl9_collapse", events, _EVENTS, {"r": (lambda: logic.collapse9(F.translate("bits", "01xz", "LHW-")), "translate(bits, 'z', 'x')")})


@_query("SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END AS code, CASE event_type WHEN 'click' THEN 'IDLE' WHEN 'view' THEN 'RUN' WHEN 'purchase' THEN '' END AS label FROM events")
def enum_label(spark, sf_dir):
    from ..types import Enum, Vector

    codes = F.create_map(*(F.lit(x) for kv in (("click", 0), ("view", 1), ("purchase", 2)) for x in kv))
    kind = Enum(Vector(1, 0), (("IDLE", 0), ("RUN", 1), ("", 2), ("LATE", 1)))
    code = F.try_element_at(codes, F.col("event_type"))
    return _read(spark, sf_dir, "events").select("event_id", "event_type", code.alias("code"), kind.label_column(code).alias("label"))


@_query("SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber BETWEEN 2 AND 6 THEN l_linenumber - 2 END::BIGINT AS up, CASE WHEN l_linenumber BETWEEN 2 AND 6 THEN 6 - l_linenumber END::BIGINT AS down FROM lineitem")
def array_ordinal(spark, sf_dir):
    from ..types import Array, Scalar

    i = F.col("l_linenumber")
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", Array(Scalar(), 2, 6).ordinal_column(i).alias("up"), Array(Scalar(), 6, 2).ordinal_column(i).alias("down"))


@_query(f"SELECT seq, t::DOUBLE * 10 * pow(10.0, -6.0) AS s FROM {_EVENTS}")
def time_seconds(spark, sf_dir):
    return events(spark, sf_dir).select("seq", timing.seconds(F.col("t"), F.lit(-6), F.lit(10)).alias("s"))


@_query("SELECT n_nationkey, n_nationkey || CASE n_nationkey % 5 WHEN 0 THEN ' s' WHEN 1 THEN 'e-1 s' WHEN 2 THEN 'e-2 s' WHEN 3 THEN ' ms' ELSE 'e-4 s' END AS scale FROM nation")
def timescale_format(spark, sf_dir):
    return _read(spark, sf_dir, "nation").select("n_nationkey", timing.scale_text(-(F.col("n_nationkey") % 5), F.col("n_nationkey")).alias("scale"))


@_query("SELECT l_orderkey, l_partkey, l_linenumber, greatest(b, 20) AS begins, least(e, 30) AS ends, b < 30 AND 20 < e AS overlap, least(b, 20) AS hull_begin, greatest(e, 30) AS hull_end FROM (SELECT *, l_quantity::BIGINT AS b, l_quantity::BIGINT + l_linenumber AS e FROM lineitem)")
def range_algebra(spark, sf_dir):
    b = F.col("l_quantity").cast("bigint")
    own, other = timing.ColumnRange(b, b + F.col("l_linenumber")), TimeRange(20, 30).columns()
    both, hull = own.intersect(other), own.hull(other)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", both.begin.alias("begins"), both.end.alias("ends"), own.overlaps(other).alias("overlap"), hull.begin.alias("hull_begin"), hull.end.alias("hull_end"))


@_query("SELECT l_orderkey, l_partkey, l_linenumber, greatest(0, e - b) AS size, b >= e AS is_empty, b <= 25 AND 25 < e AS has, b = 20 AND e = 30 AS same, (b, e) <= (20, 30) AS not_after FROM (SELECT *, l_quantity::BIGINT AS b, l_quantity::BIGINT + l_linenumber - 3 AS e FROM lineitem)")
def range_questions(spark, sf_dir):
    b = F.col("l_quantity").cast("bigint")
    own, other = timing.ColumnRange(b, b + F.col("l_linenumber") - 3), TimeRange(20, 30).columns()
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", own.size().alias("size"), own.empty().alias("is_empty"), own.contains(F.lit(25)).alias("has"), own.equals(other).alias("same"), own.not_after(other).alias("not_after"))


# hierarchy: region, nation, customer


def _design(spark, sf_dir):
    """Scopes top, regions and nations; a signal for each customer."""
    r, n, c = (_read(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    scopes = spark.createDataFrame([(0, None, "top", "module", 0)], "scope_id int, parent_id int, name string, kind string, ord int")
    scopes = scopes.union(r.select(F.col("r_regionkey") + 1, F.lit(0), "r_name", F.lit("module"), "r_regionkey"))
    scopes = scopes.union(n.select(F.col("n_nationkey") + 1000, F.col("n_regionkey") + 1, "n_name", F.lit("generate"), "n_nationkey"))
    nodes = c.select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("name"), (F.col("c_nationkey") + 1000).alias("scope_id"), F.lit(None).cast("long").alias("parent_id"), F.col("c_custkey").alias("stream_id"), F.col("c_custkey").alias("ord"))
    return scopes, nodes


_PATHS = "(SELECT c_custkey AS node_id, 'top.' || r_name || '.' || n_name || '.' || c_name AS path, r_regionkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@_query(f"SELECT node_id, path FROM {_PATHS}")
def path_of(spark, sf_dir):
    from ..operators.tree import node_paths

    return node_paths(*_design(spark, sf_dir)).select("node_id", "path")


@_query(f"SELECT o_orderkey, node_id, path FROM orders JOIN {_PATHS} ON o_custkey = node_id")
def find_path(spark, sf_dir):
    from ..operators.tree import find_nodes, node_paths

    paths = node_paths(*_design(spark, sf_dir))
    asked = _read(spark, sf_dir, "orders").join(paths.select(F.col("node_id").alias("o_custkey"), "path"), "o_custkey").select("o_orderkey", "path")
    return find_nodes(asked, paths).select("o_orderkey", "node_id", "path")


@_query(f"SELECT node_id, row_number() OVER (ORDER BY r_regionkey, n_nationkey, node_id) - 1 AS leaf_ord FROM {_PATHS}")
def leaf_nodes(spark, sf_dir):
    from ..operators.tree import leaf_order

    return leaf_order(*_design(spark, sf_dir)).select("node_id", "leaf_ord")


@_query("SELECT n_nationkey, count(c_custkey) AS signals FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def child_counts(spark, sf_dir):
    scopes, nodes = _design(spark, sf_dir)
    signals = nodes.filter("parent_id IS NULL").groupBy("scope_id").agg(F.count("*").alias("n"))
    return scopes.filter("kind = 'generate'").join(signals, "scope_id", "left").select((F.col("scope_id") - 1000).alias("n_nationkey"), F.coalesce("n", F.lit(0).cast("bigint")).alias("signals"))


@_query("SELECT scope_id, name, path FROM (SELECT 0 AS scope_id, 'top' AS name, 'top' AS path UNION ALL SELECT r_regionkey + 1, r_name, 'top.' || r_name FROM region UNION ALL SELECT n_nationkey + 1000, n_name, 'top.' || r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)")
def scope_paths(spark, sf_dir):
    from ..operators.tree import scope_paths as paths

    return paths(_design(spark, sf_dir)[0]).select("scope_id", "name", "path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}
