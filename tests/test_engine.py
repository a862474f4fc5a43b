import random

import pytest

from wavelark.builder import Builder, ValidatingBuilder, ingest, ingest_header
from wavelark.errors import StoreError, WaveError
from wavelark.functions.timing import TimeRange, TimeScale
from wavelark.hierarchy import Hierarchy
from wavelark.operators import changes as ops
from wavelark.sources.store import open_store, write_store
from wavelark.types import Array, Member, Real, Scalar, String, Struct, Vector

REQ = Struct((Member("addr", Vector(7, 0), 1), Member("valid", Scalar(), 0)), True)


def built(spark, declare, values):
    b = ValidatingBuilder(Builder(spark))
    b.set_time_scale(TimeScale(-9))
    b.begin_scope("top")
    nodes = declare(b)
    b.end_scope()
    b.header_done()
    for t, stream, value in values:
        b.set_time(t)
        b.value_change(stream, value)
    b.finish()
    return b.take_database(), nodes


def listed(df):
    return [(r.source, r.t, r.bits) for r in df.orderBy("t", "source", "seq").collect()]


@pytest.fixture(scope="module", params=["memory", "store"])
def mixed(request, spark, tmp_path_factory):
    """A clock, a packed structure, an unpacked array, a real and a string; in memory and from a store."""

    def declare(b):
        return {"clk": b.declare("clk", Scalar()), "req": b.declare("req", REQ), "mem": b.declare("mem", Array(Vector(3, 0), 0, 1)), "temp": b.declare("temp", Real()), "label": b.declare("label", String())}

    values = [(0, 0, "0"), (0, 1, "101001011"), (0, 4, 1.5), (0, 5, "idle"), (10, 2, "0001"), (20, 1, "101001010"), (30, 0, "1"), (30, 3, "0010"), (40, 1, "000000010"), (40, 5, "run")]
    db, nodes = built(spark, declare, values)
    if request.param == "store":
        path = str(tmp_path_factory.mktemp("store") / "s")
        write_store(db, path)
        db = open_store(spark, path, verify=True)
    return db, nodes


def test_values(mixed):
    db, n = mixed
    assert db.time_range() == TimeRange(0, 41) and str(db.scale) == "1 ns"
    assert [db.value_at(n["clk"], t) for t in (-1, 0, 29, 30, 99)] == [None, "0", "0", "1", "1"]
    assert db.value_at(n["req"], 0) == ["10100101", "1"] and db.value_at(n["mem"], 10) == ["0001", None] and db.value_at(n["mem"], -1) == [None, None]
    assert db.value_at(n["temp"], 5) == 1.5 and db.value_at(n["label"], 40) == "run"
    addr, valid = (db.find(f"top.req.{x}").id for x in ("addr", "valid"))
    assert listed(db.changes(addr)) == [(0, 0, "10100101"), (0, 40, "00000001")]
    assert listed(db.changes(addr, TimeRange(5, 100))) == [(0, 40, "00000001")] and listed(db.changes(valid, TimeRange(5, 100))) == [(0, 20, "0")]
    assert [db.next_change(addr, t) for t in (-1, 0, 40)] == [0, 40, None] and [db.prev_change(addr, t) for t in (100, 40, 0)] == [40, 0, None]
    assert db.next_change(n["mem"], 10) == 30 and db.prev_change(n["mem"], 15) == 10 and db.next_change(n["req"], 0) == 20


def test_merges(mixed):
    db, n = mixed
    addr = db.find("top.req.addr").id
    assert listed(db.changes([n["clk"], addr, n["mem"]])) == [(0, 0, "0"), (1, 0, "10100101"), (2, 10, "0001"), (0, 30, "1"), (2, 30, "0010"), (1, 40, "00000001")]
    assert listed(db.changes(n["mem"])) == [(0, 10, "0001"), (1, 30, "0010")] and listed(db.changes([n["mem"]])) == [(0, 10, "0001"), (0, 30, "0010")]
    assert listed(db.changes([n["clk"], n["clk"]], TimeRange(30, 40))) == [(0, 30, "1"), (1, 30, "1")] and listed(db.changes([n["clk"]], TimeRange(5, 5))) == []
    assert db.leaf_nodes() == db.root.leaf_nodes() and db.signal(n["req"]).path == "top.req" and db.find("top.mem[1]").path == "top.mem[1]"
    assert db.prefetch([0]) == 2 and db.duplicate().find("top.clk") is not None


def test_against_an_interpreter(spark):
    random.seed(5)
    rows = []
    for s in range(4):
        t = 0
        for _ in range(60):
            t += random.choice((0, 0, 1, 3))
            rows.append((s, t, len(rows), "".join(random.choice("01xz") for _ in range(4))))
    df = spark.createDataFrame(rows, "stream_id int, t long, seq long, bits string")
    own = {s: [r for r in rows if r[0] == s] for s in range(4)}
    probes = [(i, random.randrange(4), random.randrange(-2, 90)) for i in range(200)]
    asked = spark.createDataFrame(probes, "probe long, stream_id int, t long")
    last = lambda p, keep: next((r[3] for r in reversed(own[p[1]]) if keep(r[1], p[2])), None)
    for bucket in (None, 7):
        assert {r.probe: r.bits for r in ops.as_of(df, asked, bucket=bucket).collect()} == {p[0]: last(p, lambda a, b: a <= b) for p in probes}
        assert {r.probe: r.bits for r in ops.as_of(df, asked, strict=True, bucket=bucket).collect()} == {p[0]: last(p, lambda a, b: a < b) for p in probes}
    assert {r.probe: r.bits for r in ops.following(df, asked).collect()} == {p[0]: next((r[3] for r in own[p[1]] if r[1] > p[2]), None) for p in probes}
    slices = spark.createDataFrame([(str(s), s, 1, 2) for s in range(4)], "slice string, stream_id int, slice_offset int, slice_width int")
    for begin in (0, 10, 25):
        expected = []
        for s, log in own.items():
            before = None
            for _, t, seq, bits in log:
                if bits[1:3] != before and begin <= t < 60:
                    expected.append((s, t, seq, bits[1:3]))
                before = bits[1:3]
        found = ops.slice_changes(df, slices, TimeRange(begin, 60)).select("stream_id", "t", "seq", "bits").collect()
        assert sorted(map(tuple, found)) == sorted(expected)
    glitch = spark.createDataFrame([(0, 0, 0, "0"), (0, 5, 1, "1"), (0, 5, 2, "0")], "stream_id int, t long, seq long, bits string")
    one = spark.createDataFrame([("s", 0, 0, 1)], "slice string, stream_id int, slice_offset int, slice_width int")
    assert ops.slice_changes(glitch, one).count() == 3 and ops.slice_edges(glitch, one).count() == 1


def test_paths():
    h = Hierarchy()
    top = h.add_scope(0, "top")
    cpu = h.add_scope(top, "cpu")
    h.add_scope(top, "gen[0]", "generate")
    regs = h.add_signal(top, "regs", Array(REQ, 0, 1))
    for i in (0, 1):
        e = h.add_element(regs, i, REQ, i)
        h.add_member(e, "addr", Vector(7, 0), None, (1, 8))
        h.add_member(e, "valid", Scalar(), None, (0, 1))
    pc = h.add_signal(cpu, "pc", Vector(3, 0), 9)
    for path in ("top.nope", "top.cpu", "", "top.regs[5]", "top.regs[1].nope", "top.regs[01]"):
        assert h.find(path) is None
    assert h.find("top.regs[1].valid") == h.find("top.regs.[1].valid") == h.find("top.regs[ 1 ].valid") == h.find_from(regs, "[1].valid") and h.find_from(regs, "") == regs
    assert h.find_scope("top.gen[0]") is not None and h.find_scope("") == 0 and h.find("pc", cpu) == pc and h.path(pc) == "top.cpu.pc"
    assert all(h.find(h.path(n.id)) == n.id for n in h.nodes)
    odd = h.add_scope(h.add_scope(top, ""), "x")
    assert h.scope_path(odd) == "top..x" and h.scope_leaves() == [*(h.find(f"top.regs[{i}]") for i in (0, 1)), pc]
    assert h.owner(h.find("top.regs[1].valid")) == h.find("top.regs[1]") and h.dump()[0] == "top (module)"
    with pytest.raises(WaveError):
        h.node(99)


def test_leaf_binding(spark):
    b = Builder(spark)
    plain = b.declare("plain", Vector(3, 0))
    leaves = [None, b.hierarchy.node(plain).stream]
    mem = b.declare("mem", Array(Vector(3, 0), 0, 1), leaves=leaves)
    assert leaves == [1, 0] and [b.hierarchy.node(c).stream for c in b.hierarchy.node(mem).children] == [1, 0]
    with pytest.raises(WaveError):
        b.declare("bad", Array(Scalar(), 0, 1), leaves=[None])
    two = b.declare("m", Array(Array(Vector(3, 0), 0, 1), 0, 1))
    assert len(b.hierarchy.leaves(two)) == 4
    arr = b.declare("arr", Array(Vector(3, 0), 0, 1, packed=True))
    assert [b.hierarchy.node(c).slice for c in b.hierarchy.node(arr).children] == [(4, 4), (0, 4)]
    b.value_change(1, "1010111")
    b.value_change(1, "10")
    b.value_change(77, "1")
    b.finish()
    assert [r.bits for r in b.changes().orderBy("seq").collect()] == ["0111", "xx10"]


@pytest.mark.parametrize(
    "calls",
    [
        lambda b: b.end_scope(), lambda b: b.set_time(0), lambda b: b.finish(), lambda b: b.take_database(), lambda b: (b.begin_scope("x"), b.header_done()), lambda b: (b.header_done(), b.header_done()),
        lambda b: (b.header_done(), b.begin_scope("x")), lambda b: b.declare("y", Scalar(), alias=7), lambda b: (b.header_done(), b.value_change(0, "1")), lambda b: (b.header_done(), b.set_time(5), b.set_time(4)),
        lambda b: (b.header_done(), b.set_time(0), b.value_change(9, "1")), lambda b: (b.header_done(), b.set_time(0), b.value_change(0, 1.0)), lambda b: (b.header_done(), b.set_time(0), b.value_change(0, "10")),
        lambda b: (b.header_done(), b.finish(), b.finish()), lambda b: (b.header_done(), b.finish(), b.take_database(), b.take_database()),
    ],
)
def test_protocol(spark, calls):
    b = ValidatingBuilder(Builder(spark))
    b.declare("clk", Scalar())
    with pytest.raises(WaveError):
        calls(b)


def test_bad_stores(spark, tmp_path):
    with pytest.raises(StoreError):
        open_store(spark, str(tmp_path / "none"))
    db, _ = built(spark, lambda b: b.declare("clk", Scalar()), [(0, 0, "1")])
    write_store(db, str(tmp_path / "s"))
    spark.createDataFrame([(9, 0, "x", "module")], "scope_id int, parent_id int, name string, kind string").write.mode("append").parquet(str(tmp_path / "s/scopes"))
    with pytest.raises(StoreError):
        open_store(spark, str(tmp_path / "s"))


def test_vcd(spark, tmp_path):
    from wavelark.sources.vcd import VcdDataSource, VcdReader

    dump = tmp_path / "a.vcd"
    dump.write_text("$timescale 1ns $end $scope module top $end $var wire 1 ! clk $end $var reg 8 # data [7:0] $end $var wire 1 ! mirror $end $var real 64 r temp $end $upscope $end $enddefinitions $end #0 0! b101 # r1.5 r #10 1! bx # $dumpvars $end")
    db = ingest(VcdReader(str(dump)), Builder(spark))
    assert db.find("top.data").value_at(0) == "00000101" and db.find("top.data").value_at(10) == "x" * 8 and db.find("top.mirror").value_at(10) == "1" and db.find("top.temp").value_at(3) == 1.5
    assert ingest_header(VcdReader(str(dump)), Builder(spark)).find("top.clk").value_at(9) is None
    spark.dataSource.register(VcdDataSource)
    assert spark.read.format("vcd").option("path", str(dump)).load().count() == db.rows.count() == 5


def test_large_dump(spark, tmp_path):
    """Blocks of 200 bytes: the header, times and changes all reach over their ends."""
    from wavelark.sources.dumps import read_dump, write_dump
    from wavelark.sources.vcd import VcdReader

    head = "$timescale 10 ps $end\n$scope module top $end\n$var wire 1 #5 clk $end\n$var reg 8 # data [7:0] $end\n$var wire 1 #5 mirror $end\n$scope module sub $end\n$var real 64 b1 temp $end\n$var string 1 s name $end\n$upscope $end\n$upscope $end\n$comment #77 $end\n$enddefinitions $end\n$dumpvars\n1#5\nbx #\n$end\n"
    body = "".join(f"#{t}\n" + (f"{t % 2}#5 b{t % 200:b} #\n" if t % 3 else f"r{t / 4} b1\nsv{t} s\nbz1 #\n$comment 1#5 $end\n") + f"B{t % 7:b}X #\n" * (t % 40) for t in range(0, 60, 2))
    dump = tmp_path / "a.vcd"
    dump.write_text(head + body)
    want = ingest(VcdReader(str(dump)), Builder(spark))
    kept = ("stream_id", "t", "bits", "real", "str")
    order = lambda db: [tuple(r[c] for c in kept) for r in db.rows.orderBy("seq").collect()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = read_dump(spark, str(dump))
        assert order(got) == order(want) and got.scale == want.scale and got.streams == want.streams and got.hierarchy.dump() == want.hierarchy.dump()
        write_dump(got, str(tmp_path / "out"))
        again = read_dump(spark, str(tmp_path / "out"))
        place = lambda db: sorted((repr(tuple(r)) for r in db.rows.select(*kept).collect()))
        assert place(again) == place(want) and again.hierarchy.dump() == want.hierarchy.dump()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "d.vcd").write_text(head.split("$dumpvars")[0])
    assert read_dump(spark, str(tmp_path / "d.vcd")).rows.count() == 0
    (tmp_path / "b.vcd").write_text(head + "#1\nb101\n#\n")
    with pytest.raises(Exception, match="no identifier"):
        read_dump(spark, str(tmp_path / "b.vcd")).rows.collect()
    (tmp_path / "c.vcd").write_text(head + "#1\n1?\n")
    with pytest.raises(Exception, match="no variable"):
        read_dump(spark, str(tmp_path / "c.vcd")).rows.collect()
    with pytest.raises(WaveError):
        read_dump(spark, str(tmp_path / "none"))


def test_streaming(spark, tmp_path):
    from wavelark.streaming.ingest import append_to_store, monotonic, slice_changes

    schema = "stream_id int, t long, seq long, bits string, real double, str string"
    for i, rows in enumerate(([(0, 0, 0, "00", None, None), (0, 5, 1, "01", None, None)], [(0, 4, 2, "01", None, None), (1, 0, 3, "11", None, None), (0, 6, 4, "10", None, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("late", monotonic(source())), ("cut", slice_changes(source(), 0, 1))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert [r.seq for r in spark.table("late").filter("late").collect()] == [2] and spark.table("late").count() == 5
    assert sorted(r.seq for r in spark.table("cut").collect()) == [0, 1, 3, 4]
    append_to_store(source(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_synthetic(spark):
    from wavelark.sources.synthetic import waveform, wide_design

    rows = waveform(spark, 50, 100)
    assert rows.count() == rows.select("stream_id", "t").distinct().count() and wide_design(spark, 2, 10).count() == 22


def test_append_to_a_store(spark, tmp_path):
    """Streamed rows join those of a store that was written before; its range and checksums follow, and a batch that is
    written twice counts once."""
    from wavelark.streaming.ingest import append_to_store

    db, _ = built(spark, lambda b: b.declare("clk", Scalar()), [(5, 0, "1")])
    path = str(tmp_path / "store")
    write_store(db, path)
    schema = "stream_id int, t long, seq long, bits string, real double, str string"
    for i in range(3):
        spark.createDataFrame([(0, 20 + i, 10 + i, "01"[i % 2], None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for round in range(2):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        append_to_store(source, f"{path}/changes", str(tmp_path / f"c{round // 2}")).awaitTermination()
        again = open_store(spark, path, verify=True)
        assert [(r.t, r.bits) for r in again.rows.orderBy("t").collect()] == [(5, "1"), (20, "0"), (21, "1"), (22, "0")]
        assert again.time_range() == TimeRange(5, 23)
    spark.createDataFrame([(0, 1, 1, "1", None, None)], schema).write.mode("append").parquet(f"{path}/changes")
    open_store(spark, path)
    with pytest.raises(StoreError):
        open_store(spark, path, verify=True)


def test_held_changes_are_read(spark, tmp_path):
    db, n = built(spark, lambda b: [b.declare(f"s{i}", Scalar()) for i in range(4)], [(t, t % 4, "01"[t % 3 % 2]) for t in range(40)])
    plain = [[db.value_at(i, t) for t in (0, 7, 39)] for i in n]
    assert db.cached_bytes() == 0 and db.prefetch([0, 1, 2]) == 30 and db.cached_bytes() > 0
    rows, db.rows = db.rows, db.rows.limit(0)  # nothing but what is held can answer
    assert [[db.value_at(i, t) for t in (0, 7, 39)] for i in n[:3]] == plain[:3] and db.value_at(n[3], 39) is None
    assert db.changes(n[:3]).count() == 30 and db.next_change(n[1], 1) == 5
    db.release(keep=[1])
    assert db.value_at(n[1], 39) == plain[1][2] and db.value_at(n[0], 39) is None
    db.release()
    assert db.cached_bytes() == 0 and db.value_at(n[1], 39) is None
    db.rows = rows
    assert db.value_at(n[3], 39) == plain[3][2] and db.stream_count() == 4 and db.block_count(4) == 12


def test_decimals_of_any_width(spark):
    from wavelark.functions import logic

    rng = random.Random(3)
    bits = ["".join(rng.choice("01") for _ in range(n)) for n in (1, 29, 64, 126, 127, 127, 128, 144, 145, 174, 203, 512, 1000)]
    bits += ["1" * n for n in (126, 127, 128, 290)] + ["1" + "0" * n for n in (126, 127, 300)] + ["0" * 200, "x" + "1" * 130, ""]
    rows = spark.createDataFrame([(b,) for b in bits], "bits string").select("bits", logic.to_dec("bits").alias("plain"), logic.to_dec("bits", signed=True).alias("signed"), logic.to_string("bits", "dec").alias("text")).collect()
    for r in rows:
        known = r.bits and "x" not in r.bits
        value = int(r.bits, 2) if known else None
        assert r.plain == r.text == (str(value) if known else "x" if r.bits else "")
        assert r.signed == (str(value - (1 << len(r.bits)) if r.bits[0] == "1" else value) if known else r.plain)


def test_hot_stream_in_buckets(spark):
    """A third of the rows, and more, are of one stream: cut by time, every verb gives what it gives uncut."""
    rng = random.Random(8)
    rows, t = [], [0] * 5
    for seq in range(600):
        s = 0 if seq % 3 else rng.randrange(5)
        t[s] += rng.choice((0, 0, 1, 2, 40))
        rows.append((s, t[s], seq, rng.choice("01x") + rng.choice("01")))
    df = spark.createDataFrame(rows, "stream_id int, t long, seq long, bits string")
    probes = spark.createDataFrame([(i, rng.randrange(5), rng.randrange(-5, 4000)) for i in range(150)], "probe long, stream_id int, t long")
    slices = spark.createDataFrame([(f"{s}", s, 0, 1) for s in range(5)], "slice string, stream_id int, slice_offset int, slice_width int")
    mixed_up = df.withColumn("t", df["t"] - df["seq"] % 7)
    verbs = {
        "as_of": lambda b: ops.as_of(df, probes, bucket=b), "following": lambda b: ops.following(df, probes, bucket=b), "held": lambda b: ops.held(df, bucket=b), "blocks": lambda b: ops.blocks(df, 7, bucket=b),
        "slice_changes": lambda b: ops.slice_changes(df, slices, TimeRange(100, 3000), bucket=b), "slice_edges": lambda b: ops.slice_edges(df, slices, bucket=b), "unsorted": lambda b: ops.unsorted(mixed_up, bucket=b), "sub_block": lambda b: ops.sub_block(df, 3, 50, bucket=b),
    }
    for name, verb in verbs.items():
        want, got = (verb(b) for b in (None, 16))
        assert sorted(want.columns) == sorted(got.columns)
        want, got = (sorted((repr(tuple(r[c] for c in sorted(want.columns))) for r in x.collect())) for x in (want, got))
        assert want == got and want, name


def test_order_of_merges(spark):
    rows = [(s, t, 10 * t + s, "1") for s in range(3) for t in (0, 0, 5, 9) if t or s]
    df = spark.createDataFrame([(s, t, i, b) for i, (s, t, _, b) in enumerate(rows)], "stream_id int, t long, seq long, bits string").repartition(4)
    request = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "source int, stream_id int")
    merged = ops.merged(df, request)
    want = sorted((r.t, r.source, r.seq) for r in merged.collect())
    assert [(r.t, r.source, r.seq) for r in ops.ordered(merged).collect()] == want
    assert [(r.t, r.source, r.seq) for r in ops.numbered(merged, "ord").orderBy("ord").collect()] == want
    assert sorted(r.ord for r in ops.numbered(merged, "ord").collect()) == list(range(len(want))) and ops.numbered(merged.limit(0), "ord").count() == 0


def test_trees(spark):
    from wavelark.operators.tree import scope_paths

    schema = "scope_id int, parent_id int, name string, kind string, ord int"
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"s{i}", "module", 0) for i in range(12)], schema)
    assert {r.scope_id: r.path for r in scope_paths(chain).collect()} == {i: ".".join(f"s{k}" for k in range(i + 1)) for i in range(12)}
    looped = chain.union(spark.createDataFrame([(3, 11, "again", "module", 0)], schema))
    with pytest.raises(Exception, match="cycle"):
        scope_paths(looped).collect()


class Shelf:
    """A device of two streams, ten blocks each; it writes down what it is asked for."""

    def __init__(self, options):
        self.log = options["log"]

    def blocks(self):
        from wavelark.sources.blocks import Block

        return [Block(s, 100 * k, 100 * k + 90, offset=1000 * s + k, cookie={"s": s}) for s in range(2) for k in range(10)]

    def decode(self, block):
        with open(self.log, "a") as log:
            log.write(f"{block.offset}\n")
        assert block.cookie["s"] == block.stream
        for i in range(10):
            yield block.t_begin + 10 * i, block.offset * 10 + i, str(i % 2), None, None


def test_foreign_blocks(spark, tmp_path):
    from wavelark.sources.blocks import BlockDataSource

    spark.dataSource.register(BlockDataSource)
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda log: spark.read.format("blocks").option("device", "tests.test_engine:Shelf").option("log", str(tmp_path / log)).load()
        assert read("all").count() == 200 and read("all").rdd.getNumPartitions() == 20
        picked = read("some").filter("stream_id = 1 AND t >= 250 AND t < 420").collect()
        assert sorted(r.t for r in picked) == list(range(250, 420, 10)) and {r.stream_id for r in picked} == {1}
        assert sorted(map(int, (tmp_path / "some").read_text().split())) == [1002, 1003, 1004]
        assert ops.snapshot(read("snap"), 305).orderBy("stream_id").select("t").collect() == [(300,), (300,)]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)


def test_bounded_ingestion(spark, monkeypatch):
    from wavelark import builder

    monkeypatch.setattr(builder, "BATCH", 50)
    b = Builder(spark)
    b.declare("clk", Scalar())
    for t in range(175):
        b.set_time(t)
        b.value_change(0, "01"[t % 2])
        assert len(b._rows) < 50
    b.finish()
    assert [(r.t, r.bits) for r in b.changes().orderBy("seq").collect()] == [(t, "01"[t % 2]) for t in range(175)]


def test_wide_composite_in_one_job(spark):
    db, node = built(spark, lambda b: b.declare("mem", Array(Vector(3, 0), 0, 299)), [(t, t % 300, "0001") for t in range(5, 400, 3)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("edges", "edges")
    assert db.next_change(node, 6) == 8 and db.prev_change(node, 6) == 5
    assert len(tracker.getJobIdsForGroup("edges")) < 30  # not one for each of the 300 leaves
    assert db.value_at(node, 399)[5] == "0001" and db.find("top.mem[8]").has_own_stream and db.signal(node).is_composite and len(db.signal(node).leaf_streams()) == 300
    assert db.root.signal(0) is None and db.root.scope(0).signal(0).id == node and db.root.scope(0).signal(1) is None


def test_hot_time(spark):
    """A third of the changes are at one time: its header is on the row of least source and seq, and each time has one."""
    from wavelark.sources.export import change_lines

    rows = [(s, 0, s + 100, "1") for s in range(100)] + [(s, 1 + s % 50 + k, 1000 * k + s, "0") for s in range(100) for k in (0, 60)]
    lines = change_lines(spark.createDataFrame(rows, "source int, t long, seq long, bits string")).collect()
    heads = {r.t: (r.source, r.seq) for r in lines if r.header is not None}
    assert len(lines) == 300 and sum(r.header is not None for r in lines) == len(heads)
    assert heads == {t: min((s, q) for s, u, q, _ in rows if u == t) for t in {r[1] for r in rows}} and all(r.header in (None, f"#{r.t}") for r in lines)
