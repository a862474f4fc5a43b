import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wavelark.functions import logic, timing
from wavelark.functions.timing import TimeRange, TimeScale
from wavelark.types import Array, Enum, Member, Scalar, String, Struct, Vector, from_json, sv_text, to_json


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize(
    ("bits", "hex"),
    [("1010", "a"), ("00000001", "01"), ("10011", "13"), ("0011xxxx", "3x"), ("zzzz0001", "z1"), ("1x1z0000", "x0"), ("10x1", "x"), ("0zz1", "x"), ("xxxx", "x"), ("zzzz", "z"), ("", "")],
)
def test_hex(spark, bits, hex):
    assert one(spark, logic.to_hex(F.lit(bits))) == hex


def test_radixes(spark):
    b = lambda x: F.lit(x)
    cases = [
        (logic.to_oct(b("101011")), "53"), (logic.to_oct(b("111zzz")), "7z"), (logic.to_dec(b("10100101")), "165"), (logic.to_dec(b("10100101"), True), "-91"),
        (logic.to_dec(b("1"), True), "-1"), (logic.to_dec(b("1x")), "x"), (logic.to_dec_wide(b("1" * 128)), str(2**128 - 1)), (logic.to_dec_wide(b("1" * 128), True), "-1"),
        (logic.to_dec(b("1" + "0" * 64)), str(2**64)), (logic.to_dec(b("1" + "0" * 100)), str(2**100)), (logic.to_uint64(b("10100101")), 165), (logic.to_uint64(b("1z")), None), (logic.to_uint64(b("")), 0), (logic.to_uint64(b("1" * 64)), 2**64 - 1),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(row) == [x for _, x in cases]
    with pytest.raises(ValueError):
        logic.to_string("bits", "base7")


def test_slices_against_bits(spark):
    pattern = "".join("01xz"[(i * 7 + i // 5) % 4] for i in range(200))
    at = lambda i: pattern[199 - i] if i < 200 else "x"
    cases = [(o, w) for o in (0, 1, 31, 63, 64, 65, 130, 199, 200, 250) for w in (0, 1, 2, 63, 64, 65, 128)]
    row = spark.range(1).select(*(logic.slice_bits(F.lit(pattern), o, w).alias(f"c{i}") for i, (o, w) in enumerate(cases))).first()
    assert list(row) == ["".join(at(i) for i in range(o + w - 1, o - 1, -1)) for o, w in cases]


def test_edits(spark):
    b = F.lit("01xz")
    cases = [
        (logic.invert(b), "10xx"), (logic.normalize(F.lit("01XzZq-")), "01xzzxx"), (logic.get(b, 0), "z"), (logic.get(b, 4), "x"), (logic.set_bit(b, 0), "01x1"), (logic.reset_bit(b, 2), "00xz"), (logic.flip_bit(b, 3), "11xz"),
        (logic.push_back(b, F.lit("1")), "101xz"), (logic.pop_back(b), "1xz"), (logic.pop_back(F.lit("")), ""), (logic.resize(b, 2), "xz"), (logic.resize(b, 6), "0001xz"), (logic.coerce(b, 6), "xx01xz"),
        (logic.assign_chars(b, F.lit("1")), "01x1"), (logic.assign_uint64(F.lit("zzzz"), F.lit(5)), "0101"), (logic.from_planes(logic.aval(b), logic.bval(b)), "01xz"), (logic.collapse9(F.lit("LHWU-01")), "01xxx01"),
        (logic.plane_words(F.lit("1" + "0" * 64)), [0, 1]), (logic.plane_words(F.lit("1" * 64)), [-1]), (logic.words_for(65), 2),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(row) == [x for _, x in cases]
    with pytest.raises(PySparkException):
        one(spark, logic.test(b, 4))
    assert set(logic.register(spark)) and spark.sql("SELECT logic_slice('101101', 4, 4) AS s").first().s == "xx10"


def test_time():
    a, b = TimeRange(100, 200), TimeRange(150, 300)
    assert a.overlaps(b) and a.intersect(b) == TimeRange(150, 200) and a.hull(b) == TimeRange(100, 300) and a.contains(150) and not a.contains(200)
    assert TimeRange(5, 5).empty() and timing.WHOLE.contains(0)
    assert str(TimeScale(-9, 10)) == "10 ns" and str(TimeScale(-7, 1)) == "1e-7 s" and TimeScale.parse("10 ns") == TimeScale(-9, 10) and TimeScale.parse("1e-7 s") == TimeScale(-7, 1) and TimeScale.parse("x") is None


def test_types():
    packed = Struct((Member("addr", Vector(7, 0), 1), Member("valid", Scalar(), 0)), True)
    assert Vector(0, 31).width == 32 and packed.width == 9 and Array(packed, 0, 3).width == 0 and Array(packed, 0, 3).stream_count == 4
    assert [Array(Scalar(), 3, 0).ordinal_of(i) for i in (3, 0, 4)] == [0, 3, None] and Array(Scalar(), 0, 3).index_of(4) is None
    assert Array(Scalar(), -(2**31), 2**31 - 1).element_count == 2**32
    e = Enum(Vector(1, 0), (("IDLE", 0), ("RUN", 1), ("", 2), ("LATE", 1)))
    assert [e.label_of(i) for i in (1, 2, 7)] == ["RUN", "", None]
    for t in (packed, Array(packed, 0, 3), e, String(), None, Struct(packed.members, True, True)):
        assert from_json(to_json(t)) == t
    assert sv_text(Vector(7, 0)) == "logic [7:0]"


def test_sql_names(spark):
    """What SQL calls by name is what the column functions give."""
    from pyspark.sql import functions as F

    from wavelark.functions import logic

    names = logic.register(spark)
    rows = spark.createDataFrame([(b,) for b in ("", "0", "z", "x1", "zzz", "1010", "zzzz1x01", "110", "1" * 64, "1" * 65, "0xz" * 9)], "b string")
    pairs = {
        "logic_invert(b)": logic.invert("b"), "logic_normalize(b)": logic.normalize("b"), "logic_two_state(b)": logic.is_two_state("b"), "logic_aval(b)": logic.aval("b"), "logic_bval(b)": logic.bval("b"),
        "logic_from_planes(logic_aval(b), logic_bval(b))": logic.from_planes(logic.aval("b"), logic.bval("b")), "logic_slice(b, 1, 3)": logic.slice_bits("b", 1, 3), "logic_get(b, 1)": logic.get("b", 1),
        "logic_push(b, '1')": logic.push_back("b", F.lit("1")), "logic_pop(b)": logic.pop_back("b"), "logic_resize(b, 5, 'z')": logic.resize("b", 5, "z"),
        "logic_uint64(b)": logic.to_uint64("b"), "logic_hex(b)": logic.to_hex("b"), "logic_oct(b)": logic.to_oct("b"), "logic_collapse9(b)": logic.collapse9("b"),
    }
    for sql, column in pairs.items():
        got, want = rows.select(F.expr(sql).alias("r")).collect(), rows.select(column.alias("r")).collect()
        assert got == want, sql
    long = rows.filter("length(b) > 2")
    for sql, column in {"logic_test(b, 1)": logic.test("b", 1), "logic_set(b, 2, '1')": logic.set_bit("b", 2), "logic_flip(b, 0)": logic.flip_bit("b", 0)}.items():
        assert long.select(F.expr(sql).alias("r")).collect() == long.select(column.alias("r")).collect(), sql
    assert len(names) == 18 == len(set(names))
