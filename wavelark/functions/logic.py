"""Four-state logic vectors as text of 0, 1, x and z, most significant bit first.

Bit i counts from the right. Everything is an expression of built-in functions, but for ``to_dec_wide``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Bits = Column | str


def _c(x: Bits) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _i(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def normalize(bits: Bits) -> Column:
    """Characters other than 0, 1, z and Z are x."""
    return F.regexp_replace(F.lower(_c(bits)), "[^01z]", "x")


def is01(char: Bits) -> Column:
    return _c(char).isin("0", "1")


def invert(bits: Bits) -> Column:
    """0 and 1 swap; x and z become x."""
    return F.translate(_c(bits), "01z", "10x")


def aval(bits: Bits) -> Column:
    return F.translate(_c(bits), "xz", "10")


def bval(bits: Bits) -> Column:
    return F.translate(_c(bits), "01xz", "0011")


def from_planes(a: Bits, b: Bits) -> Column:
    """The inverse of aval and bval."""
    codes = F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: F.when(y == "0", x).when(x == "1", "x").otherwise("z"))
    return F.array_join(codes, "")


def words_for(width: Column | int) -> Column:
    """64-bit words that hold so many bits."""
    return F.ceil(_i(width) / 64).cast("int")


def plane_words(plane: Bits) -> Column:
    """A plane as an array of signed 64-bit words, lowest first."""
    p, n = _c(plane), F.length(_c(plane))
    word = lambda i: F.substr(p, F.greatest(F.lit(1), n - i * 64 - 63), F.least(F.lit(64), n - i * 64))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), words_for(n) - 1), lambda i: F.conv(word(i), 2, -10).cast("bigint")))


def zeros(width: Column | int) -> Column:
    return F.repeat(F.lit("0"), _i(width))


def width(bits: Bits) -> Column:
    return F.length(_c(bits))


def slice_bits(bits: Bits, offset: Column | int, count: Column | int) -> Column:
    """count bits from bit offset up; x beyond the width."""
    b, off, n = _c(bits), _i(offset), _i(count)
    full = F.greatest(F.length(b), off + n)
    return F.substr(F.lpad(b, full, "x"), full - off - n + 1, n)


def get(bits: Bits, bit: Column | int) -> Column:
    """One bit; x at or beyond the width."""
    b, i = _c(bits), _i(bit)
    return F.when((i >= 0) & (i < F.length(b)), F.substr(b, F.length(b) - i, F.lit(1))).otherwise("x")


def _checked(b: Column, i: Column, out: Column) -> Column:
    return F.when((i >= 0) & (i < F.length(b)), out).otherwise(F.raise_error(F.concat(F.lit("no bit "), i.cast("string"))).cast("string"))


def test(bits: Bits, bit: Column | int) -> Column:
    """One bit; an error beyond the width."""
    return _checked(_c(bits), _i(bit), get(bits, bit))


def set_bit(bits: Bits, bit: Column | int, value: str = "1") -> Column:
    b, i = _c(bits), _i(bit)
    return _checked(b, i, F.overlay(b, F.lit(value), F.length(b) - i, F.lit(1)))


def reset_bit(bits: Bits, bit: Column | int) -> Column:
    return set_bit(bits, bit, "0")


def flip_bit(bits: Bits, bit: Column | int) -> Column:
    b, i = _c(bits), _i(bit)
    return _checked(b, i, F.overlay(b, invert(get(b, i)), F.length(b) - i, F.lit(1)))


def set_all(bits: Bits) -> Column:
    return F.repeat(F.lit("1"), F.length(_c(bits)))


def reset_all(bits: Bits) -> Column:
    return F.repeat(F.lit("0"), F.length(_c(bits)))


def push_back(bits: Bits, value: Bits) -> Column:
    """A new highest bit."""
    return F.concat(_c(value), _c(bits))


def pop_back(bits: Bits) -> Column:
    return F.substr(_c(bits), F.lit(2))


def resize(bits: Bits, n: Column | int, fill: str = "0") -> Column:
    b, n = _c(bits), _i(n)
    return F.when(n <= F.length(b), F.right(b, n)).otherwise(F.lpad(b, n, fill))


def clear() -> Column:
    return F.lit("")


def assign_chars(bits: Bits, chars: Bits) -> Column:
    """Overwrite the lowest bits, as many as there are characters; the others stay."""
    b, s = _c(bits), normalize(chars)
    n = F.least(F.length(b), F.length(s))
    return F.concat(F.left(b, F.length(b) - n), F.right(s, n))


def assign_uint64(bits: Bits, value: Bits) -> Column:
    """Overwrite the lowest bits, 64 at most, with those of a BIGINT; the others stay."""
    b = _c(bits)
    n = F.least(F.length(b), F.lit(64))
    return F.concat(F.left(b, F.length(b) - n), F.right(F.lpad(F.bin(_c(value)), 64, "0"), n))


def coerce(bits: Bits, n: Column | int) -> Column:
    """To a stream's width: surplus high bits are cut, missing ones are x."""
    return resize(bits, n, "x")


def is_two_state(bits: Bits) -> Column:
    return ~_c(bits).rlike("[xz]")


def to_uint64(bits: Bits) -> Column:
    """DECIMAL(20, 0); null if x or z or wider than 64; 0 for no bits."""
    b = _c(bits)
    return F.when((F.length(b) > 64) | ~is_two_state(b), None).when(F.length(b) == 0, F.lit(0)).otherwise(F.conv(b, 2, 10).cast("decimal(20,0)")).cast("decimal(20,0)")


def _digits(bits: Column, k: int) -> Column:
    n = F.length(bits)
    group = lambda d: F.substr(bits, F.greatest(F.lit(1), n - d * k - k + 1), F.least(F.lit(k), n - d * k))
    digit = lambda g: F.when(~g.rlike("[xz]"), F.lower(F.conv(g, 2, 16))).when(~g.rlike("[^z]"), "z").otherwise("x")
    return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.ceil(n / k).cast("int") - 1, F.lit(0), F.lit(-1)), lambda d: digit(group(d))), ""))


def to_hex(bits: Bits) -> Column:
    """Groups of four: all x is x, all z is z, any other with x or z is x."""
    return _digits(_c(bits), 4)


def to_oct(bits: Bits) -> Column:
    return _digits(_c(bits), 3)


def to_bin(bits: Bits) -> Column:
    return _c(bits)


#: Bits that to_dec takes at a time where a decimal of Spark cannot hold the value, and the digits of one limb.
_CHUNK, _LIMB = 29, 9


def _limbs_text(bits: Column, add: Column) -> Column:
    """Decimal digits of bits of any width, plus add (0 or 1): limbs of nine digits, lowest first, times 2^29 plus the
    next bits, from the top."""
    n, base = F.length(bits), 10**_LIMB
    head = F.pmod(n, F.lit(_CHUNK))
    size = F.ceil(n / _CHUNK).cast("int")
    padded = F.concat(F.repeat(F.lit("0"), F.pmod(_CHUNK - head, F.lit(_CHUNK)).cast("int")), bits)
    chunk = lambda i: F.conv(F.substr(padded, i * _CHUNK + 1, F.lit(_CHUNK)), 2, 10).cast("bigint")

    def times(limbs: Column, factor: int, plus: Column) -> Column:
        begin = F.struct(plus.alias("carry"), F.array().cast("array<bigint>").alias("limbs"))
        value = lambda s, x: x * factor + s["carry"]
        step = lambda s, x: F.struct(_divided(value(s, x), base).alias("carry"), F.concat(s["limbs"], F.array(value(s, x) % base)).alias("limbs"))
        return F.aggregate(limbs, begin, step, lambda s: F.concat(s["limbs"], F.array(s["carry"])))

    none = F.array(F.lit(0).cast("bigint"))
    limbs = F.aggregate(F.sequence(F.lit(0), size - 1), none, lambda s, i: times(s, 1 << _CHUNK, chunk(i)))
    limbs = times(limbs, 1, add.cast("bigint"))
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), _LIMB, "0")), "")
    return F.regexp_replace(text, "^0+(?=.)", "")


def _divided(x: Column, by: int) -> Column:
    """Whole quotient of numbers that are not negative: below 10^9, so the nearest double of it is off by less than a half."""
    return F.rint((x - x % by) / by).cast("bigint")


def to_dec(bits: Bits, signed: bool = False) -> Column:
    """Decimal digits, of any width; x if any bit is x or z. Up to 126 bits a decimal holds the value, beyond limbs do."""
    b, n = _c(bits), F.length(_c(bits))
    two = F.lit(2).cast("decimal(38,0)")
    sum_of = lambda text: F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0).cast("decimal(38,0)"), lambda a, i: (a * two + F.substr(text, i, F.lit(1)).cast("decimal(1,0)")).cast("decimal(38,0)"))
    flipped = F.translate(b, "01", "10")
    short, long = sum_of(b).cast("string"), _limbs_text(b, F.lit(0))
    if signed:
        negative = F.left(b, F.lit(1)) == "1"
        short = F.when(negative, F.concat(F.lit("-"), (sum_of(flipped) + 1).cast("decimal(38,0)").cast("string"))).otherwise(short)
        long = F.when(negative, F.concat(F.lit("-"), _limbs_text(flipped, F.lit(1)))).otherwise(long)
    return F.when(n == 0, "").when(~is_two_state(b), "x").when(n > 126, long).otherwise(short)


def to_dec_wide(bits: Bits, signed: bool = False) -> Column:
    """As to_dec, of any width, by Python's integers in Arrow batches."""
    def digits(b: str | None) -> str | None:
        if not b or set(b) - {"0", "1"}:
            return "x" if b else b
        return str(int(b, 2) - ((1 << len(b)) if signed and b[0] == "1" else 0))

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(digits)

    return run(_c(bits))


def to_string(bits: Bits, radix: str = "bin", signed: bool = False) -> Column:
    known = {"bin": to_bin, "oct": to_oct, "hex": to_hex, "dec": lambda b: to_dec(b, signed)}
    if radix not in known:
        raise ValueError(f"no radix {radix!r}")
    return known[radix](bits)


def collapse9(bits: Bits) -> Column:
    """Nine-value logic to four: L and H are 0 and 1, W, U and - are x."""
    return normalize(F.translate(_c(bits), "LlHhWwUu-", "0011xxxxx"))


_NO_BIT = "CAST(raise_error(concat('no bit ', i)) AS STRING)"
_SQL = {
    "invert(b STRING)": "translate(b, '01z', '10x')",
    "normalize(b STRING)": "regexp_replace(lower(b), '[^01z]', 'x')",
    "two_state(b STRING)": "NOT (b RLIKE '[xz]')",
    "aval(b STRING)": "translate(b, 'xz', '10')",
    "bval(b STRING)": "translate(b, '01xz', '0011')",
    "from_planes(a STRING, b STRING)": "array_join(zip_with(split(a, ''), split(b, ''), (x, y) -> CASE WHEN y = '0' THEN x WHEN x = '1' THEN 'x' ELSE 'z' END), '')",
    "slice(b STRING, o INT, n INT)": "substr(lpad(b, greatest(length(b), o + n), 'x'), greatest(length(b), o + n) - o - n + 1, n)",
    "get(b STRING, i INT)": "CASE WHEN i >= 0 AND i < length(b) THEN substr(b, length(b) - i, 1) ELSE 'x' END",
    "test(b STRING, i INT)": f"CASE WHEN i >= 0 AND i < length(b) THEN substr(b, length(b) - i, 1) ELSE {_NO_BIT} END",
    "set(b STRING, i INT, v STRING)": f"CASE WHEN i >= 0 AND i < length(b) THEN concat(left(b, length(b) - i - 1), v, right(b, i)) ELSE {_NO_BIT} END",
    "flip(b STRING, i INT)": f"CASE WHEN i >= 0 AND i < length(b) THEN concat(left(b, length(b) - i - 1), translate(substr(b, length(b) - i, 1), '01z', '10x'), right(b, i)) ELSE {_NO_BIT} END",
    "push(b STRING, v STRING)": "concat(v, b)",
    "pop(b STRING)": "substr(b, 2)",
    "resize(b STRING, n INT, f STRING)": "right(lpad(b, greatest(n, length(b)), f), n)",
    "uint64(b STRING)": "CASE WHEN length(b) > 64 OR b RLIKE '[xz]' THEN NULL WHEN b = '' THEN 0 ELSE CAST(conv(b, 2, 10) AS DECIMAL(20, 0)) END",
    "hex(b STRING)": "",
    "oct(b STRING)": "",
    "collapse9(b STRING)": "regexp_replace(lower(translate(b, 'LlHhWwUu-', '0011xxxxx')), '[^01z]', 'x')",
}


def _digits_body(k: int) -> str:
    """Groups of k bits from the right, as _digits has them."""
    own = f"substr(b, greatest(1, length(b) - {k} * (n - i) + 1), least({k}, length(b) - {k} * (n - i - 1)))"
    digit = lambda g: f"CASE WHEN NOT ({g} RLIKE '[xz]') THEN lower(conv({g}, 2, 16)) WHEN NOT ({g} RLIKE '[^z]') THEN 'z' ELSE 'x' END"
    count = f"CAST(ceil(length(b) / {k}) AS INT)"
    return f"CASE WHEN b = '' THEN '' ELSE array_join(transform(sequence(0, {count} - 1), i -> {digit(own.replace('n - i', f'{count} - i'))}), '') END"


def register(spark: SparkSession) -> list[str]:
    """SQL functions of the most used: logic_hex(bits), logic_slice(bits, offset, count) and so on; their names."""
    names = []
    for head, body in _SQL.items():
        name = head.partition("(")[0]
        body = body or _digits_body({"hex": 4, "oct": 3}[name])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION logic_{head} RETURN {body}")
        names.append(f"logic_{name}")
    return names
