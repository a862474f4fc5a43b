"""Ticks, time scales, and half-open ranges of ticks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exponents of the named units.
UNITS = {"s": 0, "ms": -3, "us": -6, "ns": -9, "ps": -12, "fs": -15}


@dataclass(frozen=True)
class TimeScale:
    """A tick is scale * 10^exponent seconds."""

    exponent: int = -12
    scale: int = 1

    def __str__(self) -> str:
        unit = next((u for u, e in UNITS.items() if e == self.exponent), None)
        return f"{self.scale} {unit}" if unit else f"{self.scale}e{self.exponent} s"

    def seconds(self, t: int) -> float:
        return float(t) * self.scale * 10.0**self.exponent

    @classmethod
    def parse(cls, text: str) -> "TimeScale | None":
        """What __str__ writes, with or without the blank; None if it is something else."""
        if m := re.fullmatch(r"\s*(\d+)\s*(s|ms|us|ns|ps|fs)\s*", text):
            return cls(UNITS[m[2]], int(m[1]))
        if m := re.fullmatch(r"\s*(\d+)e(-?\d+)\s*s\s*", text):
            return cls(int(m[2]), int(m[1]))
        return None


def seconds(t: Column, exponent: Column, scale: Column) -> Column:
    return t.cast("double") * scale * F.pow(F.lit(10.0), exponent)


def scale_text(exponent: Column, scale: Column) -> Column:
    names = F.create_map(*(F.lit(x) for u, e in UNITS.items() for x in (e, u)))
    unit = F.try_element_at(names, exponent)
    return F.when(unit.isNotNull(), F.concat_ws(" ", scale.cast("string"), unit)).otherwise(F.concat(scale.cast("string"), F.lit("e"), exponent.cast("string"), F.lit(" s")))


@dataclass(frozen=True, order=True)
class TimeRange:
    """[begin, end); empty if begin >= end."""

    begin: int
    end: int

    def empty(self) -> bool:
        return self.begin >= self.end

    def size(self) -> int:
        return 0 if self.empty() else self.end - self.begin

    def contains(self, t: int) -> bool:
        return self.begin <= t < self.end

    def overlaps(self, other: "TimeRange") -> bool:
        return self.begin < other.end and other.begin < self.end

    def intersect(self, other: "TimeRange") -> "TimeRange":
        return TimeRange(max(self.begin, other.begin), min(self.end, other.end))

    def hull(self, other: "TimeRange") -> "TimeRange":
        return TimeRange(min(self.begin, other.begin), max(self.end, other.end))

    def columns(self) -> "ColumnRange":
        return ColumnRange(F.lit(self.begin), F.lit(self.end))


@dataclass(frozen=True)
class ColumnRange:
    """A range of ticks in each row, with the questions of a TimeRange as columns."""

    begin: Column
    end: Column

    def empty(self) -> Column:
        return self.begin >= self.end

    def size(self) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), self.end - self.begin)

    def contains(self, t: Column) -> Column:
        return (self.begin <= t) & (t < self.end)

    def overlaps(self, other: "ColumnRange") -> Column:
        return (self.begin < other.end) & (other.begin < self.end)

    def intersect(self, other: "ColumnRange") -> "ColumnRange":
        return ColumnRange(F.greatest(self.begin, other.begin), F.least(self.end, other.end))

    def hull(self, other: "ColumnRange") -> "ColumnRange":
        return ColumnRange(F.least(self.begin, other.begin), F.greatest(self.end, other.end))

    def equals(self, other: "ColumnRange") -> Column:
        return (self.begin == other.begin) & (self.end == other.end)

    def not_after(self, other: "ColumnRange") -> Column:
        """By begin, then end."""
        return (self.begin < other.begin) | (self.begin == other.begin) & (self.end <= other.end)


WHOLE = TimeRange(-(1 << 63), (1 << 63) - 1)


def within(t: Column, time: TimeRange) -> Column:
    """On the raw column, so that it is pushed to the scan."""
    return (t >= time.begin) & (t < time.end)
