"""Types of signals: scalars, vectors, packed and unpacked arrays, structures and unions, enums, reals, strings."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import WaveError


class Type:
    kind = "void"
    four_state = False

    @property
    def width(self) -> int:
        """Bits of the value as one vector; 0 if it is none."""
        return 0

    @property
    def element_count(self) -> int:
        return 0

    @property
    def is_composite(self) -> bool:
        return self.element_count > 0

    @property
    def single_stream(self) -> bool:
        """Whether one stream can hold the value: leaves and packed composites."""
        return not self.is_composite or bool(getattr(self, "packed", False))

    def children(self) -> list[tuple[str, "Type"]]:
        """Names and types of members or elements, in order."""
        return []

    @property
    def stream_count(self) -> int:
        """Streams that a declaration of the type takes."""
        if self.single_stream:
            return 1
        return sum(t.stream_count for _, t in self.children())

    def __str__(self) -> str:
        return self.kind


@dataclass(frozen=True)
class Scalar(Type):
    four_state: bool = True
    kind = "scalar"

    @property
    def width(self) -> int:
        return 1


@dataclass(frozen=True)
class Vector(Type):
    msb: int
    lsb: int
    signed: bool = False
    four_state: bool = True
    kind = "vector"

    @property
    def width(self) -> int:
        return abs(self.msb - self.lsb) + 1


@dataclass(frozen=True)
class Array(Type):
    element: Type
    left: int
    right: int
    packed: bool = False
    kind = "array"

    @property
    def four_state(self) -> bool:
        return self.element.four_state

    @property
    def element_count(self) -> int:
        return abs(self.left - self.right) + 1

    @property
    def width(self) -> int:
        return self.element_count * self.element.width if self.packed else 0

    def ordinal_of(self, index: int) -> int | None:
        """Place of an index; the left one is 0."""
        low, high = sorted((self.left, self.right))
        return abs(index - self.left) if low <= index <= high else None

    def index_of(self, ordinal: int) -> int | None:
        if not 0 <= ordinal < self.element_count:
            return None
        return self.left - ordinal if self.left >= self.right else self.left + ordinal

    def ordinal_column(self, index: Column) -> Column:
        low, high = sorted((self.left, self.right))
        index = index.cast("bigint")
        return F.when(index.between(low, high), F.abs(index - F.lit(self.left)))

    def children(self) -> list[tuple[str, Type]]:
        return [(f"[{self.index_of(i)}]", self.element) for i in range(self.element_count)]


@dataclass(frozen=True)
class Member:
    name: str
    type: Type
    bit_offset: int = 0


@dataclass(frozen=True)
class Struct(Type):
    members: tuple[Member, ...]
    packed: bool = False
    union: bool = False

    @property
    def kind(self) -> str:
        return "union" if self.union else "struct"

    @property
    def four_state(self) -> bool:
        return any(m.type.four_state for m in self.members)

    @property
    def element_count(self) -> int:
        return len(self.members)

    @property
    def width(self) -> int:
        """The sum of the members' widths, of a union too."""
        return sum(m.type.width for m in self.members) if self.packed else 0

    def index_of(self, name: str) -> int | None:
        return next((i for i, m in enumerate(self.members) if m.name == name), None)

    def children(self) -> list[tuple[str, Type]]:
        return [(m.name, m.type) for m in self.members]


@dataclass(frozen=True)
class Enum(Type):
    base: Type
    entries: tuple[tuple[str, int], ...]
    kind = "enum"

    @property
    def four_state(self) -> bool:
        return self.base.four_state

    @property
    def width(self) -> int:
        return self.base.width

    def label_of(self, value: int) -> str | None:
        """The first label of a value; an empty label is one."""
        return next((name for name, v in self.entries if v == value), None)

    def label_column(self, value: Column) -> Column:
        first: dict[int, str] = {}
        for name, v in self.entries:
            first.setdefault(v, name)
        return F.try_element_at(F.create_map(*(F.lit(x) for v, name in first.items() for x in (v, name))), value)


@dataclass(frozen=True)
class Real(Type):
    shortreal: bool = False
    kind = "real"


@dataclass(frozen=True)
class String(Type):
    kind = "string"


def stream_kind(type: Type) -> str | None:
    """What a stream of the type holds: logic, real or string; None if it takes several streams."""
    if not type.single_stream:
        return None
    return {"real": "real", "string": "string"}.get(type.kind, "logic")


def sv_text(type: Type | None) -> str:
    """The type in the notation of the design language, as far as it has one."""
    if type is None:
        return "void"
    if isinstance(type, Scalar):
        return "logic" if type.four_state else "bit"
    if isinstance(type, Vector):
        return f"{'logic' if type.four_state else 'bit'}{' signed' if type.signed else ''} [{type.msb}:{type.lsb}]"
    if isinstance(type, Array):
        return f"{sv_text(type.element)} {'packed ' if type.packed else ''}[{type.left}:{type.right}]"
    if isinstance(type, Struct):
        return f"{type.kind}{' packed' if type.packed else ''} {{ {' '.join(f'{sv_text(m.type)} {m.name};' for m in type.members)} }}"
    if isinstance(type, Enum):
        return f"enum {sv_text(type.base)} {{ {', '.join(f'{n}={v}' for n, v in type.entries)} }}"
    if isinstance(type, Real):
        return "shortreal" if type.shortreal else "real"
    return type.kind


def to_json(type: Type | None) -> str:
    def plain(t: Type | None):
        if t is None:
            return None
        out = {"kind": t.kind}
        if isinstance(t, Array):
            return out | {"element": plain(t.element), "left": t.left, "right": t.right, "packed": t.packed}
        if isinstance(t, Struct):
            return out | {"members": [[m.name, plain(m.type), m.bit_offset] for m in t.members], "packed": t.packed}
        if isinstance(t, Enum):
            return out | {"base": plain(t.base), "entries": [list(e) for e in t.entries]}
        return out | {k: getattr(t, k) for k in getattr(t, "__dataclass_fields__", ())}

    return json.dumps(plain(type))


def from_json(text: str) -> Type | None:
    def build(x):
        if x is None:
            return None
        kind = x.pop("kind")
        if kind == "array":
            return Array(build(x["element"]), x["left"], x["right"], x["packed"])
        if kind in ("struct", "union"):
            return Struct(tuple(Member(n, build(t), o) for n, t, o in x["members"]), x["packed"], kind == "union")
        if kind == "enum":
            return Enum(build(x["base"]), tuple((n, v) for n, v in x["entries"]))
        known = {"scalar": Scalar, "vector": Vector, "real": Real, "string": String}
        if kind not in known:
            raise WaveError(f"no type {kind!r}")
        return known[kind](**x)

    return build(json.loads(text))
