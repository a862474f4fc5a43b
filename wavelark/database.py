"""A design and the changes of its streams, and the questions one asks of them.

Point questions come back to the driver as Python values; ``changes`` gives DataFrames. Values are text for logic and
strings, floats for reals, lists for composites; None if there is none yet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import WaveError
from .functions.timing import WHOLE, TimeRange, TimeScale
from .hierarchy import Hierarchy, Node
from .operators import changes as ops
from .types import Type

#: Streams that are asked for by a list of their ids, at most; more are joined.
FEW = 256
CHANGES = "stream_id int, t bigint, seq bigint, bits string, real double, str string"


class Database:
    def __init__(self, hierarchy: Hierarchy, changes: DataFrame, streams: dict[int, tuple[str, int]] | None = None, scale: TimeScale | None = None, time: TimeRange | None = None):
        """time: the range of the changes where it is known, as a store knows it; else it is found by a scan."""
        self.hierarchy, self.rows, self.streams, self.scale = hierarchy, changes, streams or {}, scale or TimeScale()
        self._time = time
        self._held: tuple[frozenset[int], TimeRange, DataFrame, set[int]] | None = None

    # the design

    @property
    def root(self) -> "Scope":
        return Scope(self, 0)

    def find(self, path: str) -> "Signal | None":
        node = self.hierarchy.find(path)
        return None if node is None else Signal(self, node)

    def find_scope(self, path: str) -> "Scope | None":
        scope = self.hierarchy.find_scope(path)
        return None if scope is None else Scope(self, scope)

    def signal(self, node: int) -> "Signal":
        return Signal(self, self.hierarchy.node(node).id)

    def leaf_nodes(self, scope: int = 0) -> list[int]:
        return self.hierarchy.scope_leaves(scope)

    # values

    def time_range(self) -> TimeRange:
        if self._time is None:
            row = ops.time_range(self.rows).first()
            self._time = TimeRange(0, 0) if row.t_begin is None else TimeRange(row.t_begin, row.t_end)
        return self._time

    def _of(self, streams: list[int], time: TimeRange) -> DataFrame:
        """The changes of the streams, from memory if all of them in the range are held there."""
        if self._held is not None:
            held, span, frame, _ = self._held
            if held.issuperset(streams) and span.begin <= time.begin and time.end <= span.end:
                return frame.filter(F.col("stream_id").isin(streams)) if len(streams) < len(held) else frame
        if len(streams) <= FEW:
            return self.rows.filter(F.col("stream_id").isin(streams))
        asked = self.rows.sparkSession.createDataFrame([(s,) for s in streams], "stream_id int")
        return self.rows.join(asked, "stream_id", "left_semi").select(*self.rows.columns)

    def _place(self, node: int) -> tuple[Node, int | None, tuple[int, int] | None]:
        """The node, the stream that holds it, and the slice of that."""
        at = self.hierarchy.node(node)
        if at.stream is not None:
            return at, at.stream, None
        owner = self.hierarchy.owner(node)
        return at, self.hierarchy.nodes[owner].stream if at.slice and owner is not None else None, at.slice

    def _pieces(self, node: int) -> list[int]:
        """Nodes, with a stream or a slice of their own and no children, that make up a node's value, in order."""
        at = self.hierarchy.node(node)
        return [x for c in at.children for x in self._pieces(c)] if at.children else [node]

    def value_at(self, node: int, t: int):
        pieces = self._pieces(node)
        places = {p: self._place(p) for p in pieces}
        streams = sorted({s for _, s, _ in places.values() if s is not None})
        found = {r.stream_id: r for r in ops.snapshot(self._of(streams, TimeRange(WHOLE.begin, t + 1)), t).collect()} if streams else {}

        def value(n: int):
            at = self.hierarchy.node(n)
            if at.children:
                return [value(c) for c in at.children]
            _, stream, cut = places[n]
            row = found.get(stream)
            if row is None:
                return None
            if row.bits is None:
                return row.real if row.real is not None else row.str
            return row.bits if cut is None else take_slice(row.bits, *cut)

        return value(node)

    def values_at(self, probes: DataFrame, bucket: int | None = None) -> DataFrame:
        """For rows (probe, stream_id, t): the value each stream had."""
        return ops.as_of(self.rows, probes, bucket=bucket)

    def changes(self, nodes: int | list[int], time: TimeRange = WHOLE) -> DataFrame:
        """source, t, seq and value, in order of t, source and seq. A list numbers its nodes; a lone composite its leaves."""
        if isinstance(nodes, int):
            at = self.hierarchy.node(nodes)
            many = at.stream is None and at.slice is None and at.children
            requests = list(enumerate(self.hierarchy.leaves(nodes))) if many else [(0, nodes)]
        else:
            requests = [(i, x) for i, n in enumerate(nodes) for x in (self.hierarchy.leaves(n) if self.hierarchy.node(n).slice is None else [n])]
        plain, cut = [], []
        for source, n in requests:
            _, stream, slice = self._place(n)
            if stream is not None:
                plain.append((source, stream)) if slice is None else cut.append((source, f"{source}.{n}", stream, *slice))
        spark = self.rows.sparkSession
        one = spark.createDataFrame(plain, "source int, stream_id int")
        two = spark.createDataFrame(cut, "source int, slice string, stream_id int, slice_offset int, slice_width int")
        streams = sorted({x[1] for x in plain} | {x[2] for x in cut})
        rows = self._of(streams, TimeRange(WHOLE.begin, time.end) if cut else time) if streams else self.rows.limit(0)
        if not cut:
            return ops.ordered(ops.merged(rows, one, time).select("source", "t", "seq", *ops.values(rows)))
        return ops.ordered(ops.mixed(rows, one, two, time))

    def _parts(self, node: int) -> list[tuple[int, tuple[int, int] | None]]:
        """The streams and slices of streams that a node consists of: its own, or its children's."""
        at, stream, cut = self._place(node)
        if at.stream is None and at.children:
            return [x for c in at.children for x in self._parts(c)]
        return [] if stream is None else [(stream, cut)]

    def _edges(self, node: int, low: bool, t: int) -> int | None:
        """Next (low) or previous change of any part of a node, in one job however many parts there are."""
        parts = self._parts(node)
        plain, cut = sorted({s for s, c in parts if c is None}), [(f"{s}.{c[0]}.{c[1]}", s, *c) for s, c in dict.fromkeys(parts) if c is not None]
        span = TimeRange(t + 1, WHOLE.end) if low else TimeRange(WHOLE.begin, t)
        times = []
        if plain:
            times.append(ops.in_range(self._of(plain, span), span).select("t"))
        if cut:
            slices = self.rows.sparkSession.createDataFrame(cut, "slice string, stream_id int, slice_offset int, slice_width int")
            # a change after t is told by the value before it
            rows = self._of(sorted({x[1] for x in cut}), WHOLE)
            times.append(ops.in_range(ops.slice_edges(rows, slices), span).select("t"))
        if not times:
            return None
        return reduce(DataFrame.union, times).agg(F.min("t") if low else F.max("t")).first()[0]

    def next_change(self, node: int, after: int) -> int | None:
        return self._edges(node, True, after)

    def prev_change(self, node: int, before: int) -> int | None:
        return self._edges(node, False, before)

    # care of memory

    def prefetch(self, streams: list[int], time: TimeRange = WHOLE) -> int:
        """Hold the streams' changes of a range in memory (on disk where it is short), where questions about them are then
        answered from; how many they are."""
        self.release()
        return self._hold(ops.in_range(self.rows, time, streams), streams, time)

    def _hold(self, rows: DataFrame, streams: list[int], time: TimeRange) -> int:
        context = self.rows.sparkSession.sparkContext._jsc
        before = set(context.getPersistentRDDs().keys())
        frame = rows.persist()
        n = frame.count()
        self._held = frozenset(streams), time, frame, set(context.getPersistentRDDs().keys()) - before
        return n

    def release(self, keep: list[int] | None = None) -> None:
        """Let go of what is held, but for the streams to keep."""
        if self._held is None:
            return
        held, time, frame, _ = self._held
        kept, self._held = sorted(held.intersection(keep or ())), None
        if kept:
            self._hold(frame.filter(F.col("stream_id").isin(kept)), kept, time)
        frame.unpersist(blocking=True)

    def cached_bytes(self) -> int:
        """Bytes that what is held takes, in memory and on disk."""
        if self._held is None:
            return 0
        own = self._held[3]
        return sum(x.memSize() + x.diskSize() for x in self.rows.sparkSession.sparkContext._jsc.sc().getRDDStorageInfo() if x.id() in own)

    def stream_count(self) -> int:
        return len(self.streams)

    def block_count(self, size: int = 4096) -> int:
        """Blocks of so many changes that the streams make up."""
        return ops.density(self.rows).agg(F.sum(F.ceil(F.col("n") / size))).first()[0] or 0

    def duplicate(self) -> "Database":
        """Another reader of the same data."""
        return Database(self.hierarchy, self.rows, self.streams, self.scale, self._time)

    def metadata_bytes(self) -> int:
        sizes = self.hierarchy.sizes()
        return sizes["name_bytes"] + 8 * (sizes["index_entries"] + sizes["nodes"] + sizes["scopes"])


def take_slice(bits: str, offset: int, width: int) -> str:
    """width bits from bit offset up; x beyond the width."""
    full = bits.rjust(offset + width, "x")
    return full[len(full) - offset - width : len(full) - offset]


@dataclass(frozen=True)
class Signal:
    db: Database
    id: int

    @property
    def node(self) -> Node:
        return self.db.hierarchy.node(self.id)

    @property
    def name(self) -> str:
        return self.node.name

    @property
    def type(self) -> Type | None:
        return self.node.type

    @property
    def kind(self) -> str:
        return self.node.type.kind if self.node.type else "void"

    @property
    def width(self) -> int:
        return self.node.type.width if self.node.type else 0

    @property
    def path(self) -> str:
        return self.db.hierarchy.path(self.id)

    @property
    def is_leaf(self) -> bool:
        return not self.node.children

    @property
    def is_composite(self) -> bool:
        return bool(self.node.children)

    @property
    def has_own_stream(self) -> bool:
        return self.node.stream is not None

    def leaf_streams(self) -> list[int]:
        """The streams of the leaves, in order."""
        return [self.db.hierarchy.node(n).stream for n in self.leaf_nodes()]

    @property
    def stream(self) -> int | None:
        return self.node.stream

    @property
    def parent(self) -> "Signal | None":
        return None if self.node.parent is None else Signal(self.db, self.node.parent)

    def __len__(self) -> int:
        return len(self.node.children)

    def __bool__(self) -> bool:
        return True

    def __getitem__(self, which: int | str) -> "Signal":
        """A child by place or name."""
        child = self.db.hierarchy.member(self.id, which) if isinstance(which, str) else self.node.children[which] if 0 <= which < len(self) else None
        if child is None:
            raise WaveError(f"{self.path} has no child {which!r}")
        return Signal(self.db, child)

    def __iter__(self):
        return (Signal(self.db, c) for c in self.node.children)

    def find(self, path: str) -> "Signal | None":
        found = self.db.hierarchy.find_from(self.id, path)
        return None if found is None else Signal(self.db, found)

    def leaf_nodes(self) -> list[int]:
        return self.db.hierarchy.leaves(self.id)

    def value_at(self, t: int):
        return self.db.value_at(self.id, t)

    def changes(self, time: TimeRange = WHOLE) -> DataFrame:
        return self.db.changes(self.id, time)

    def next_change(self, after: int) -> int | None:
        return self.db.next_change(self.id, after)

    def prev_change(self, before: int) -> int | None:
        return self.db.prev_change(self.id, before)


@dataclass(frozen=True)
class Scope:
    db: Database
    id: int

    @property
    def name(self) -> str:
        return self.db.hierarchy.scope(self.id).name

    @property
    def kind(self) -> str:
        return self.db.hierarchy.scope(self.id).kind

    @property
    def path(self) -> str:
        return self.db.hierarchy.scope_path(self.id)

    @property
    def parent(self) -> "Scope | None":
        at = self.db.hierarchy.scope(self.id).parent
        return None if at is None else Scope(self.db, at)

    @property
    def scopes(self) -> "list[Scope]":
        return [Scope(self.db, s) for s in self.db.hierarchy.scope(self.id).scopes]

    @property
    def signals(self) -> list[Signal]:
        return [Signal(self.db, s) for s in self.db.hierarchy.scope(self.id).signals]

    def scope(self, name: int | str) -> "Scope | None":
        """A scope within this one, by place or name."""
        if isinstance(name, int):
            return self.scopes[name] if 0 <= name < len(self.scopes) else None
        found = self.db.hierarchy.child_scope(self.id, name)
        return None if found is None else Scope(self.db, found)

    def signal(self, name: int | str) -> Signal | None:
        """A signal of this scope, by place or name."""
        if isinstance(name, int):
            return self.signals[name] if 0 <= name < len(self.signals) else None
        found = self.db.hierarchy.child_signal(self.id, name)
        return None if found is None else Signal(self.db, found)

    def find(self, path: str) -> Signal | None:
        found = self.db.hierarchy.find(path, self.id)
        return None if found is None else Signal(self.db, found)

    def find_scope(self, path: str) -> "Scope | None":
        found = self.db.hierarchy.find_scope(path, self.id)
        return None if found is None else Scope(self.db, found)

    def leaf_nodes(self) -> list[int]:
        return self.db.leaf_nodes(self.id)
