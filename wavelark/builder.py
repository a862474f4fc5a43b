"""Ingestion in two phases: the header declares scopes and variables, then values come in order of time.

``Builder`` takes anything; ``ValidatingBuilder`` stands before one and refuses what breaks the protocol.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .database import CHANGES, Database
from .errors import WaveError
from .functions.timing import TimeScale
from .hierarchy import Hierarchy
from .sources.scratch import scratch_dir
from .types import Array, Struct, Type, stream_kind

#: Value changes held as Python rows before they become an Arrow table.
BATCH = 1 << 19


class Builder:
    """Gathers a header and changes; take_database() gives a database over them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.hierarchy, self.scale = spark, Hierarchy(), TimeScale()
        self.streams: dict[int, tuple[str, int]] = {}
        self._scope, self._time, self._seq = [0], 0, 0
        self._rows: list[tuple] = []
        self._folder: str | None = None

    def set_time_scale(self, scale: TimeScale) -> None:
        self.scale = scale

    def begin_scope(self, name: str, kind: str = "module") -> int:
        self._scope.append(self.hierarchy.add_scope(self._scope[-1], name, kind))
        return self._scope[-1]

    def end_scope(self) -> None:
        if len(self._scope) > 1:
            self._scope.pop()

    def _stream(self, type: Type) -> int | None:
        kind = stream_kind(type)
        if kind is None:
            return None
        self.streams[len(self.streams)] = (kind, type.width if kind == "logic" else 0)
        return len(self.streams) - 1

    def declare(self, name: str, type: Type, alias: int | None = None, leaves: list[int | None] | None = None) -> int:
        """A variable in the open scope. alias: the stream it shares. leaves: for a type of several streams, the stream
        of each leaf, or None for a new one, which is written back."""
        if leaves is not None and len(leaves) != type.stream_count:
            raise WaveError(f"{name} has {type.stream_count} leaves, not {len(leaves)}")
        if type.single_stream and leaves:
            alias = leaves[0] if leaves[0] is not None else alias
        stream = alias if alias is not None else self._stream(type)
        if type.single_stream and leaves:
            leaves[0] = stream
        node = self.hierarchy.add_signal(self._scope[-1], name, type, stream)
        self._members(node, type, None if type.single_stream else 0, iter(range(len(leaves or ()))), leaves)
        return node

    def _members(self, node: int, type: Type, offset: int | None, slots: Iterable[int], leaves: list[int | None] | None, inside: int = 0) -> None:
        """Packed composites get slices of the stream above, others streams of their own."""
        for i, (name, child) in enumerate(type.children()):
            if getattr(type, "packed", False) and child.single_stream:
                at = type.members[i].bit_offset if isinstance(type, Struct) else (type.element_count - 1 - i) * child.width if isinstance(type, Array) else 0
                member = self.hierarchy.add_member(node, name, child, None, (inside + at, child.width))
                self._members(member, child, None, slots, leaves, inside + at)
                continue
            stream = None
            if child.single_stream:
                slot = next(slots, None)
                stream = leaves[slot] if slot is not None and leaves[slot] is not None else self._stream(child)
                if slot is not None:
                    leaves[slot] = stream
            member = self.hierarchy.add_member(node, name, child, stream)
            self._members(member, child, 0, slots, leaves)

    def header_done(self) -> None:
        pass

    def set_time(self, t: int) -> None:
        self._time = t

    def value_change(self, stream: int, value: str | float) -> None:
        """Text of 0, 1, x and z for logic streams, a number for real ones, text for strings; unknown streams are ignored."""
        if stream not in self.streams:
            return
        kind, width = self.streams[stream]
        if (kind == "real") != isinstance(value, (int, float)):
            raise WaveError(f"stream {stream} holds {kind}, not {value!r}")
        bits = None
        if kind == "logic":
            bits = value[-width:] if len(value) >= width else value.rjust(width, "x")
        self._rows.append((stream, self._time, self._seq, bits, float(value) if kind == "real" else None, value if kind == "string" else None))
        self._seq += 1
        if len(self._rows) >= BATCH:
            self.relieve()

    def relieve(self) -> None:
        """Write the changes that are held here, which are never more than BATCH, to a scratch table."""
        import pyarrow as pa

        if not self._rows:
            return
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*self._rows, strict=True), kinds, strict=True)]
        held = pa.table(columns, names=["stream_id", "t", "seq", "bits", "real", "str"])
        self._folder = self._folder or scratch_dir(self.spark, "changes")
        self.spark.createDataFrame(held).coalesce(1).write.mode("append").option("compression", "zstd").parquet(self._folder)
        self._rows = []

    def finish(self) -> None:
        """What a builder was given is in a table from here on."""
        self.relieve()

    def changes(self) -> DataFrame:
        if self._folder is None:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(self._folder)

    def take_database(self) -> Database:
        return Database(self.hierarchy, self.changes(), self.streams, self.scale)


class ValidatingBuilder:
    """Passes calls on to a builder, and refuses those that break the protocol."""

    def __init__(self, inner: Builder):
        self.inner, self._state, self._depth = inner, "header", 0
        self._time: int | None = None
        self._known: dict[int, tuple[str, int]] = {}
        self._taken = False

    def _need(self, state: str, call: str) -> None:
        if self._state != state:
            raise WaveError(f"{call} in phase {self._state}; it belongs to phase {state}")

    def set_time_scale(self, scale: TimeScale) -> None:
        self._need("header", "set_time_scale")
        self.inner.set_time_scale(scale)

    def begin_scope(self, name: str, kind: str = "module") -> int:
        self._need("header", "begin_scope")
        self._depth += 1
        return self.inner.begin_scope(name, kind)

    def end_scope(self) -> None:
        self._need("header", "end_scope")
        if not self._depth:
            raise WaveError("end_scope without begin_scope")
        self._depth -= 1
        self.inner.end_scope()

    def declare(self, name: str, type: Type, alias: int | None = None, leaves: list[int | None] | None = None) -> int:
        self._need("header", "declare")
        for stream in (alias, *(leaves or ())):
            if stream is not None and stream not in self.inner.streams:
                raise WaveError(f"{name} shares stream {stream}, which is not declared")
        node = self.inner.declare(name, type, alias, leaves)
        for stream, what in self.inner.streams.items():
            self._known.setdefault(stream, what)
        return node

    def header_done(self) -> None:
        self._need("header", "header_done")
        if self._depth:
            raise WaveError(f"{self._depth} scopes are open")
        self._state = "values"
        self.inner.header_done()

    def set_time(self, t: int) -> None:
        self._need("values", "set_time")
        if self._time is not None and t < self._time:
            raise WaveError(f"time {t} after {self._time}")
        self._time = t
        self.inner.set_time(t)

    def value_change(self, stream: int, value: str | float) -> None:
        self._need("values", "value_change")
        if self._time is None:
            raise WaveError("value_change before set_time")
        if stream not in self._known:
            raise WaveError(f"stream {stream} is not declared")
        kind, width = self._known[stream]
        given = "real" if isinstance(value, (int, float)) else "logic" if kind == "logic" and not set(value) - set("01xz") else "string"
        if given != kind:
            raise WaveError(f"stream {stream} holds {kind}, not {value!r}")
        if kind == "logic" and len(value) != width:
            raise WaveError(f"stream {stream} has {width} bits, not {len(value)}")
        self.inner.value_change(stream, value)

    def finish(self) -> None:
        self._need("values", "finish")
        self._state = "finished"
        self.inner.finish()

    def take_database(self) -> Database:
        self._need("finished", "take_database")
        if self._taken:
            raise WaveError("the database was taken")
        self._taken = True
        return self.inner.take_database()


def ingest(reader, sink) -> Database:
    """Read a source (read(sink)) to its end."""
    reader.read(sink)
    sink.finish()
    return sink.take_database()


def ingest_header(reader, sink) -> Database:
    """Read a source's header alone: paths, but no values."""
    getattr(reader, "read_header", reader.read)(sink)
    sink.finish()
    return sink.take_database()
