"""Changes that lie in blocks of some other device: a data source with a partition for each block.

A device is a class that a worker can import. It lists its blocks, each with its stream, the times it spans, where it lies
and whatever the device needs to read it (a cookie), and decodes one block at a time. Filters on stream_id and t that
reach the source leave out whole blocks before any is read; Spark filters the rows of those that are read.

    spark.dataSource.register(BlockDataSource)
    spark.read.format("blocks").option("device", "package.module:Class").option("path", ...).load()
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import StoreError


@dataclass(frozen=True)
class Block:
    """Changes of one stream, from t_begin to t_end inclusive, that lie at an offset of the device."""

    stream: int
    t_begin: int
    t_end: int
    offset: int = 0
    cookie: Any = None


class Device(Protocol):
    """Made with the options of the reader."""

    def blocks(self) -> list[Block]: ...

    def decode(self, block: Block) -> Iterator[tuple]:
        """Rows (t, seq, bits, real, str) in order."""
        ...


def opened(options: dict[str, str]) -> Device:
    try:
        module, name = options["device"].split(":")
        return getattr(importlib.import_module(module), name)(dict(options))
    except (KeyError, ValueError, ImportError, AttributeError) as e:
        raise StoreError(f"the option device must name a class as package.module:Class, not {options.get('device')!r}") from e


class BlockDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        from ..database import CHANGES

        return CHANGES

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(dict(self.options))


@dataclass
class BlockPartition(InputPartition):
    block: Block


#: Whether a block may have rows that pass a filter on stream_id, or on t.
_MAY = {
    ("stream_id", EqualTo): lambda b, v: b.stream == v,
    ("stream_id", In): lambda b, v: b.stream in v,
    ("t", EqualTo): lambda b, v: b.t_begin <= v <= b.t_end,
    ("t", GreaterThan): lambda b, v: b.t_end > v,
    ("t", GreaterThanOrEqual): lambda b, v: b.t_end >= v,
    ("t", LessThan): lambda b, v: b.t_begin < v,
    ("t", LessThanOrEqual): lambda b, v: b.t_begin <= v,
}


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """All are left to Spark as well: a block may have rows that do not pass."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if (column, type(f)) in _MAY:
                self.tests.append((column, type(f), f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        may = lambda b: all(_MAY[c, kind](b, v) for c, kind, v in self.tests)
        return [BlockPartition(b) for b in opened(self.options).blocks() if may(b)]

    def read(self, partition: BlockPartition) -> Iterator[tuple]:
        for row in opened(self.options).decode(partition.block):
            yield partition.block.stream, *row
