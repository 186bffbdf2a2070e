"""The logical plan: sources, maps, zips, reductions, slices, point updates and spills.

A node says what to compute and carries no data. Plans are immutable and can be used again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from tidewheel.functions.dtypes import DType


@dataclass(frozen=True, eq=False)
class TableColumn:
    """A column of a table in an order: by keys, or at the positions in idx."""

    df: DataFrame
    keys: list[Column]
    value: Column
    dense: bool
    descending: bool = False

    def beside(self, other: TableColumn) -> bool:
        """Whether both are columns of one table in one order."""
        if (self.dense, self.descending, list(map(str, self.keys))) != (other.dense, other.descending, list(map(str, other.keys))):
            return False
        return self.df is other.df or self.df.sameSemantics(other.df)


@dataclass(frozen=True, eq=False)
class Source:
    label: str
    dtype: DType
    #: Makes (idx, value) when the plan runs; batch-ordered sources keep each batch in one partition, in order.
    make: Callable[[SparkSession, int], DataFrame]
    batch_ordered: bool = False
    #: Of a raw file: its path, first element and element count (-1: all).
    raw: tuple[str, int, int] | None = None
    #: Elements, where that is known before the plan runs.
    length: int | None = None
    #: A column of a table: sources whose tables are the same are read together.
    table: TableColumn | None = None
    #: Files that the source reads besides raw, found when they are asked for.
    reads: Callable[[], list[str]] = list


@dataclass(frozen=True, eq=False)
class Map:
    input: Node
    f: Callable[[Column], Column]
    dtype: DType
    label: str = "map"


@dataclass(frozen=True, eq=False)
class Zip:
    left: Node
    right: Node
    f: Callable[[Column, Column], Column]
    dtype: DType
    label: str = "zip_with"


@dataclass(frozen=True, eq=False)
class Reduce:
    input: Node
    dtype: DType
    label: str = "sum"


@dataclass(frozen=True, eq=False)
class Slice:
    input: Node
    offset: int
    count: int
    dtype: DType

    @property
    def label(self) -> str:
        return f"slice [{self.offset}, {self.offset + self.count})"


@dataclass(frozen=True, eq=False)
class Update:
    """The input with the element at one place replaced."""

    input: Node
    at: int
    value: Column
    dtype: DType

    @property
    def label(self) -> str:
        return f"set_at {self.at} ({self.dtype.name})"


@dataclass(frozen=True, eq=False)
class Spill:
    """The input, computed once and kept; held is empty until then."""

    input: Node
    dtype: DType
    held: list[DataFrame]

    @property
    def label(self) -> str:
        return f"spilled ({self.dtype.name})"


Node = Source | Map | Zip | Reduce | Slice | Update | Spill


def children(node: Node) -> list[Node]:
    if isinstance(node, Zip):
        return [node.left, node.right]
    return [] if isinstance(node, Source) else [node.input]


def rendered(node: Node) -> str:
    """The plan as a tree, root first."""
    lines = [node.label]

    def below(parent: Node, indent: str) -> None:
        kids = children(parent)
        for i, kid in enumerate(kids):
            more = i + 1 < len(kids)
            lines.append(f"{indent}{'├─ ' if more else '└─ '}{kid.label}")
            below(kid, indent + ("│  " if more else "   "))

    below(node, "")
    return "\n".join(lines)


def source_paths(node: Node) -> list[str]:
    if isinstance(node, Source):
        return ([node.raw[0]] if node.raw else []) + node.reads()
    return [p for kid in children(node) for p in source_paths(kid)]


def batch_sizes(node: Node, batch_bytes: int) -> list[int]:
    """Elements of a batch of each source under a node: batches end wherever one of theirs does."""
    if isinstance(node, Source):
        return [max(1, batch_bytes // node.dtype.width)]
    if isinstance(node, Reduce):
        return []  # one element, one batch
    return [k for kid in children(node) for k in batch_sizes(kid, batch_bytes)]


def base_of(node: Node) -> Node:
    """What is left of a node without its maps."""
    while isinstance(node, Map):
        node = node.input
    return node


def length_of(node: Node) -> int | None:
    """The node's number of elements, if it is known before the plan runs."""
    if isinstance(node, Source):
        return node.length
    if isinstance(node, Reduce):
        return 1
    if isinstance(node, Slice):
        return node.count
    if isinstance(node, Zip):
        left = length_of(node.left)
        return length_of(node.right) if left is None else left
    return length_of(node.input)
