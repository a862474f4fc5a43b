"""The design: scopes, signals and their members, on the driver; and its paths.

A path is split at dots outside brackets. As many leading segments as name child scopes, whole, are descended, but never
the last; the next names a signal (up to a bracket); what remains names members and elements.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import pairwise

import regex

from .errors import WaveError
from .types import Type

#: Kinds of scopes, and what they are called where it is not their name.
KINDS = ("root", "module", "task", "function", "begin", "fork", "generate", "struct", "union", "class", "interface", "package", "program", "other")


@dataclass
class Scope:
    id: int
    name: str
    kind: str
    parent: int | None
    scopes: list[int] = field(default_factory=list)
    signals: list[int] = field(default_factory=list)


@dataclass
class Node:
    id: int
    name: str
    type: Type | None
    scope: int | None
    parent: int | None
    stream: int | None
    slice: tuple[int, int] | None = None
    children: list[int] = field(default_factory=list)


#: A bracket with all that is in it, up to its end or that of the path; or a dot outside of any.
_TOKEN = regex.compile(r"(\[(?:[^\[\]]|(?1))*+(?:\]|$))|\.")


def _segments(path: str) -> list[str]:
    dots = [m.start() for m in _TOKEN.finditer(path) if m[0] == "."]
    return [path[a + 1 : b] for a, b in pairwise([-1, *dots, len(path)])]


def _indices(text: str) -> list[str]:
    """The bracketed parts of a segment, trimmed; what stands between them, or is not closed, counts for nothing."""
    return [f"[{x.strip()}]" for x in re.findall(r"\[([^\]]*)\]", text)]


class Hierarchy:
    def __init__(self) -> None:
        self.scopes = [Scope(0, "", "root", None)]
        self.nodes: list[Node] = []
        self._scope_at: dict[tuple[int, str], int] = {}
        self._signal_at: dict[tuple[int, str], int] = {}
        self._member_at: dict[tuple[int, str], int] = {}

    def add_scope(self, parent: int, name: str, kind: str = "module") -> int:
        if kind not in KINDS:
            raise WaveError(f"no kind of scope {kind!r}")
        scope = Scope(len(self.scopes), name, kind, self.scope(parent).id)
        self.scopes.append(scope)
        self.scopes[parent].scopes.append(scope.id)
        self._scope_at.setdefault((parent, name), scope.id)
        return scope.id

    def _add(self, name: str, type: Type | None, scope: int | None, parent: int | None, stream: int | None, slice: tuple[int, int] | None) -> int:
        node = Node(len(self.nodes), name, type, scope, parent, stream, slice)
        self.nodes.append(node)
        return node.id

    def add_signal(self, scope: int, name: str, type: Type | None, stream: int | None = None) -> int:
        node = self._add(name, type, self.scope(scope).id, None, stream, None)
        self.scopes[scope].signals.append(node)
        self._signal_at.setdefault((scope, name), node)
        return node

    def add_member(self, parent: int, name: str, type: Type | None, stream: int | None = None, slice: tuple[int, int] | None = None) -> int:
        node = self._add(name, type, None, self.node(parent).id, stream, slice)
        self.nodes[parent].children.append(node)
        self._member_at.setdefault((parent, name), node)
        return node

    def add_element(self, parent: int, index: int, type: Type | None, stream: int | None = None, slice: tuple[int, int] | None = None) -> int:
        return self.add_member(parent, f"[{index}]", type, stream, slice)

    def scope(self, id: int) -> Scope:
        if not 0 <= id < len(self.scopes):
            raise WaveError(f"no scope {id}")
        return self.scopes[id]

    def node(self, id: int) -> Node:
        if not 0 <= id < len(self.nodes):
            raise WaveError(f"no signal {id}")
        return self.nodes[id]

    def child_scope(self, scope: int, name: str) -> int | None:
        return self._scope_at.get((scope, name))

    def child_signal(self, scope: int, name: str) -> int | None:
        return self._signal_at.get((scope, name))

    def member(self, node: int, name: str) -> int | None:
        return self._member_at.get((node, name))

    def find(self, path: str, scope: int = 0) -> int | None:
        """The signal or member of a path from a scope."""
        if not path:
            return None
        segments = _segments(path)
        while len(segments) > 1 and (below := self.child_scope(scope, segments[0])) is not None:
            scope, segments = below, segments[1:]
        name, bracket, rest = segments[0].partition("[")
        node = self.child_signal(scope, name)
        return None if node is None else self._descend(node, [bracket + rest, *segments[1:]])

    def find_from(self, node: int, path: str) -> int | None:
        """The member of a path from a node; the node itself if the path is empty."""
        return self._descend(node, _segments(path)) if path else node

    def _descend(self, node: int | None, segments: list[str]) -> int | None:
        for segment in segments:
            name = segment.partition("[")[0]
            for step in ([name] if name else []) + _indices(segment):
                node = self.member(node, step)
                if node is None:
                    return None
        return node

    def find_scope(self, path: str, scope: int = 0) -> int | None:
        for segment in _segments(path) if path else ():
            below = self.child_scope(scope, segment)
            if below is None:
                return None
            scope = below
        return scope

    def scope_path(self, scope: int) -> str:
        names, at = [], self.scope(scope)
        while at.parent is not None:
            names.append(at.name)
            at = self.scopes[at.parent]
        return ".".join(reversed(names))

    def path(self, node: int) -> str:
        tail, at = "", self.node(node)
        while at.parent is not None:
            tail = (at.name if at.name.startswith("[") else f".{at.name}") + tail
            at = self.nodes[at.parent]
        above = self.scope_path(at.scope)
        return (f"{above}." if above else "") + at.name + tail

    def leaves(self, node: int) -> list[int]:
        """Depth first, nodes that have a stream; members below such a node, and nodes without any, are not among them."""
        at = self.node(node)
        if at.stream is not None:
            return [node]
        return [x for child in at.children for x in self.leaves(child)]

    def scope_leaves(self, scope: int = 0) -> list[int]:
        """A scope's own signals first, then its scopes."""
        at = self.scope(scope)
        return [x for s in at.signals for x in self.leaves(s)] + [x for s in at.scopes for x in self.scope_leaves(s)]

    def owner(self, node: int) -> int | None:
        """The nearest ancestor that has a stream."""
        at = self.node(node).parent
        while at is not None and self.nodes[at].stream is None:
            at = self.nodes[at].parent
        return at

    def sizes(self) -> dict[str, int]:
        names = sum(len(x.name.encode()) for x in (*self.scopes, *self.nodes))
        return {"scopes": len(self.scopes), "nodes": len(self.nodes), "name_bytes": names, "index_entries": len(self._scope_at) + len(self._signal_at) + len(self._member_at)}

    def dump(self, scope: int = 0, depth: int = 0) -> list[str]:
        """The tree as indented lines."""
        at, out = self.scope(scope), []
        if at.parent is not None:
            out.append(f"{'  ' * depth}{at.name} ({at.kind})")
            depth += 1

        def show(node: int, depth: int) -> None:
            n = self.nodes[node]
            out.append(f"{'  ' * depth}{n.name} : {n.type or 'void'}")
            for child in n.children:
                show(child, depth + 1)

        for s in at.signals:
            show(s, depth)
        for s in at.scopes:
            out.extend(self.dump(s, depth))
        return out
