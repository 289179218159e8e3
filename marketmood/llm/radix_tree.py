"""An adaptive radix tree over byte keys made of fixed-width units.

Inner nodes take the smallest of four layouts that holds their children and move to the
next when it is full. Runs of bytes without a branch are kept in one node (path
compression). A key may be a prefix of another: its members end at an inner node.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix


class _Sorted:
    """Child bytes and children side by side, in order: the layouts of up to 4 and 16."""

    __slots__ = ("children", "labels", "room")

    def __init__(self, room: int = 4):
        self.room, self.labels, self.children = room, bytearray(), []

    def get(self, label: int) -> Node | None:
        at = self.labels.find(label)
        return self.children[at] if at >= 0 else None

    def put(self, label: int, child: Node) -> _Sorted | _Indexed:
        at = bisect_left(self.labels, label)
        if at < len(self.labels) and self.labels[at] == label:
            self.children[at] = child
            return self
        if len(self.labels) == self.room:
            larger = _Sorted(16) if self.room == 4 else _Indexed()
            for own, held in zip(self.labels, self.children):
                larger.put(own, held)
            return larger.put(label, child)
        self.labels.insert(at, label)
        self.children.insert(at, child)
        return self

    def __iter__(self) -> Iterator[Node]:
        return iter(self.children)


class _Indexed:
    """A place per byte value and up to 48 children."""

    __slots__ = ("children", "places")

    room = 48

    def __init__(self) -> None:
        self.places, self.children = bytearray(256), []

    def get(self, label: int) -> Node | None:
        place = self.places[label]
        return self.children[place - 1] if place else None

    def put(self, label: int, child: Node) -> _Indexed | _Direct:
        place = self.places[label]
        if place:
            self.children[place - 1] = child
        elif len(self.children) < self.room:
            self.children.append(child)
            self.places[label] = len(self.children)
        else:
            larger = _Direct()
            for own, held in enumerate(self.places):
                if held:
                    larger.put(own, self.children[held - 1])
            return larger.put(label, child)
        return self

    def __iter__(self) -> Iterator[Node]:
        return (self.children[place - 1] for place in self.places if place)


class _Direct:
    """A child per byte value."""

    __slots__ = ("children",)

    room = 256

    def __init__(self) -> None:
        self.children: list[Node | None] = [None] * 256

    def get(self, label: int) -> Node | None:
        return self.children[label]

    def put(self, label: int, child: Node) -> _Direct:
        self.children[label] = child
        return self

    def __iter__(self) -> Iterator[Node]:
        return (child for child in self.children if child is not None)


class Node:
    """A node at byte depth ``depth``; ``first`` is some key below it, with what came with that key."""

    __slots__ = ("below", "depth", "ends", "first", "path")

    def __init__(self, path: bytes, depth: int, first: tuple):
        self.path, self.depth, self.first = path, depth, first
        self.ends: list = []
        self.below: _Sorted | _Indexed | _Direct | None = None

    def put(self, label: int, child: Node) -> None:
        self.below = (self.below or _Sorted()).put(label, child)

    def children(self) -> Iterator[Node]:
        return iter(self.below or ())

    @property
    def room(self) -> int:
        """Children the present layout can hold."""
        return self.below.room if isinstance(self.below, _Sorted) else 0 if self.below is None else type(self.below).room


class RadixTree:
    """Members by key. ``path`` of a node starts with the byte that leads to it."""

    def __init__(self) -> None:
        self.root = Node(b"", 0, (b"", None))

    def add(self, key: bytes, member, extra=None) -> None:
        """Let ``member`` end at ``key``; ``extra`` belongs to the key."""
        node, at = self.root, 0
        if node.first[1] is None:
            node.first = (key, extra)
        while at < len(key):
            child = node.below.get(key[at]) if node.below else None
            if child is None:
                child = Node(key[at:], len(key), (key, extra))
                node.put(key[at], child)
                node = child
                break
            if not key.startswith(child.path, at):
                shared = len(commonprefix((child.path, key[at : at + len(child.path)])))
                upper = Node(child.path[:shared], child.depth - len(child.path) + shared, child.first)
                child.path = child.path[shared:]
                upper.put(child.path[0], child)
                node.put(key[at], upper)
                child = upper
            node, at = child, at + len(child.path)
        node.ends.append(member)

    def nodes(self) -> list[Node]:
        """All nodes, parents before their children; children in key order."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(reversed(list(node.children())))
        return order
