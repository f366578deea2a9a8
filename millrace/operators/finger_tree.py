"""A B-tree of partial aggregates with a finger at its right end.

Keys are event times. Every node holds the partial aggregate of all below it, so the aggregate of any
span of time is combined from logarithmically many partials. Inserts begin at the finger (the newest
leaf) and climb only as far as the key is late; after an insert the partials of the ancestors are made
again. ``evict`` cuts off whole subtrees older than a cut-off.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

FANOUT = 16


class _Node:
    __slots__ = ("parent", "keys", "items", "leaf", "partial")

    def __init__(self, leaf: bool, keys: list, items: list) -> None:
        #: Of a leaf, its keys and their aggregates; else the least key of each child and the children.
        self.leaf, self.keys, self.items = leaf, keys, items
        self.parent: _Node | None = None
        self.partial = None


class FingerTree:
    """Ordered map of key to aggregate with ``combine`` (associative; ``unit`` is neutral)."""

    def __init__(self, combine: Callable, unit) -> None:
        self.combine, self.unit = combine, unit
        self.root = self.finger = _Node(True, [], [])
        self.root.partial = unit

    def _remake(self, node: _Node) -> None:
        total = self.unit
        for item in node.items:
            total = self.combine(total, item if node.leaf else item.partial)
        node.partial = total

    def insert(self, key, value) -> None:
        """Adds ``value`` to the aggregate at ``key``."""
        node = self.finger
        while node.parent and (not node.keys or key < node.keys[0]):
            node = node.parent
        while not node.leaf:
            node = node.items[max(0, bisect_right(node.keys, key) - 1)]
        i = bisect_left(node.keys, key)
        if i < len(node.keys) and node.keys[i] == key:
            node.items[i] = self.combine(node.items[i], value)
        else:
            node.keys.insert(i, key)
            node.items.insert(i, value)
        while node:
            up = node.parent
            if len(node.keys) > FANOUT:
                up = self._split(node)
            else:
                self._remake(node)
            if up and node.keys[0] < up.keys[0]:
                up.keys[0] = node.keys[0]
            node = up

    def _split(self, node: _Node) -> _Node:
        half = len(node.keys) // 2
        right = _Node(node.leaf, node.keys[half:], node.items[half:])
        del node.keys[half:], node.items[half:]
        if not right.leaf:
            for child in right.items:
                child.parent = right
        up = node.parent
        if up is None:
            up = self.root = _Node(False, [node.keys[0]], [node])
            node.parent = up
        at = next(i for i, child in enumerate(up.items) if child is node) + 1
        up.keys.insert(at, right.keys[0])
        up.items.insert(at, right)
        right.parent = up
        self._remake(node)
        self._remake(right)
        if self.finger is node:
            self.finger = right
        return up

    def span(self, low, high):
        """The aggregate of all keys from ``low`` to before ``high``."""

        def of(node: _Node, open_left: bool, open_right: bool):
            if not (open_left or open_right):
                return node.partial
            start = (bisect_left(node.keys, low) if node.leaf else max(0, bisect_right(node.keys, low) - 1)) if open_left else 0
            stop = bisect_left(node.keys, high) if open_right else len(node.keys)
            total = self.unit
            for i in range(start, stop):
                item = node.items[i]
                if not node.leaf:
                    item = of(item, open_left and i == start, open_right and i == stop - 1)
                total = self.combine(total, item)
            return total

        return of(self.root, True, True)

    def evict(self, before) -> None:
        """Drops all keys before ``before``; subtrees that are older as a whole go at once."""
        path = [self.root]
        while not path[-1].leaf:
            node = path[-1]
            i = max(0, bisect_right(node.keys, before) - 1)
            del node.keys[:i], node.items[:i]
            path.append(node.items[0])
        leaf = path[-1]
        i = bisect_left(leaf.keys, before)
        del leaf.keys[:i], leaf.items[:i]
        for node in reversed(path):
            up = node.parent
            if not node.keys and up:
                del up.keys[0], up.items[0]
                if node is self.finger:
                    self.finger = None
                continue
            self._remake(node)
            if up and node.keys:
                up.keys[0] = node.keys[0]
        while not self.root.leaf and len(self.root.items) <= 1:
            if not self.root.items:
                self.root = _Node(True, [], [])
                self.root.partial = self.unit
                break
            self.root = self.root.items[0]
            self.root.parent = None
        if self.finger is None or self.root.leaf:
            self.finger = self.root
            while not self.finger.leaf:
                self.finger = self.finger.items[-1]

    def items(self):
        """All (key, aggregate) in order."""

        def walk(node: _Node):
            if node.leaf:
                yield from zip(node.keys, node.items)
            else:
                for child in node.items:
                    yield from walk(child)

        return walk(self.root)
