"""Compressed radix tries over whole texts, with the smallest id of each text at its terminal."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """A node whose edge holds all bytes since its parent. ``least`` is set on terminals only."""

    __slots__ = ("edge", "children", "rows", "least")

    def __init__(self, edge: bytes):
        self.edge = edge
        self.children: dict[int, Node] | None = None
        self.rows: list | None = None
        self.least: int | None = None


def common_length(edge: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``edge`` are those of ``text`` from ``at`` on, by halving."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Whole texts inserted one by one; rows of equal texts meet at one terminal.

    An edge is stored once, so texts that share long beginnings share their bytes.
    """

    def __init__(self):
        self.root = Node(b"")
        self.bytes = 0
        self.rows = 0

    def insert(self, text: bytes, row: object, key: int | None) -> Node:
        """The terminal of the text, which now also has this row; null keys leave the minimum."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.bytes += size - at
                node = child
                break
            if text.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            shared = common_length(child.edge, text, at)
            middle = Node(child.edge[:shared])
            child.edge = child.edge[shared:]
            middle.children = {child.edge[0]: child}
            node.children[text[at]] = middle
            node, at = middle, at + shared
        if node.rows is None:
            node.rows = []
        node.rows.append(row)
        self.rows += 1
        if key is not None and (node.least is None or key < node.least):
            node.least = key
        return node

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """All texts with their terminals, in byte order."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node.edge
            if node.rows is not None:
                yield text, node
            for first in sorted(node.children or (), reverse=True):
                stack.append((node.children[first], text))
