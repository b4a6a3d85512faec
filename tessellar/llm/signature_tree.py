"""Signature trees: exact set-similarity joins by dual traversal.

A leaf is one set with a bitmap of its tokens. An inner node holds the OR of its children's bitmaps,
the range of their sizes, and the most tokens that share a bit with another in one set. Two nodes
can hold a similar pair only if their size ranges allow it and the greatest overlap still possible
(set bits in common, and the shared bits' surplus) reaches what the smaller sizes need.

`possible` traverses a tree of bitmaps alone and says which sets may have a similar one at all;
`linked` then holds the whole sets. For connected components a pair within one known component adds
nothing: such pairs, and pairs of nodes that lie in one component as a whole, are passed over. That
keeps thousands of near copies near linear.
"""

from __future__ import annotations

import numpy as np

from tessellar.llm.shingles import jaccard_at_least

FANOUT = 8


class Node:
    __slots__ = ("bits", "low", "high", "surplus", "children", "item", "one", "root")

    def __init__(self, children: list[Node], item: int = -1):
        self.children, self.item, self.one = children, item, item >= 0
        #: The known component in which all of it lies.
        self.root = children[0].root if children and all(c.root == children[0].root for c in children) else None
        if children:
            self.bits = 0
            for c in children:
                self.bits |= c.bits
            self.low, self.high = min(c.low for c in children), max(c.high for c in children)
            self.surplus = max(c.surplus for c in children)

    def first(self) -> int:
        node = self
        while node.children:
            node = node.children[0]
        return node.item


def bitmap(own: np.ndarray, n_bits: int) -> bytes:
    """Bit i: some token is i modulo n_bits, a power of two from 8 on."""
    flags = np.zeros(n_bits, np.uint8)
    flags[(own & np.uint64(n_bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def wide_enough(size: int) -> int:
    """Bits of a bitmap that tells sets of this size apart."""
    return max(64, 1 << (2 * size - 1).bit_length())


def folded(bits: bytes, n_bytes: int) -> int:
    """The bitmap as an integer, at a smaller power of two of bytes."""
    out = 0
    for at in range(0, len(bits), n_bytes):
        out |= int.from_bytes(bits[at : at + n_bytes], "little")
    return out


def leaf(item: int, bits: int, size: int) -> Node:
    node = Node([], item)
    node.bits = bits
    node.low = node.high = size
    node.surplus = size - bits.bit_count()
    return node


def grown(level: list[Node]) -> Node | None:
    while len(level) > 1:
        level = [Node(level[k : k + FANOUT]) for k in range(0, len(level), FANOUT)]
    return level[0] if level else None


def tree(items: list[int], sets: list[np.ndarray], n_bits: int) -> Node | None:
    """Similar sets side by side: ordered by their smallest hashes, which they mostly share."""
    order = sorted(items, key=lambda i: (sets[i][0], len(sets[i])))
    return grown([leaf(i, int.from_bytes(bitmap(sets[i], n_bits), "little"), len(sets[i])) for i in order])


def may_match(a: Node, b: Node, p: int) -> bool:
    if 100 * a.high < p * b.low or 100 * b.high < p * a.low:
        return False
    # 100 * both >= p * union >= p * the larger, and (100 + p) * both >= p * (x + y)
    need = max(-(-p * max(a.low, b.low) // 100), -(-p * (a.low + b.low) // (100 + p)))
    return min(a.high, b.high, (a.bits & b.bits).bit_count() + min(a.surplus, b.surplus)) >= need


def possible(bits: list[bytes], sizes: list[int], percent: int, known: list | None = None) -> list[int]:
    """Items whose bitmaps leave a similar partner among the others possible; among those of another component, where components are known."""
    width = min(map(len, bits))
    leaves = [leaf(i, folded(b, width), n) for i, (b, n) in enumerate(zip(bits, sizes, strict=True))]
    leaves.sort(key=lambda x: (x.bits & -x.bits, x.low))
    for node in leaves:
        node.one = False
    for node in leaves if known else ():
        node.root = known[node.item]
    root = grown(leaves)
    found: list[int] = []

    def marked(node: Node) -> bool:
        if not node.one and node.children:
            node.one = all(map(marked, node.children))
        return node.one

    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if marked(a) and marked(b) or a.root is not None and a.root == b.root:
            continue
        if a is b:
            kids = a.children
            stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(len(kids) - 1, i, -1)]
            stack += [(c, c) for c in kids if c.children]
        elif may_match(a, b, percent):
            if not a.children and not b.children:
                found += [x.item for x in (a, b) if not x.one]
                a.one = b.one = True
            elif a.children and (not b.children or a.high >= b.high):
                stack += [(c, b) for c in a.children]
            else:
                stack += [(a, c) for c in b.children]
    return found


class Join:
    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.parent = list(range(len(sets)))
        longest = max(map(len, sets), default=1)
        #: Sparse enough that a node of FANOUT sets still tells tokens apart.
        self.n_bits = min(1 << 16, max(256, 1 << (16 * longest).bit_length()))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def whole(self, node: Node) -> bool:
        """Whether all of a node lies in one component already; once true, it stays."""
        if not node.one:
            roots = set()
            for c in node.children:
                if not self.whole(c):
                    return False
                roots.add(self.find(c.first()))
            node.one = len(roots) == 1
        return node.one

    def traverse(self, left: Node | None, right: Node | None) -> None:
        """Joins two trees, or one with itself where both are the same."""
        if left is None or right is None:
            return
        stack = [(left, right)]
        while stack:
            a, b = stack.pop()
            if a is b:
                if not self.whole(a):
                    kids = a.children
                    stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(len(kids) - 1, i, -1)]
                    stack += [(c, c) for c in kids]
                continue
            if self.whole(a) and self.whole(b) and self.find(a.first()) == self.find(b.first()):
                continue
            if not may_match(a, b, self.percent):
                continue
            if not a.children and not b.children:
                if jaccard_at_least(self.sets[a.item], self.sets[b.item], self.percent):
                    x, y = self.find(a.item), self.find(b.item)
                    self.parent[max(x, y)] = min(x, y)
            elif a.children and (not b.children or a.high >= b.high):
                stack += [(c, b) for c in a.children]
            else:
                stack += [(a, c) for c in b.children]


def linked(sets: list[np.ndarray], percent: int, side: list[bool] | None = None) -> list[tuple[int, int]]:
    """(item, root) of a spanning forest of all similar pairs; with sides, of all pairs across them."""
    join = Join(sets, percent)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if side is None:
        root = tree(filled, sets, join.n_bits)
        join.traverse(root, root)
    else:
        join.traverse(*(tree([i for i in filled if side[i] == s], sets, join.n_bits) for s in (False, True)))
    return [(i, r) for i in filled if (r := join.find(i)) != i]
