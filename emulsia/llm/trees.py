"""BK-trees over whole arrays of fingerprints, searched by many fingerprints at once.

The children of a node are keyed by their Hamming distance to its point, as in simhash.BKTree; a search goes down with all
questions together and leaves behind, at each child, those that the edge shows to be too far. Nodes of few points are
leaves and are compared directly.

Defined results: equal fingerprints are one point with several members; no fingerprints give an empty tree, which nothing
is near to; nothing is read besides the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 8


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The differing bits of fingerprints in rows of 64-bit words; leading axes are broadcast."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Tree:
    """The points of an array of shape (n, words); `search` yields members within the radius of questions."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.radius = radius
        self.points, of = np.unique(prints, axis=0, return_inverse=True)
        order = np.argsort(of.reshape(-1), kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(of.reshape(-1), minlength=len(self.points)))[:-1]) if len(prints) else []
        self.nodes: list[tuple[np.ndarray, list[tuple[int, int]]]] = []  # points met at the node, (edge, node) of its children
        if not len(self.points):
            return
        self.nodes.append((np.arange(len(self.points)), []))
        stack = [0]
        while stack:
            at = stack.pop()
            held = self.nodes[at][0]
            if len(held) <= LEAF:
                continue
            d = distances(self.points[held[1:]], self.points[held[0]])
            order = np.argsort(d, kind="stable")
            edges, starts = np.unique(d[order], return_index=True)
            children = []
            for edge, part in zip(edges.tolist(), np.split(held[1:][order], starts[1:])):
                children.append((edge, len(self.nodes)))
                stack.append(len(self.nodes))
                self.nodes.append((part, []))
            self.nodes[at] = (held[:1], children)

    def search(self, asks: np.ndarray, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of questions, points) of pairs within the radius; questions that become true in done are asked no further."""
        stack = [(0, np.arange(len(asks)))] if self.nodes and len(asks) else []
        while stack:
            at, who = stack.pop()
            if done is not None:
                who = who[~done[who]]
            if not len(who):
                continue
            held, children = self.nodes[at]
            d = distances(asks[who, None, :], self.points[None, held, :])
            x, y = np.nonzero(d <= self.radius)
            if len(x):
                yield who[x], held[y]
            for edge, child in children:
                near = np.abs(d[:, 0] - edge) <= self.radius
                if near.any():
                    stack.append((child, who[near]))


def befriended(prints: np.ndarray, radius: int) -> np.ndarray:
    """Whether each fingerprint of an array has another one, or an equal one, within the radius."""
    if len(prints) == 2:
        return np.repeat(distances(prints[0], prints[1]) <= radius, 2)
    tree = Tree(prints, radius)
    done = np.fromiter((len(m) > 1 for m in tree.members), dtype=bool, count=len(tree.points))
    for who, point in tree.search(tree.points, done):
        done[who[who != point]] = True
    out = np.empty(len(prints), dtype=bool)
    for member, ok in zip(tree.members, done.tolist()):
        out[member] = ok
    return out
