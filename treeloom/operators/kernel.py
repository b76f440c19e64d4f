"""Operations on one tree, on plain arrays and without Spark. Rows keep their order; a node is its row number.

Trees are small (thousands of nodes) but deep (hundreds of levels), so everything here is iterative.
"""

from __future__ import annotations

import numpy as np


class TreeError(ValueError):
    """A tree that can't be processed; the message is one of the reject reasons."""


class Tree:
    """ids, parents and coordinates in row order, with children by row number, in row order."""

    def __init__(self, ids, parents, xyz, types=None) -> None:
        self.ids, self.parents = np.asarray(ids, np.int64), np.asarray(parents, np.int64)
        self.xyz = np.asarray(xyz, np.float64).reshape(len(self.ids), 3)
        self.types = np.zeros(len(self.ids), np.int64) if types is None else np.asarray(types, np.int64)
        if not len(self.ids):
            raise TreeError("empty")
        at = {n: k for k, n in enumerate(self.ids.tolist())}
        if len(at) < len(self.ids):
            raise TreeError("duplicate_id")
        self.up = np.array([-1 if p == -1 else at.get(p, -2) for p in self.parents.tolist()], np.int64)
        self.roots = np.flatnonzero(self.up == -1)
        self.children: list[list[int]] = [[] for _ in at]
        for k, p in enumerate(self.up.tolist()):
            if p >= 0:
                self.children[p].append(k)

    def take(self, rows) -> Tree:
        return Tree(self.ids[rows], self.parents[rows], self.xyz[rows], self.types[rows])

    def preorder(self, start: int) -> list[int]:
        """start and its descendants, parents first, children in row order."""
        out, stack = [], [start]
        while stack:
            k = stack.pop()
            out.append(k)
            if len(out) > len(self.ids):
                raise TreeError("cycle")
            stack.extend(reversed(self.children[k]))
        return out

    def checked(self) -> Tree:
        """The tree, if all rows hang on one root."""
        if not len(self.roots):
            raise TreeError("no_root")
        if (self.up == -2).any():
            raise TreeError("dangling_parent")
        if len(self.roots) == 1 and len(self.preorder(int(self.roots[0]))) < len(self.ids):
            raise TreeError("cycle")
        return self

    def edges(self) -> np.ndarray:
        """Length of each row's edge to its parent; 0 without one."""
        d = np.where((self.up >= 0)[:, None], self.xyz - self.xyz[np.maximum(self.up, 0)], 0.0)
        return np.sqrt((d * d).sum(axis=1))

    def below(self, edges: np.ndarray, order: list[int]) -> np.ndarray:
        """Summed length of the edges under each node, its own left out; children added in their order."""
        total = np.zeros(len(self.ids))
        for k in reversed(order):
            s = 0.0
            for c in self.children[k]:
                s += total[c] + edges[c]
            total[k] = s
        return total


def first_root(tree: Tree) -> Tree:
    """The rows under the first root in table order; a tree of one root stays as it is."""
    if not len(tree.roots):
        raise TreeError("no_root")
    if len(tree.roots) == 1:
        return tree
    return tree.take(np.sort(tree.preorder(int(tree.roots[0]))))


def renumber(tree: Tree) -> tuple[Tree, np.ndarray]:
    """Ids from 1 in depth-first order, rows in that order; and the old row of each new one."""
    tree.checked()
    if len(tree.roots) > 1:
        raise TreeError("no_root")
    order = np.array(tree.preorder(int(tree.roots[0])))
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(1, len(order) + 1)
    parents = np.where(tree.up[order] >= 0, new[np.maximum(tree.up[order], 0)], -1)
    return Tree(np.arange(1, len(order) + 1), parents, tree.xyz[order], tree.types[order]), order


def bifurcate(tree: Tree) -> tuple[Tree, np.ndarray]:
    """A tree whose nodes but the root have at most two children; and the input row that each row copies.

    A node with k children gets k - 1 copies above it; the i-th shortest branch (its own edge counted) moves to the
    i-th copy, and only the longest stays.
    """
    tree, source = renumber(tree)
    edges = tree.edges()
    weight = tree.below(edges, list(range(len(tree.ids)))) + edges
    parents, copies = tree.parents.copy(), []
    next_id = len(tree.ids)
    for k, kids in enumerate(tree.children):
        if len(kids) <= 2 or tree.up[k] < 0:
            continue
        for c in sorted(kids, key=lambda c: weight[c])[:-1]:
            next_id += 1
            copies.append((next_id, parents[k], k))
            parents[k] = parents[c] = next_id
    if copies:
        of = np.array([x[2] for x in copies])
        tree = Tree(np.r_[tree.ids, [x[0] for x in copies]], np.r_[parents, [x[1] for x in copies]], np.r_[tree.xyz, tree.xyz[of]], np.r_[tree.types, tree.types[of]])
        source = np.r_[source, source[of]]
    tree, order = renumber(tree)
    return tree, source[order]


def segments(tree: Tree) -> list[dict]:
    """Maximal unbranched chains: tail, nodes from the tail upwards, parent (its tail, or -1), children in order.

    Siblings are in the order of the smallest terminal id under them.
    """
    tree.checked()
    order = [k for r in tree.roots for k in tree.preorder(int(r))]
    least = np.empty(len(tree.ids), np.int64)
    for k in reversed(order):
        least[k] = min((least[c] for c in tree.children[k]), default=tree.ids[k])
    tails = [k for k in order if len(tree.children[k]) != 1]
    found = {}
    for tail in tails:
        nodes, k = [tail], int(tree.up[tail])
        while k >= 0 and len(tree.children[k]) == 1:
            nodes.append(k)
            k = int(tree.up[k])
        found[tail] = {"tail": tail, "nodes": nodes, "parent": k if k >= 0 else -1, "children": []}
    for tail in sorted(tails, key=lambda k: least[k]):
        if found[tail]["parent"] >= 0:
            found[found[tail]["parent"]]["children"].append(tail)
    return [found[k] for k in tails]


def prune(tree: Tree, limit: float = 10.0, rounds: int | None = None, keep_unbranched: bool = False) -> np.ndarray:
    """Rows that stay when terminal chains of at most limit are cut, round by round, until none is left.

    A branch whose chains are all terminal keeps its longest one, the first of equals.
    """
    rows = np.arange(len(tree.ids))
    done = 0
    while rounds is None or done < rounds:
        chains = {s["tail"]: s for s in segments(tree)}
        if not any(s["children"] for s in chains.values()):
            if keep_unbranched:
                return rows
            raise TreeError("unbranched")
        edges, dropped = tree.edges(), []
        for s in chains.values():
            short = [c for c in s["children"] if not chains[c]["children"]]
            length = {c: float(edges[chains[c]["nodes"]].sum()) for c in short}
            if short and len(short) == len(s["children"]):
                short.remove(max(short, key=lambda c: length[c]))
            dropped += [k for c in short if length[c] <= limit for k in chains[c]["nodes"]]
        if not dropped:
            break
        stay = np.setdiff1d(np.arange(len(tree.ids)), dropped)
        tree, rows = tree.take(stay), rows[stay]
        keep_unbranched, done = True, done + 1
    return rows


def components(tree: Tree, members: np.ndarray) -> list[list[int]]:
    """Connected parts of a node set, the root left out: rows in preorder, parts by their smallest end id."""
    inside = np.zeros(len(tree.ids), bool)
    inside[members] = True
    inside[tree.roots] = False
    parts = []
    for top in np.flatnonzero(inside & ~((tree.up >= 0) & inside[np.maximum(tree.up, 0)])).tolist():
        part, stack, least = [], [top], None
        while stack:
            k = stack.pop()
            part.append(k)
            kids = [c for c in tree.children[k] if inside[c]]
            if len(kids) > 2:
                raise TreeError("non_binary")
            if not kids:
                least = tree.ids[k] if least is None else min(least, tree.ids[k])
            stack.extend(reversed(kids))
        parts.append((least, part))
    return [part for _, part in sorted(parts, key=lambda x: x[0])]


def traverse(tree: Tree, parts: list[list[int]], ordering: str = "pre", lesser_first: bool = True) -> list[int]:
    """Rows of all parts in pre-, in- or postorder; lesser (shorter) branches and parts first, or last.

    A branch's length leaves out the edge above it; of equals, the first child is the lesser one; an only child too.
    """
    if ordering not in ("pre", "in", "post"):
        raise ValueError("ordering must be pre, in or post")
    edges, out = tree.edges(), []
    for part in parts:
        inside = set(part)
        total, kids = {}, {}
        for k in reversed(part):
            own = [c for c in tree.children[k] if c in inside]
            total[k] = sum(total[c] + edges[c] for c in own)
            kids[k] = sorted(own, key=lambda c: total[c])
        steps, stack = [], [(part[0], False)]
        while stack:
            k, ready = stack.pop()
            if ready:
                steps.append(k)
                continue
            pair = (kids[k] + [None, None])[:2]
            a, b = pair if lesser_first else pair[::-1]
            plan = {"pre": (k, a, b), "in": (a, k, b), "post": (a, b, k)}[ordering]
            stack.extend((c, c == k) for c in reversed(plan) if c is not None)
        out.append((total[part[0]], steps))
    out.sort(key=lambda x: x[0], reverse=not lesser_first)
    return [k for _, steps in out for k in steps]


def topology(tree: Tree) -> np.ndarray:
    """T for ends, B for more than one child, R for other roots, else G."""
    n = np.array([len(c) for c in tree.children])
    return np.where(n == 0, "T", np.where(n > 1, "B", np.where(tree.up == -1, "R", "G")))
