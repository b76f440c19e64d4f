import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.operators import kernel
from treeloom.operators.kernel import Tree, TreeError


def line(parents, lengths=None, types=None):
    """A tree whose node k (from 1) lies at its path length along x, on an axis of its own."""
    n = len(parents)
    xyz = np.zeros((n, 3))
    for k, p in enumerate(parents):
        if p > 0:
            xyz[k] = xyz[p - 1]
            xyz[k, k % 3] += (lengths[k] if lengths else 1) * (1 if k % 2 else -1)
    return Tree(np.arange(1, n + 1), parents, xyz, types or [2] * n)


trees = st.integers(2, 40).flatmap(lambda n: st.tuples(*[st.integers(1, k) for k in range(1, n)])).map(lambda ps: line([-1, *ps], [0, *[1 + (7 * k) % 11 for k in range(len(ps))]]))


@pytest.mark.parametrize(("ids", "parents", "reason"), [([], [], "empty"), ([1, 1], [-1, 1], "duplicate_id"), ([1, 2], [2, 1], "no_root"), ([1, 2], [-1, 9], "dangling_parent"), ([1, 2, 3], [-1, 3, 2], "cycle")])
def test_rejects(ids, parents, reason):
    with pytest.raises(TreeError, match=reason):
        Tree(ids, parents, np.zeros((len(ids), 3))).checked()


def test_first_root_in_table_order():
    tree = Tree([7, 3, 8, 4], [-1, -1, 7, 3], np.zeros((4, 3)))
    assert kernel.first_root(tree).ids.tolist() == [7, 8]


@settings(max_examples=60, deadline=None)
@given(trees)
def test_renumber_and_bifurcate(tree):
    new, source = kernel.renumber(tree)
    assert (new.parents < new.ids).all() and sorted(source) == list(range(len(tree.ids)))
    split, source = kernel.bifurcate(tree)
    assert all(len(c) <= 2 for k, c in enumerate(split.children) if split.up[k] >= 0)
    assert split.edges().sum() == pytest.approx(tree.edges().sum())
    assert (split.xyz == tree.xyz[source]).all()


def test_bifurcation_puts_the_shorter_branch_nearer_to_the_root():
    tree = line([-1, 1, 2, 2, 2], [0, 1, 5, 3, 4])
    split, source = kernel.bifurcate(tree)
    assert len(split.ids) == 7
    top = split.children[0][0]
    assert source[top] == 1 and 3 in source[split.children[top]]


def test_root_keeps_its_stems():
    assert len(kernel.bifurcate(line([-1, 1, 1, 1]))[0].ids) == 4


@settings(max_examples=60, deadline=None)
@given(trees)
def test_segments_cover_every_node_once(tree):
    found = kernel.segments(tree)
    assert sorted(k for s in found for k in s["nodes"]) == list(range(len(tree.ids)))


def test_prune_goes_in_rounds():
    # branch 2 has a twig of 8 and, at distance 1, branch 4 with twigs of 3 and 2
    tree = line([-1, 1, 2, 2, 4, 4], [0, 20, 8, 1, 3, 2])
    assert (kernel.prune(tree, 10) + 1).tolist() == [1, 2, 4, 5]


def test_prune_limit_is_inclusive_and_ties_keep_the_first():
    assert (kernel.prune(line([-1, 1, 2, 2], [0, 1, 10, 10]), 10) + 1).tolist() == [1, 2, 3]
    with pytest.raises(TreeError, match="unbranched"):
        kernel.prune(line([-1, 1, 2]))
    assert len(kernel.prune(line([-1, 1, 2]), keep_unbranched=True)) == 3


@settings(max_examples=60, deadline=None)
@given(trees, st.floats(1, 15))
def test_prune_is_idempotent(tree, limit):
    rows = kernel.prune(tree, limit, keep_unbranched=True)
    rest = tree.take(rows)
    assert len(kernel.prune(rest, limit, keep_unbranched=True)) == len(rows)


def recursive(tree, k, inside, ordering, lesser_first):
    edges = tree.edges()

    def total(k):
        return sum(total(c) + edges[c] for c in tree.children[k] if c in inside)

    kids = sorted((c for c in tree.children[k] if c in inside), key=total)
    a, b = (kids + [None, None])[:2]
    a, b = (a, b) if lesser_first else (b, a)
    walk = lambda c: [] if c is None else recursive(tree, c, inside, ordering, lesser_first)
    a, b = walk(a), walk(b)
    return {"pre": [k] + a + b, "in": a + [k] + b, "post": a + b + [k]}[ordering]


@settings(max_examples=60, deadline=None)
@given(trees, st.sampled_from(["pre", "in", "post"]), st.booleans())
def test_traversal_against_recursion(tree, ordering, lesser_first):
    tree, _ = kernel.bifurcate(tree)
    parts = kernel.components(tree, np.arange(len(tree.ids)))
    got = kernel.traverse(tree, parts, ordering, lesser_first)
    assert sorted(got) == sorted(k for p in parts for k in p)
    for part in parts:
        own = set(part)
        assert [k for k in got if k in own] == recursive(tree, part[0], own, ordering, lesser_first)


def test_wrong_ordering_and_non_binary():
    with pytest.raises(ValueError, match="ordering"):
        kernel.traverse(line([-1, 1]), [[1]], "level")
    with pytest.raises(TreeError, match="non_binary"):
        kernel.components(line([-1, 1, 2, 2, 2]), np.arange(5))


def test_topology_and_depth():
    assert kernel.topology(line([-1])).tolist() == ["T"]
    assert kernel.topology(line([-1, 1, 2, 2])).tolist() == ["R", "B", "T", "T"]
    deep = line([-1, *range(1, 3000)])
    assert len(kernel.traverse(deep, kernel.components(deep, np.arange(3000)))) == 2999
