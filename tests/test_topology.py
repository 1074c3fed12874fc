import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.operators import diagrams, kernels, topology
from tests.toys import TOYS, rows

PATCH = "patch_id long, label int, h int, w int, z array<double>"


@pytest.fixture(scope="module")
def toy_nodes(spark):
    return kernels.merge_tree_of_codes(spark.createDataFrame(rows(), PATCH)).cache()


def test_toys_have_their_known_trees(toy_nodes):
    nodes = toy_nodes.collect()
    for i, (name, (_, _, _, expect)) in enumerate(TOYS.items()):
        mine = [n for n in nodes if n.patch_id == i]
        assert sum(n.is_head for n in mine) == expect["leaves"], name
        assert sum(not n.is_head for n in mine) == expect["junctions"], name
        assert Counter(n.strahler for n in mine) == expect["dist"], name
        assert sum(n.parent is None for n in mine) == 1, name


def test_toys_have_their_known_diagrams(toy_nodes):
    found = topology.persistence_pairs(toy_nodes).collect()
    for i, (name, (_, _, _, expect)) in enumerate(TOYS.items()):
        assert sorted(((p.birth, p.death) for p in found if p.patch_id == i), key=str) == sorted(expect["pairs"], key=str), name


def test_bifurcation_ratio(toy_nodes):
    rb = {r.patch_id: r.rb for r in topology.bifurcation(topology.distribution(toy_nodes, "patch_id"), "patch_id").collect()}
    assert rb[2] == 2.0
    assert rb[0] is None


def test_the_confluence_of_the_tributary(toy_nodes):
    assert [n.node for n in toy_nodes.where("patch_id = 3 and not is_head").collect()] == [5 * 4 + 2]


def test_control_joins_more_cells_than_the_flow():
    h, w, codes, _ = TOYS["tributary_contact"]
    grid = np.full((1, h, w), -1, np.int8)
    for (r, c), code in codes.items():
        grid[0, r, c] = code
    to = kernels.targets(grid)
    acc = kernels.accumulation(to, kernels.depth_order(to)).reshape(h, w)
    joins = [cell for cell, _ in topology.filtration_joins(acc, acc >= 1)]
    assert any(cell != 5 * w + 2 for cell in joins)


def test_loops_of_the_masks_of_toys():
    expect = {"cone": 0, "v_valley": 0, "branching_channel": 2, "tributary_contact": 8, "meander_neck": 8}
    for name, (h, w, codes, _) in TOYS.items():
        grid = np.full((1, h, w), -1, np.int8)
        for (r, c), code in codes.items():
            grid[0, r, c] = code
        to = kernels.targets(grid)
        mask = (kernels.accumulation(to, kernels.depth_order(to)) >= 1).reshape(1, h, w)
        padded = np.pad(mask, ((0, 0), (1, 1), (1, 1)))
        e = sum(int((mask & padded[:, 1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]).sum()) for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)))
        assert e - int(mask.sum()) + int(topology.mask_components(mask)[0]) == expect[name], name


def direct_tree(z, tau):
    """Union-find in ascending accumulation, as a second way to the same tree."""
    h, w = z.shape
    recv = {}
    for r in range(h):
        for c in range(w):
            best = (0, None)
            for dr, dc in kernels.STEPS:
                y, x = r + dr, c + dc
                if 0 <= y < h and 0 <= x < w:
                    slope = (z[r, c] - z[y, x]) / (2**0.5 if dr and dc else 1)
                    if slope > best[0]:
                        best = (slope, y * w + x)
            recv[r * w + c] = best[1]
    acc = Counter()
    for cell in recv:
        at = cell
        while at is not None:
            acc[at] += 1
            at = recv[at]
    for cell in recv:
        if recv[cell] is None and acc[cell] == 1:
            acc[cell] = 0
    mask = {c for c in recv if acc[c] >= tau}
    children, top = {}, {}
    for cell in sorted(mask, key=lambda c: (acc[c], c)):
        below = sorted({top[d] for d in mask if recv[d] == cell})
        if not below:
            top[cell] = cell
            children[cell] = []
        elif len(below) == 1 and sum(recv[d] == cell for d in mask) == 1:
            top[cell] = below[0]
        else:
            top[cell] = cell
            children[cell] = below
    return children, acc


def test_contraction_equals_union_find_on_random_grids(spark):
    rng = np.random.default_rng(3)
    grids = [rng.normal(size=(h, w)) for h, w in [(8, 8)] * 12 + [(12, 9)] * 6 + [(1, 5), (3, 1)]]
    rows_ = [(i, 0, *g.shape, g.reshape(-1).tolist()) for i, g in enumerate(grids)]
    for tau in (1, 2, 3):
        nodes = kernels.merge_tree(spark.createDataFrame(rows_, PATCH), tau).collect()
        for i, g in enumerate(grids):
            children, acc = direct_tree(g, tau)
            mine = {n.node: n for n in nodes if n.patch_id == i}
            assert set(mine) == set(children)
            for node, below in children.items():
                assert sorted(c for c, n in mine.items() if n.parent == node) == below
                assert mine[node].birth == acc[node]

            def order(node):
                if not children[node]:
                    return 1
                sub = sorted((order(c) for c in children[node]), reverse=True)
                return sub[0] + (len(sub) > 1 and sub[0] == sub[1])

            assert all(mine[n].strahler == order(n) for n in children)


def test_invariants_of_forests(spark, sf_dir):
    from talweg.sources.tables import patches

    p = patches(spark, sf_dir)
    nodes = kernels.merge_tree(p, 2).cache()
    pairs = topology.persistence_pairs(nodes)
    per = nodes.collect()
    extra = sum(k - 1 for k in Counter((n.patch_id, n.parent) for n in per if n.parent is not None).values())
    assert pairs.where("death is not null").count() == extra
    assert pairs.where("death is null").count() == sum(n.parent is None for n in per)
    assert sum(n.is_head for n in per) == sum(n.strahler == 1 and n.is_head for n in per)
    flow = kernels.flow(p)
    assert flow.where("recv is null and acc > 0").groupBy("patch_id").sum("acc").count() > 0
    assert topology.mask_h1(p, 2).where("donor_h1 != 0").count() == 0


def test_empty_and_odd_patches(spark):
    odd = spark.createDataFrame([(1, 0, 2, 2, [1.0, 1.0, 1.0, 1.0]), (2, 0, 2, 2, None), (None, None, 1, 2, [2.0, 1.0]), (3, 0, 3, 1, [3.0, None, 1.0]), (4, 0, 2, 2, [1.0])], PATCH)
    assert kernels.merge_tree(odd, 1).count() == 1
    assert kernels.flow(odd).count() == 4 + 2 + 3
    none = spark.createDataFrame([], PATCH)
    assert kernels.merge_tree(none, 1).count() == 0
    assert diagrams.cubical(none).count() == 0


def test_abstract_trees_tell_apart_equal_barcodes(spark):
    a = spark.createDataFrame([(0, 1, 4, 4), (0, 2, 2, 3), (0, 3, 1, 0)], "k int, strahler int, a int, b int")
    assert topology.wasserstein1(a, "a", "b", "strahler", "k").first().w1 > 0.1
    same = a.withColumn("b", a["a"])
    assert topology.wasserstein1(same, "a", "b", "strahler", "k").first().w1 == 0


def test_scaling_leaves_the_tree(spark):
    rng = random.Random(1)
    z = [rng.random() for _ in range(64)]
    rows_ = [(0, 0, 8, 8, z), (1, 0, 8, 8, [1000 * x for x in z])]
    nodes = kernels.merge_tree(spark.createDataFrame(rows_, PATCH), 2).collect()
    side = lambda i: sorted((n.node, n.birth, n.strahler) for n in nodes if n.patch_id == i)
    assert side(0) == side(1)


def test_flowline_orders_follow_the_donors(spark):
    point = lambda x: {"x": float(x), "y": 0.0}
    links = [("y", 1, 3), ("y", 2, 3), ("y", 3, 5), ("y", 4, 5), ("y", 5, 6)] + [("p", 1, 2), ("p", 1, 2), ("p", 2, 3)] + [("c", 1, 2), ("c", 2, 1), ("c", 3, 4)]
    lines = spark.createDataFrame([(t, i, [point(a), point(b)]) for i, (t, a, b) in enumerate(links)], "tile string, line_id int, vertices array<struct<x:double,y:double>>")
    edges = topology.flowline_edges(lines)
    found = {(r.tile, r.strahler): r.n for r in topology.flowline_orders(edges).collect()}
    # Two heads make order 2, a third head does not raise it; parallel edges are two donors; a circle has order 1.
    assert found == {("y", 1): 3, ("y", 2): 3, ("p", 1): 1, ("p", 2): 2, ("c", 1): 4}
    rows = {r.tile: r for r in topology.flowline_branching(edges, F.lit(100.0)).collect()}
    assert rows["y"].max_order == 2 and rows["y"].rb == 1.0 and rows["y"].junctions == 2 and rows["c"].rb is None


def test_agreement_of_equal_sides_is_whole(spark):
    stats = spark.createDataFrame([(1, 4, 2.0, 0.5), (2, 3, None, 0.1)], "tile int, junctions long, rb double, density double")
    dist = spark.createDataFrame([(1, 1, 6), (1, 2, 3), (2, 1, 4)], "tile int, strahler int, n long")
    rows = {r.tile: r for r in topology.branching_agreement(stats, stats, dist, dist).collect()}
    assert rows[1].w1 == 0 and rows[1].rb_difference == 0 and rows[1].junctions_a == rows[1].junctions_b == 4 and rows[2].rb_difference is None
