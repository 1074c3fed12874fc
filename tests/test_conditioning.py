"""Depressions, paged and CSV sources, and key matching on small cases."""

import itertools
import json
import math

import numpy as np
import pytest

from talweg.operators import kernels, raster, spatial
from talweg.sources import files


def pits(z):
    code = kernels.receivers(z[None])[0]
    inside = np.zeros(z.shape, bool)
    inside[1:-1, 1:-1] = True
    return int(((code < 0) & inside).sum())


def test_flood_equals_the_lowest_way_out():
    rng = np.random.default_rng(0)
    z = rng.random((9, 11))
    out = raster.flooded(z, 0.0)
    level = np.where(np.pad(np.zeros((7, 9), bool), 1, constant_values=True), z, np.inf)
    for _ in range(100):  # relaxation to the least fixed point
        padded = np.pad(level, 1, constant_values=np.inf)
        low = np.min([padded[1 + dr : 10 + dr, 1 + dc : 12 + dc] for dr, dc in kernels.STEPS], axis=0)
        level = np.minimum(level, np.maximum(z, low))
    assert np.allclose(out, level)
    assert pits(raster.flooded(z, 1e-6)) == 0


def test_nodata_lets_water_out():
    z = np.ones((7, 7))
    z[3, 3], z[2, 3] = 0.0, np.nan
    out = raster.flooded(z, 1e-6)
    assert out[3, 3] == 0.0 and np.isnan(out[2, 3])


def test_breaching_cuts_the_cheapest_way():
    z = 10 + 0.01 * np.arange(49.0).reshape(7, 7)  # drains to the first row
    z[3, 3], z[3, 4], z[3, 5], z[3, 6] = 1.0, 3.0, 2.0, 0.0
    out = raster.breached_grid(z, 100, 1e-6)
    assert pits(out) == 0
    assert (out <= z).all() and set(zip(*np.nonzero(out != z), strict=True)) == {(3, 4), (3, 5)}
    assert np.array_equal(raster.breached_grid(z, 1, 1e-6), z)  # out of reach


def test_breaching_takes_away_no_more_than_any_way():
    rng = np.random.default_rng(3)
    for _ in range(20):
        z = rng.random((5, 5)) + 1
        z[2, 2] = 0.5
        cut = z - raster.breached_grid(z, 100, 0.0)
        best = math.inf
        for n in (1, 2):  # the edge is at most two steps away
            for way in itertools.product(kernels.STEPS, repeat=n):
                r, c = 2 + sum(s[0] for s in way), 2 + sum(s[1] for s in way)
                cells = list(itertools.accumulate(way, lambda a, s: (a[0] + s[0], a[1] + s[1]), initial=(2, 2)))[1:]
                if all(0 <= a < 5 and 0 <= b < 5 for a, b in cells) and (r in (0, 4) or c in (0, 4)):
                    best = min(best, sum(max(0, z[x] - 0.5) for x in set(cells)))
        assert cut.sum() <= best + 1e-9


def test_a_valley_drains_as_one_basin(spark):
    y, x = np.mgrid[:64, :64]
    z = np.abs(x - 32) + (64 - y) * 0.5
    z[10, 32] = -5.0
    rows = spark.createDataFrame([(0, 0, 64, 64, z.reshape(-1).tolist())], "patch_id long, label int, h int, w int, z array<double>")
    flow = kernels.flow(raster.conditioned(rows)).toPandas()
    assert flow.acc.max() > 0.4 * 64 * 64 and (flow.code >= 0).mean() > 0.95
    with pytest.raises(ValueError, match="condition"):
        raster.conditioned(rows, "none")


def test_stream_cells_have_the_order_of_their_segment(spark):
    y, x = np.mgrid[:9, :9]
    z = (np.abs(x - 4) * 2.0 + y).astype(float)
    rows = spark.createDataFrame([(7, 1, 9, 9, z.reshape(-1).tolist())], "patch_id long, label int, h int, w int, z array<double>")
    cells = kernels.stream_cells(rows, 2).collect()
    nodes = {r.node: r.strahler for r in kernels.merge_tree(rows, 2).collect()}
    assert all(nodes[r.segment] == r.strahler for r in cells) and {r.segment for r in cells} == set(nodes)


def test_pages_are_read_to_the_last(spark, tmp_path):
    for key, sizes in {"a": (2, 2, 1), "b": (2, 0), "c": (0,)}.items():
        (tmp_path / key).mkdir()
        for k, n in enumerate(sizes):
            page = {"features": [{"attributes": {"id": 10 * k + i, "name": f"{key}{i}"}} for i in range(n)], "exceededTransferLimit": k < len(sizes) - 1}
            (tmp_path / key / f"{2 * k}.json").write_text(json.dumps(page))
    spark.dataSource.register(files.Paged)
    df = spark.read.format("paged").schema("key string, id long, name string").options(path=str(tmp_path), keys="a,b,c", size="2").load()
    assert sorted((r.key, r.id) for r in df.collect()) == [("a", 0), ("a", 1), ("a", 10), ("a", 11), ("a", 20), ("b", 0), ("b", 1)]
    few = spark.read.format("paged").schema("key string, id long").options(path=str(tmp_path), keys="a", size="2", most="1").load()
    assert few.count() == 2


def test_keys_match_by_prefix(spark):
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k9",)], "want string")
    ids = spark.createDataFrame([("k1-x", 1), ("k1-1", 2), ("k1-13", 3), ("k2", 9), ("k2-13", 1), ("k3b", 5), ("k3a", 4), ("", 0), (None, 0)], "id string, n long")
    found = {r.want: r.id for r in spatial.prefix_match(wanted, ids, "want", "id", "n", ("-13", "-1")).collect()}
    assert found == {"k1": "k1-13", "k2": "k2", "k3": "k3a"}
