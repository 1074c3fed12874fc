import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.operators import diagrams, raster, topology, twosample
from talweg.sources.files import cut
from talweg.sources.tables import cells

PATCH = "patch_id long, label int, h int, w int, z array<double>"
PAIRS = "patch_id long, birth double, death double"


def test_pruning_is_monotone_and_keeps_essentials(spark):
    d = spark.createDataFrame([(0, 0.0, None), (0, 1.0, 2.0), (0, 1.0, 5.0), (0, 1.0, 100.0)], PAIRS)
    sizes = [diagrams.pruned(d, eps).count() for eps in (0, 3, 50, 1e9)]
    assert sizes == [4, 3, 2, 1]
    assert diagrams.pruned(d, 3).where("death is null").count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_betti_numbers_of_sublevel_sets_agree_with_the_euler_curve(seed):
    z = np.random.default_rng(seed).normal(size=(7, 6))
    pairs = diagrams.sublevel_pairs(z)
    for t in np.sort(z.reshape(-1)):
        inside = z <= t
        v = inside.sum()
        e = (inside[:, 1:] & inside[:, :-1]).sum() + (inside[1:] & inside[:-1]).sum()
        f = (inside[1:, 1:] & inside[1:, :-1] & inside[:-1, 1:] & inside[:-1, :-1]).sum()
        betti = [sum(b <= t and (x is None or t < x) for d, b, x in pairs if d == k) for k in (0, 1)]
        assert betti[0] - betti[1] == v - e + f


def test_superlevel_is_the_negative(spark):
    z = [0.0, 1.0, 0.0, 1.0, 5.0, 1.0, 0.0, 1.0, 0.0]
    row = spark.createDataFrame([(0, 0, 3, 3, z)], PATCH)
    up = [(r.dim, r.birth, r.death) for r in diagrams.cubical(row, superlevel=True).collect()]
    assert (0, 5.0, None) in up


def test_bottleneck_against_brute_force():
    rng = np.random.default_rng(0)

    def brute(a, b):
        n, m = len(a), len(b)
        left = [("p", p) for p in a] + [("d", None)] * m
        right = [("p", p) for p in b] + [("d", None)] * n

        def cost(x, y):
            if x[0] == "p" and y[0] == "p":
                return max(abs(x[1] - y[1]))
            return (x[1][1] - x[1][0]) / 2 if x[0] == "p" else (y[1][1] - y[1][0]) / 2 if y[0] == "p" else 0.0

        return min(max((cost(left[i], right[j]) for i, j in enumerate(p)), default=0.0) for p in itertools.permutations(range(n + m)))

    for _ in range(6):
        a, b = (np.sort(rng.random((k, 2)), axis=1) for k in (3, 2))
        assert math.isclose(diagrams.bottleneck(a, b), brute(a, b), abs_tol=1e-12)


def test_sliced_wasserstein_is_a_distance(spark):
    d = spark.createDataFrame([(0, 1.0, 3.0), (0, 2.0, None), (1, 1.0, 4.0), (2, 1.0, 3.0), (2, 2.0, None)], PAIRS)
    p = diagrams.points(d)
    both = p.toDF("i", "a").crossJoin(p.toDF("j", "b"))
    sw = {(r.i, r.j): r.sw for r in diagrams.sliced_wasserstein(both, 20).collect()}
    assert sw[0, 0] == 0 and sw[0, 2] < 1e-12 and sw[0, 1] > 0
    assert math.isclose(sw[0, 1], sw[1, 0], rel_tol=1e-12)


def test_flat_patch_has_euler_curve_one(spark):
    flat = cells(spark.createDataFrame([(0, 0, 3, 3, [2.0] * 9)], PATCH))
    assert {r.chi for r in diagrams.euler_curve(flat, 5).collect()} == {1}


def test_filling_drains_every_cell(spark):
    from talweg.operators import kernels

    z = np.random.default_rng(1).normal(size=(10, 10))
    z[4:6, 4:6] = -9
    row = spark.createDataFrame([(0, 0, 10, 10, z.reshape(-1).tolist())], PATCH)
    flow = kernels.flow(raster.filled(row)).collect()
    assert all(f.recv is not None or f.r in (0, 9) or f.c in (0, 9) for f in flow)
    assert all(a >= b - 1e-12 for a, b in zip([f.z for f in flow], z.reshape(-1), strict=True))


def test_surrogate_keeps_the_spectrum(spark):
    z = np.random.default_rng(2).normal(size=(8, 8))
    out = raster.phase_surrogate(spark.createDataFrame([(5, 0, 8, 8, z.reshape(-1).tolist())], PATCH)).first().z
    assert np.allclose(np.abs(np.fft.rfft2(np.array(out).reshape(8, 8))), np.abs(np.fft.rfft2(z)))


def test_smoothing_keeps_constants_and_noise_is_reproducible(spark):
    row = spark.createDataFrame([(5, 0, 6, 6, [3.0] * 36)], PATCH)
    assert np.allclose(raster.smoothed(row, 1.0).first().z, 3.0)
    a, b = (raster.noisy(row, 0.5, 1.0, seed=4).first().z for _ in range(2))
    assert a == b and not np.allclose(a, 3.0)


def test_block_sums_equal_direct_statistics(spark):
    rng = np.random.default_rng(5)
    x, tile = rng.normal(size=(60, 5)), rng.integers(0, 6, 60)
    v = spark.createDataFrame([(i, int(t), row.tolist()) for i, (t, row) in enumerate(zip(tile, x, strict=True))], "id long, tile long, x array<double>")
    old, twosample.BLOCK = twosample.BLOCK, 16
    try:
        pairs = twosample.block_pairs(twosample.vector_blocks(v, 60))
        sums = twosample.block_sums(pairs, 1.5)
        d = {(r.i, r.j): r.d for r in twosample.pair_distances(pairs).collect()}
    finally:
        twosample.BLOCK = old
    assert len(d) == 60 * 59 // 2
    assert all(math.isclose(v_, np.linalg.norm(x[i] - x[j]), abs_tol=1e-9) for (i, j), v_ in d.items())
    split = [(0, t, "a" if t < 3 else "b") for t in range(6)]
    sizes = v.groupBy("tile").agg(F.count("*").alias("n_items"))
    found = twosample.mmd2(sums, spark.createDataFrame(split, "split int, tile long, side string"), sizes, "split").first().mmd2
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 1.5**2))
    a, b = tile < 3, tile >= 3
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    assert math.isclose(found, off(k[np.ix_(a, a)]) + off(k[np.ix_(b, b)]) - 2 * k[np.ix_(a, b)].mean(), abs_tol=1e-12)


def test_frechet_distance_of_equal_samples_is_zero(spark):
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(r.tolist(),) for r in rng.normal(size=(50, 4))], "x array<double>")
    n, m, c = twosample.moments(v, 4)
    assert n == 50 and abs(twosample.frechet(m, c, m, c)) < 1e-9
    assert math.isclose(twosample.frechet(m, c, m + 1, c), 4.0, abs_tol=1e-9)


def test_bottleneck_of_large_diagrams():
    rng = np.random.default_rng(5)
    a = rng.random((2000, 2))
    a[:, 1] += a[:, 0]
    moved = a + rng.uniform(-0.001, 0.001, a.shape)
    assert diagrams.bottleneck(a, moved[rng.permutation(2000)]) <= 0.001
    assert diagrams.bottleneck(a, a[::-1]) == 0


def test_quantiles_of_distances_equal_direct_ones(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 3))
    v = spark.createDataFrame([(i, i % 4, y.tolist()) for i, y in enumerate(x)], "id long, tile long, x array<double>")
    pairs = twosample.block_pairs(twosample.vector_blocks(v, 150))
    i, j = np.triu_indices(150, 1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
    assert math.isclose(twosample.distance_quantiles(pairs, 0.95)[0], np.quantile(d, 0.95), rel_tol=1e-9)
    by = twosample.distance_quantiles(pairs, 0.5, "tiles")
    same = i % 4 == j % 4
    assert math.isclose(by[1], np.median(d[same]), rel_tol=1e-9) and math.isclose(by[0], np.median(d[~same]), rel_tol=1e-9)


def test_sliced_distances_of_blocks_equal_the_columns(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(20):
        points = [(float(b), float(b + p)) for b, p in rng.random((int(rng.integers(0, 6)), 2))]
        rows.append((k, points + [(0.5, None)] * int(rng.integers(0, 3))))
    df = spark.createDataFrame([(k, [{"birth": b, "death": d} for b, d in p]) for k, p in rows], "id long, points array<struct<birth:double,death:double>>")
    duos = df.toDF("i", "a").join(df.toDF("j", "b"), F.col("i") < F.col("j"))
    expect = {(r.i, r.j): r.sw for r in diagrams.sliced_wasserstein(duos, twosample.DIRECTIONS).collect()}
    items = diagrams.as_items(df.withColumn("tile", F.lit(0).cast("long")))
    found = {(r.i, r.j): r.d for r in twosample.pair_distances(twosample.block_pairs(twosample.vector_blocks(items, 20)), "sliced").collect()}
    assert found.keys() == expect.keys()
    assert all(math.isclose(found[k], expect[k], abs_tol=1e-9) for k in expect)


def test_copies_are_at_no_distance(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((60, 7)) * 100, 3, 0)
    v = spark.createDataFrame([(i, i % 4, y.tolist()) for i, y in enumerate(x)], "id long, tile long, x array<double>")
    pairs = twosample.block_pairs(cut(twosample.vector_blocks(v, 180)))
    d = {(r.i, r.j): r.d for r in twosample.pair_distances(pairs).collect()}
    assert len(d) == 180 * 179 // 2 and all((v_ == 0) == (i // 3 == j // 3) for (i, j), v_ in d.items())
    assert math.isclose(twosample.median_sigma(pairs), np.median([v_ for v_ in d.values() if v_ > 0]), rel_tol=1e-12)


@pytest.mark.parametrize("guess", [(1, 2), (1 << 62, (1 << 62) + 5)])
def test_quantiles_are_found_beside_a_wrong_guess(spark, monkeypatch, guess):
    rng = np.random.default_rng(10)
    x = np.repeat(rng.standard_normal((50, 3)), 2, 0)
    v = spark.createDataFrame([(i, i % 4, y.tolist()) for i, y in enumerate(x)], "id long, tile long, x array<double>")
    pairs = twosample.block_pairs(cut(twosample.vector_blocks(v, 100)))
    monkeypatch.setattr(twosample, "_guess", lambda *_: {0: guess})
    monkeypatch.setattr(twosample, "_FEW", 20)
    d = np.array([r.d for r in twosample.pair_distances(pairs).collect()])
    assert math.isclose(twosample.distance_quantiles(pairs, 0.3)[0], np.quantile(d[d > 0], 0.3), rel_tol=1e-12)
    assert math.isclose(twosample.distance_quantiles(pairs, 0.3, positive=False)[0], np.quantile(d, 0.3), rel_tol=1e-12)


def test_blocks_are_sent_a_bounded_number_of_times(spark):
    v = spark.range(300).select("id", F.lit(0).cast("long").alias("tile"), F.array(F.rand(1)).alias("x"))
    assert twosample.vector_blocks(v, 120_000).select("of").distinct().collect() == [(15,)]


def test_populations_meet_the_first_and_themselves(spark):
    v = spark.range(90).select("id", F.lit(0).cast("long").alias("tile"), F.array(F.rand(1)).alias("x"))
    parts = [twosample.vector_blocks(v, 90, population=k, populations=4) for k in range(4)]
    blocks = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    n = blocks.count() // 4
    met = {(r.block_a // n, r.block_b // n) for r in twosample.block_pairs(blocks, 4).select("block_a", "block_b").collect()}
    assert n > 1 and met == {(0, k) for k in range(4)} | {(k, k) for k in range(4)}
    assert {(r.block_a // n, r.block_b // n) for r in twosample.block_pairs(blocks, 4, first=False).select("block_a", "block_b").collect()} == met - {(0, 0)}


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(11)
    x = np.r_[rng.random(2000) * 50, (rng.integers(0, 10**6, 2000) + 0.5) / 10**6, rng.integers(0, 10**7, 2000) / 10**7, 0.0, 2.5, 1e12 + 0.1]
    for digits in (4, 6):
        expect = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(F.round("v", digits)).collect()]
        assert twosample.rounded(x, digits).tolist() == expect


@pytest.mark.parametrize("ties", [False, True])
def test_joins_of_a_stack_equal_those_of_its_grids(ties):
    rng = np.random.default_rng(8)
    z = rng.integers(0, 4, (5, 9, 7)) if ties else rng.random((5, 9, 7))
    mask = rng.random(z.shape) < 0.8
    place, joined = topology.stack_joins(z, mask)
    for k in range(5):
        own = place // 63 == k
        assert list(zip((place[own] % 63).tolist(), joined[own].tolist(), strict=True)) == brute_joins(z[k], mask[k])


def brute_joins(values, mask):
    h, w = values.shape
    component, out = {}, []
    for cell in sorted(np.flatnonzero(mask.reshape(-1)).tolist(), key=lambda c: (values.reshape(-1)[c], c)):
        r, c = divmod(cell, w)
        met = {component[x] for x in component if max(abs(x // w - r), abs(x % w - c)) == 1}
        for x in component:
            if component[x] in met:
                component[x] = cell
        component[cell] = cell
        if len(met) > 1:
            out.append((cell, len(met)))
    return out


def test_image_mass_equals_the_integral(spark):
    df = spark.createDataFrame([(1, [(0.2, 0.9), (0.1, 0.3), (0.4, None)]), (2, [])], "patch_id long, points array<struct<birth:double,death:double>>")
    lo, hi, span, pixel = 0.1, 0.4, 0.7, 0.1
    got = {(r.patch_id, r.px, r.py): r.value for r in diagrams.image_mass(df, lo, hi, span, pixel).collect()}
    assert len(got) == 2 * 3 * 7 and all(v == 0 for k, v in got.items() if k[0] == 2)
    phi = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    for (patch, px, py), value in got.items():
        expect = 0.0
        for b, d in ((0.2, 0.9), (0.1, 0.3)) if patch == 1 else ():
            x, y, p = lo + px * pixel, py * pixel, d - b
            expect += p * (phi((x + pixel - b) / pixel) - phi((x - b) / pixel)) * (phi((y + pixel - p) / pixel) - phi((y - p) / pixel))
        assert math.isclose(value, expect, abs_tol=1e-12)


def test_sliced_distances_leave_out_points_of_both(monkeypatch):
    rng = np.random.default_rng(5)

    def some(n, most, whole):
        sizes = rng.integers(0, most, n)
        births = rng.integers(2, 6, sizes.sum()) if whole else rng.random(sizes.sum())
        deaths = births + (rng.integers(0, 9, sizes.sum()) if whole else rng.random(sizes.sum()))
        return np.c_[births, np.where(rng.random(len(births)) < 0.6, np.nan, deaths)].astype(float).reshape(-1), sizes * 2

    def plain(p, q):
        ends = [v[~np.isnan(v[:, 1]), 1].max(initial=-np.inf) for v in (p, q)]
        cap = 1.5 * max(ends) if np.isfinite(max(ends)) else 1.0
        p, q = (np.c_[v[:, 0], np.where(np.isnan(v[:, 1]), cap, v[:, 1])] for v in (p, q))
        total = 0.0
        for t in -np.pi / 2 + np.arange(50) * np.pi / 50:
            line, flat = (lambda v: v @ [np.cos(t), np.sin(t)]), (lambda v: v.sum(1) / 2 * (np.cos(t) + np.sin(t)))  # noqa: B023
            total += np.abs(np.sort(np.r_[line(p), flat(q)]) - np.sort(np.r_[line(q), flat(p)])).sum()
        return total / 50

    sorted_, transported = [], twosample._transported
    monkeypatch.setattr(twosample, "_transported", lambda *a: sorted_.append(a[0].size) or transported(*a))
    for most, whole, at_once in ((14, True, 1 << 19), (14, True, 100), (14, False, 1 << 19), (60, False, 1 << 19), (60, True, 1 << 19)):
        monkeypatch.setattr(twosample, "_POINTS_AT_ONCE", at_once)
        a, b = some(12, most, whole), some(9, most, whole)
        sorted_.clear()
        found = twosample._sliced(a, b)
        single = lambda d: np.split(d[0].reshape(-1, 2), np.cumsum(d[1] // 2)[:-1])
        assert np.allclose(found, [[plain(p, q) for q in single(b)] for p in single(a)], rtol=1e-12, atol=1e-12)
        points = (a[1].sum() // 2) * 9 + (b[1].sum() // 2) * 12
        # Large diagrams are compared one by one.
        assert sum(sorted_) == 0 if most == 60 else sum(sorted_) < 0.75 * points if whole else sum(sorted_) == points
        assert not np.diag(twosample._sliced(a, a)).any()
