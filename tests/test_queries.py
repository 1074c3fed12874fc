"""Every query with SQL gives DuckDB's rows, and none of the library needs the llm subpackage."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from talweg.operators import twosample
from talweg.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert mine == theirs


# The pruning rerun is held against brute force below, on a small table.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"pruning_rerun"}))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_each_left_out_tile_gives_its_own_percentile(spark, sf_dir):
    r = QUERIES["jackknife"](spark, sf_dir).first()
    assert r.n > 1 and r.least < r.greatest and r.sd > 0


def test_power_curve_runs_to_half_the_tiles(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label").distinct().count()
    assert sorted(r.k for r in QUERIES["power_curve"](spark, sf_dir).collect()) == list(range(1, n // 2 + 1))


def test_drawn_splits_hold_every_tile():
    drawn = twosample.sized_splits(list(range(21)), 10)
    assert {t for _, t, _ in drawn} == set(range(21)) and len(drawn) == 20 * twosample.MOST_SPLITS


def test_every_box_is_extracted(spark, tmp_path, monkeypatch):
    from talweg.plans import relations

    grid = spark.createDataFrame([(i, [[float(i)] * 8] * 8) for i in (1, 50, 51, 60)], "patch_id long, z array<array<double>>")
    monkeypatch.setattr(relations, "patches", lambda *_: grid)
    monkeypatch.setattr(relations, "cells", lambda df: df.select("patch_id", F.posexplode("z").alias("r", "row")).select("patch_id", "r", F.posexplode("row").alias("c", "z")))
    monkeypatch.setattr(relations, "table", lambda *_: spark.range(1, 70).toDF("s_suppkey"))
    assert {r.box for r in relations.patch_extract(spark, "").collect()} == {1, 50, 51, 60}


@pytest.mark.parametrize("held", [16_384, 0])
def test_pruning_rerun_works_out_distances_once_where_they_fit(spark, tmp_path, monkeypatch, held):
    import numpy as np

    from talweg.plans import samples

    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(64).tolist(), i // 2 % 4) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = samples.pairs_of(spark, str(tmp_path))
    want = samples.sliced_test(spark, str(tmp_path), 0.0, whole).first()
    passes, blockwise = [], twosample._blockwise
    monkeypatch.setattr(twosample, "_blockwise", lambda pairs, metric, *a: passes.append(metric) or blockwise(pairs, metric, *a))
    monkeypatch.setattr(samples, "HELD_ITEMS", held)
    found = samples.sliced_test(spark, str(tmp_path), 0.0, whole).first()
    assert passes.count("sliced") == 1 if held else passes.count("sliced") > 1
    assert all(math.isclose(found[c], want[c], rel_tol=1e-9) for c in ("floor", "median", "p"))


def test_pruning_rerun_equals_brute_force(spark, tmp_path):
    from itertools import combinations

    import numpy as np

    from talweg.operators import diagrams
    from talweg.plans.shapes import pairs_of

    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(64).tolist(), i // 2 % 4) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sf = str(tmp_path)
    found = {round(r.share, 2): r for r in QUERIES["pruning_rerun"](spark, sf).collect()}
    pairs = [(r.patch_id, r.birth, r.death) for r in pairs_of(spark, sf).collect()]
    life = [d - b for _, b, d in pairs if d is not None]
    for share in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9):
        eps = float(np.quantile(life, share)) if share else 0.0
        points = {i: [(float(b), None if d is None else float(d)) for p, b, d in pairs if p == i and (d is None or eps <= 0 or d - b >= eps)] for i in range(24)}
        df = spark.createDataFrame([(i, [{"birth": b, "death": d} for b, d in p]) for i, p in points.items()], "id long, points array<struct<birth:double,death:double>>")
        duos = df.toDF("i", "a").join(df.toDF("j", "b"), F.col("i") < F.col("j"))
        d = np.zeros((24, 24))
        for r in diagrams.sliced_wasserstein(duos, 50).collect():
            d[r.i, r.j] = d[r.j, r.i] = r.sw
        above = d[np.triu_indices(24, 1)]
        sigma = np.median(above[above > 0])
        k = np.exp(-(d**2) / (2 * sigma**2))

        def mmd(a, b):
            mean = lambda x, y, same: (k[np.ix_(x, y)].sum() - (len(x) if same else 0)) / (len(x) * (len(y) - same))  # noqa: B023, E731
            return mean(a, a, True) + mean(b, b, True) - 2 * mean(a, b, False)

        even, odd = ({t: [i for i in range(24) if i // 2 % 4 == t and i % 2 == e] for t in range(4)} for e in (0, 1))
        size = lambda ids: len(ids) > 1
        of = lambda side, tiles: [i for t in tiles for i in side[t]]
        null, test = [], []
        for a in combinations(range(4), 2):
            b = [t for t in range(4) if t not in a]
            for out, x, y in ((null, of(even, a), of(even, b)), (test, of(odd, a), of(even, b))):
                out.append(mmd(x, y) if size(x) and size(y) else 0.0)
        r = found[share]
        assert math.isclose(r.eps, eps, abs_tol=1e-9)
        assert math.isclose(r.floor, np.quantile(null, 0.95), abs_tol=1e-9) and math.isclose(r["median"], np.median(test), abs_tol=1e-9)
