import numpy as np
from pyspark.sql import functions as F

from talweg.operators import evaluation, ranking, twosample


def test_running_sums_over_many_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(None if k == 2 else int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True))]
    df = spark.createDataFrame(rows, "key int, v int, i int")
    found = {r.i: (r.s, r.k) for r in ranking.numbered(ranking.running(df, ["v", "i"], {"s": F.col("v")}, ("key",)), ["v", "i"], "k").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    sums: dict = {}
    for place, (k, v, i) in enumerate(order):
        sums[k] = sums.get(k, 0) + v
        assert found[i] == (sums[k], place)


def test_average_ranks(spark):
    df = spark.createDataFrame([(10,), (20,), (20,), (30,), (None,)], "v int")
    assert sorted((r.v or 0, r.r) for r in twosample.average_ranks(df, "v", "r").collect()) == [(0, None), (10, 1.0), (20, 2.5), (20, 2.5), (30, 4.0)]


def test_area_under_the_curve_equals_pair_counts(spark):
    rng = np.random.default_rng(1)
    truth, score = rng.integers(0, 2, 200), rng.integers(0, 30, 200) / 30
    df = spark.createDataFrame([(int(t), float(s)) for t, s in zip(truth, score, strict=True)], "truth int, score double")
    p, n = score[truth == 1], score[truth == 0]
    expect = ((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])).mean()
    assert abs(evaluation.auroc(df).first().auroc - expect) < 1e-12
    assert evaluation.auroc(df.where("truth = 1")).first().auroc is None
