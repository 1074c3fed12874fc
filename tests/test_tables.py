import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import coords
from talweg.operators import quality, simplicial, spatial
from talweg.sources import files

BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"


def test_betti_numbers_of_small_complexes(spark):
    from talweg.plans.relations import facets

    found = {}
    for r in simplicial.betti(simplicial.closure(facets(spark))).collect():
        found.setdefault(r.complex_id, {})[r.dim] = r.betti
    assert found == {0: {0: 1}, 1: {0: 2}, 2: {0: 1, 1: 0}, 3: {0: 1, 1: 1}, 4: {0: 1, 1: 0, 2: 0}, 5: {0: 1, 1: 1}}


def test_betti_numbers_sum_to_the_euler_characteristic(spark):
    c = simplicial.random_complex(spark, 5, 7, 0.6).cache()
    assert simplicial.missing_faces(c).count() == 0
    chi = {r.complex_id: r.chi for r in simplicial.euler(c).collect()}
    alt = {}
    for r in simplicial.betti(c).collect():
        alt[r.complex_id] = alt.get(r.complex_id, 0) + (-1) ** r.dim * r.betti
    assert alt == chi


def test_open_complexes_are_found(spark):
    c = spark.createDataFrame([(0, [0, 1]), (0, [0])], "complex_id long, verts array<int>")
    assert [r.face for r in simplicial.missing_faces(c).collect()] == [[1]]


def test_erosion_keeps_complexes_closed(spark):
    whole = simplicial.closure(spark.createDataFrame([(i, [0, 1, 2, 3]) for i in range(4)], "complex_id long, verts array<int>"))
    assert simplicial.missing_faces(simplicial.eroded(whole, 0.6, 3)).count() == 0


def test_box_join_equals_brute_force(spark):
    rng = np.random.default_rng(0)

    def side(n, key, box):
        rows = []
        for i in range(n):
            x, y = rng.integers(-20, 40, 2).astype(float)
            w, h = rng.integers(0, 30, 2).astype(float)
            rows.append((i, (float(x), float(y), float(x + w), float(y + h))))
        return rows, spark.createDataFrame(rows, f"{key} long, {box} {BOX}")

    (a, left), (b, right) = side(40, "i", "p"), side(40, "j", "q")
    for strict in (False, True):
        found = [(r.i, r.j) for r in spatial.box_join(left, right, "p", "q", strict, cell=7.0).collect()]
        test = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
        expect = [(i, j) for i, p in a for j, q in b if test(p[0], q[2]) and test(q[0], p[2]) and test(p[1], q[3]) and test(q[1], p[3])]
        assert sorted(found) == sorted(expect)


def test_null_boxes_meet_nothing(spark):
    a = spark.createDataFrame([(0, None)], f"i long, p {BOX}")
    b = spark.createDataFrame([(0, (0.0, 0.0, 1.0, 1.0))], f"j long, q {BOX}")
    assert spatial.box_join(a, b, "p", "q").count() == 0
    assert spatial.box_anti_join(a, b, "p", "q", "i").count() == 1


def test_keys(spark):
    row = spark.createDataFrame([(-85, 33), (-86, 36), (5, -4)], "lon int, lat int")
    out = row.select(coords.key_nw(F.col("lon"), F.col("lat")).alias("nw"), coords.key_sw(F.col("lon"), F.col("lat")).alias("sw")).collect()
    assert out[0].nw == "n34w085" and out[1].sw == "n36w086"
    back = spark.createDataFrame([("n34w085",), ("nonsense",), (None,)], "k string").select(coords.box_of_key_nw(F.col("k")).alias("b")).collect()
    assert tuple(back[0].b) == (-85, 33, -84, 34) and back[1].b is None and back[2].b is None


def test_rings(spark):
    b = spark.createDataFrame([((0.0, 0.0, 4.0, 2.0),)], f"b {BOX}")
    r = b.select(coords.shoelace(coords.ring(F.col("b"))).alias("a"), coords.inside_ring(F.lit(1.0), F.lit(1.0), coords.ring(F.col("b"))).alias("y"), coords.inside_ring(F.lit(5.0), F.lit(1.0), coords.ring(F.col("b"))).alias("n")).first()
    assert r.a == 8.0 and r.y and not r.n


def test_rasters_are_read_and_bad_files_reported(spark, tmp_path):
    grid = np.arange(12, dtype=np.float32).reshape(3, 4)
    grid[1, 1] = -999999
    (tmp_path / "a.tif").write_bytes(files.encode_tiff(grid))
    (tmp_path / "b.tif").write_bytes(b"II*\0broken")
    np.save(tmp_path / "c.npy", grid)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_rasters(spark, str(tmp_path), nodata=-999999.0).collect()}
    assert (rows["a.tif"].h, rows["a.tif"].w) == (3, 4)
    assert rows["a.tif"].z[5] is None and rows["a.tif"].z[11] == 11.0
    assert rows["b.tif"].z is None and rows["b.tif"].error
    assert files.read_rasters(spark, str(tmp_path), "*.npy").first().z[11] == 11.0


def test_manifest_and_flowlines(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"selection": {"created": "x"}, "tiles": [{"key": "n36w086", "bbox": [-86, 36, -85, 37], "province": "P", "quintile": 2}]}')
    t = files.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert t.key == "n36w086" and t.bbox[0] == -86 and t.quintile == 2
    (tmp_path / "f.json").write_text('{"type": "FeatureCollection", "features": [{"geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}, {"geometry": {"type": "MultiLineString", "coordinates": [[[1, 1], [2, 1]], [[5, 5], [6, 6]]]}}]}')
    lines = files.read_flowlines(spark, str(tmp_path / "f.json"), F.lit("t"))
    assert lines.count() == 3
    from talweg.operators import topology

    edges = topology.flowline_edges(lines)
    assert topology.flowline_statistics(edges, F.lit(10.0)).first().roots == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", None)], "province string, v int")
    files.write_by_region(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("province = 'b'").count() == 2
    files.write_provenance(spark, str(tmp_path / "prov"), "s", {"k": "v"})
    files.write_provenance(spark, str(tmp_path / "prov"), "s", {"k": "w"})
    assert spark.read.json(str(tmp_path / "prov")).count() == 2
    assert files.markdown(df.limit(1)) == "| province | v |\n| --- | --- |\n| a | 1 |"


def test_reports_raise_on_failed_errors_only(spark):
    df = spark.range(3)
    bad = quality.check(df, "d", "n", F.count("*") > 5, F.count("*"))
    mild = quality.check(df, "d", "w", F.count("*") > 5, F.lit("x"), "warning")
    quality.require(mild)
    with pytest.raises(ValueError, match="d.n: 3"):
        quality.require(quality.report([bad, mild]))


def test_columns_without_finite_values_become_zero(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", None), ("b", float("inf")), ("b", 1.0)], "g string, v double")
    out = {(r.g, r.v) for r in quality.cleaned_column(df, "v", "g").collect()}
    assert out == {("a", 0.0), ("b", 1.0)}
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert {r.v for r in quality.standardized(flat, "v").collect()} == {0.0}


def test_point_in_ring_as_the_first_query_of_a_session(sf_dir):
    # The ring test was pushed below the join, to the side without the point, in plans made first in a session.
    code = f"""if 1:
        from pyspark.sql import SparkSession
        from talweg.plans import QUERIES

        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        rows = QUERIES["point_in_ring"](spark, {sf_dir!r}).collect()
        spark.stop()
        assert rows and len(rows) == len(set(rows))"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # Without the variables by which a Python started inside a Spark driver finds that driver.
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_point_in_ring_tests_equal_shapes_once(spark, tmp_path, monkeypatch):
    from talweg.functions import coords
    from talweg.operators import spatial
    from talweg.plans import QUERIES

    tests, inside_ring = spark.sparkContext.accumulator(0), coords.inside_ring

    @F.udf("boolean")
    def counted(inside):
        tests.add(1)
        return inside

    monkeypatch.setattr(coords, "inside_ring", lambda *a: counted(inside_ring(*a)))
    # Small enough that a cell is dealt to several tasks, and a shape to several lists.
    monkeypatch.setattr(spatial, "PAIRS_A_TASK", 1 << 12)
    monkeypatch.setattr(spatial, "TOGETHER", 1 << 6)
    spark.range(0, 30_000, 100).toDF("c_custkey").union(spark.range(50, 60).toDF("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 20_000, 100).toDF("s_suppkey").union(spark.range(50, 60).toDF("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = [tuple(r) for r in QUERIES["point_in_ring"](spark, str(tmp_path)).collect()]
    # The boxes of 0, 100 and so on are one, and share no area with those of 50 to 59.
    assert len(rows) == len(set(rows)) == 300 * 200 + 10
    assert {r for r in rows if r[0] % 100 == 0} == {(c, s) for c in range(0, 30_000, 100) for s in range(0, 20_000, 100)}
    assert 0 < tests.value < 1000
