"""Queries of the second forms of raster, evaluation and check operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import coords
from talweg.operators import evaluation, quality, raster, simplicial
from talweg.plans.prelude import CELLS
from talweg.plans.registry import query
from talweg.plans.relations import _CLOSED, _COUNTS, _CURVE, _LL, _ll, facets, scores
from talweg.plans.terrain import _GRAD
from talweg.sources.tables import cells, patches, table, window_grid


@query(f"with {_LL}, m as (select c_custkey, radians(lon) * 6378137.0 as x, ln(tan(radians(lat) / 2 + 0.7853981633974483::double)) * 6378137.0 as y from ll) select c_custkey, round(degrees(x / 6378137.0), 6) as lon, round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 6) as lat from m")
def mercator_inverse(spark, sf_dir):
    """Degrees of Mercator metres."""
    m = _ll(spark, sf_dir).select("c_custkey", coords.mercator(F.col("lon"), F.col("lat")).alias("m"))
    back = coords.mercator_inverse(F.col("m.x"), F.col("m.y"))
    return m.select("c_custkey", back.alias("b")).select("c_custkey", F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"))


_CUBIC = "(case when abs({t}) <= 1 then 1.5 * abs({t}) * abs({t}) * abs({t}) - 2.5 * {t} * {t} + 1 when abs({t}) < 2 then -0.5 * abs({t}) * abs({t}) * abs({t}) + 2.5 * {t} * {t} - 4 * abs({t}) + 2 else 0 end)"


@query(f"""with {CELLS}, g as (select i::int as cell, ((i // 4 + 0.5) * 8 / 4 - 0.5)::double as y, ((i % 4 + 0.5) * 8 / 4 - 0.5)::double as x from range(0, 16) t(i)),
t as (select cell, y, x, floor(y)::int + a as r, floor(x)::int + b as c from g, range(-1, 3) p(a), range(-1, 3) q(b)),
w as (select cell, least(7, greatest(0, r))::int as r, least(7, greatest(0, c))::int as c, {_CUBIC.format(t='(y - r)')} * {_CUBIC.format(t='(x - c)')} as weight from t)
select k.patch_id, w.cell, round(sum(k.z * w.weight), 6) as z from w join cells k on k.r = w.r and k.c = w.c group by all""")
def resample_cubic(spark, sf_dir):
    """Patches on a 4 x 4 grid by cubic weights of the sixteen cells around."""
    return raster.resampled_cubic(patches(spark, sf_dir), 4, 4).select("patch_id", "cell", F.round("z", 6).alias("z"))


@query(f"""with {CELLS}, e as (select quantile_cont(z, 0.02) as lo, quantile_cont(z, 0.98) as hi from cells) select patch_id, cell, round(greatest(0.0, least(1.0, (z - lo) / (hi - lo))), 6) as norm from cells, e""")
def shared_normalize(spark, sf_dir):
    """Values between bounds that all patches share."""
    c = cells(patches(spark, sf_dir))
    lo, hi = c.agg(F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).alias("e")).first()["e"]
    return c.select("patch_id", "cell", F.round(raster.between(F.col("z"), lo, hi), 6).alias("norm"))


@query(f"""with {_GRAD}, s as (select patch_id, cell, z, sqrt(gx * gx + gy * gy) as slope, pi() / 2 - atan(sqrt(gx * gx + gy * gy)) as sl, atan2(-gx, gy) as asp from g),
v as (select patch_id, cell, 0 as channel, greatest(0, least(1, (sin(radians(45.0::double)) * sin(sl) + cos(radians(45.0::double)) * cos(sl) * cos(radians(135.0::double) - pi() / 2 - asp) + 1) / 2)) as v from s
  union all select patch_id, cell, 1, z from s union all select patch_id, cell, 2, slope from s),
e as (select patch_id, channel, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from v group by all)
select v.patch_id, v.cell, v.channel, least(255, greatest(0, round_even(round(greatest(0.0, least(1.0, (v.v - e.lo) / (case when e.hi <= e.lo then 1 else e.hi - e.lo end))), 6) * 255, 0)))::int as level from v join e on e.patch_id = v.patch_id and e.channel = v.channel""")
def geomorphic_stack(spark, sf_dir):
    """Hillshade, elevation and slope of each cell as three channels from 0 to 255."""
    return raster.geomorphic_stack(cells(patches(spark, sf_dir)))


@query("select vec_id as patch_id, r0::int as r0, c0::int as c0 from embeddings, range(0, 6) a(r0), range(0, 6) b(c0) where sqrt((r0 + 1.5 - 4) * (r0 + 1.5 - 4) + (c0 + 1.5 - 4) * (c0 + 1.5 - 4)) <= 2.6 and r0 >= 1 and c0 >= 1 and r0 + 3 <= 7 and c0 + 3 <= 7")
def windows_within(spark, sf_dir):
    """Windows of three cells that lie inside a boundary: one cell from the edge, and centred within 2.6 of the middle."""
    w = window_grid(patches(spark, sf_dir), 3, 1).select("patch_id", "r0", "c0")
    inside = (F.col("r0") >= 1) & (F.col("c0") >= 1) & (F.col("r0") + 3 <= 7) & (F.col("c0") + 3 <= 7)
    return w.where(inside & (F.hypot(F.col("r0") + 1.5 - 4, F.col("c0") + 1.5 - 4) <= 2.6))


@query(f"""with {_CURVE}, st as (select name, tp / (tp + fp)::double as pr, (tp - coalesce(lag(tp) over (partition by name order by score desc), 0)) / np::double as step from cv), ap as (select name, sum(pr * step) as ap from st group by all)
select round(avg(ap), 6) as mean_ap, count(*) as n_labels from ap""")
def mean_average_precision(spark, sf_dir):
    return evaluation.average_precision(scores(spark, sf_dir), "name").agg(F.round(F.avg("ap"), 6).alias("mean_ap"), F.count("*").alias("n_labels"))


_OWN = "(case name when 'quality' then 0.3 else 0.7 end)"


@query(f"with {_COUNTS.replace('>= 0.5', '>= ' + _OWN).replace('< 0.5', '< ' + _OWN)} select name, round(\"precision\", 6) as \"precision\", round(recall, 6) as recall, round(f1, 6) as f1 from lm")
def label_thresholds(spark, sf_dir):
    """Metrics of each label at a threshold of its own."""
    own = F.when(F.col("name") == "quality", 0.3).otherwise(0.7)
    return evaluation.label_metrics(scores(spark, sf_dir), own, "name").select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("select t as \"table\", c as \"column\" from (values ('supplier', 's_fax'), ('nation', 'n_code'), ('nation', 'n_area')) v(t, c)")
def required_columns(spark, sf_dir):
    """Columns that tables should have and have not."""
    wanted = {"supplier": ["s_suppkey", "s_name", "s_fax"], "nation": ["n_name", "n_code", "n_area"], "region": ["r_name"]}
    found = [(t, c) for t, cs in wanted.items() for c in quality.missing_columns(table(spark, sf_dir, t), cs)]
    return spark.createDataFrame(found, "table string, column string")


@query(f"with {_CLOSED}, have as (select * from cl where not (complex_id = 4 and len(verts) = 2)), bd as (select distinct complex_id, list_filter(verts, lambda x, i: i <> k) as face from have, range(1, 4) g(k) where k <= len(verts) and len(verts) > 1) select b.complex_id::bigint as complex_id, array_to_string(b.face, ',') as face from bd b anti join have h on h.complex_id = b.complex_id and h.verts = b.face")
def missing_faces(spark, sf_dir):
    """Faces that are lacking once the triangle has lost its edges."""
    whole = simplicial.closure(facets(spark))
    have = whole.where(~((F.col("complex_id") == 4) & (F.size("verts") == 2)))
    return simplicial.missing_faces(have).select("complex_id", F.concat_ws(",", F.transform("face", lambda x: x.cast("string"))).alias("face"))
