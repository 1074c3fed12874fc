"""Queries over persistence diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators import diagrams, topology
from talweg.plans.prelude import CELLS, PAIRS, tree
from talweg.plans.registry import query
from talweg.plans.terrain import nodes_of
from talweg.sources.tables import cells, patches

_P = f"{tree()}, {PAIRS}"
_GRID = "grid as (select i::int as i, 2.0::double + i * 1.5::double as t from range(0, 20) g(i))"


def _thresholds() -> Column:
    return F.array(*[F.lit(2.0 + i * 1.5) for i in range(20)])


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.persistence_pairs(nodes_of(spark, sf_dir))


def neighbours_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of points of each patch (a) and of the next one (b); patches without pairs have empty arrays."""
    found = diagrams.points(pairs_of(spark, sf_dir))
    whole = patches(spark, sf_dir).select("patch_id").join(found, "patch_id", "left").select("patch_id", F.coalesce("points", F.array().cast(found.schema["points"].dataType)).alias("points"))
    after = whole.select((F.col("patch_id") - 1).alias("patch_id"), F.col("points").alias("b"))
    return whole.withColumnRenamed("points", "a").join(after, "patch_id")


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with every seventeenth one nodata."""
    return cells(patches(spark, sf_dir)).withColumn("z", F.when(F.col("cell") % 17 != 0, F.col("z")))


@query(f"with {CELLS}, h as (select patch_id, cell, case when cell % 17 <> 0 then z end as z from cells) select patch_id, cell, round(coalesce(z, max(z) over (partition by patch_id)), 6) as z from h")
def sanitize_field(spark, sf_dir):
    return diagrams.filled_field(holed(spark, sf_dir), "max").select("patch_id", "cell", F.round("z", 6).alias("z"))


@query(f"with {CELLS}, h as (select patch_id, cell, case when cell % 17 <> 0 then z end as z from cells) select patch_id, cell, round(coalesce(z, min(z) over (partition by patch_id)), 6) as z from h")
def clean_tile(spark, sf_dir):
    return diagrams.filled_field(holed(spark, sf_dir), "min").select("patch_id", "cell", F.round("z", 6).alias("z"))


@query(f"with recursive {_P} select e.vec_id as patch_id, coalesce(p.birth, 0)::double as birth, coalesce(p.death, 0)::double as death from embeddings e left join (select * from pairs where death is not null) p on p.patch_id = e.vec_id")
def clean_diagram(spark, sf_dir):
    return diagrams.cleaned(pairs_of(spark, sf_dir), patches(spark, sf_dir))


@query(f"with recursive {_P} select patch_id, birth, death from pairs where death is null or death - birth >= 6")
def prune_diagram(spark, sf_dir):
    return diagrams.pruned(pairs_of(spark, sf_dir), 6.0).select("patch_id", "birth", "death")


@query(f"with recursive {_P} select patch_id, round(log10(greatest(birth, 1)), 6) as birth, round(coalesce(log10(greatest(death, 1)), (select max(log10(greatest(death, 1))) + 0.5 from pairs where death is not null)), 6) as death from pairs")
def log_cap(spark, sf_dir):
    return diagrams.log_capped(pairs_of(spark, sf_dir)).select("patch_id", F.round("birth", 6).alias("birth"), F.round("death", 6).alias("death"))


@query(f"with recursive {_P}, {_GRID} select p.patch_id, g.i, g.t, count(*) filter (where birth <= t and (death is null or t < death)) as n from pairs p, grid g group by all")
def betti_curve(spark, sf_dir):
    return diagrams.betti_curve(diagrams.points(pairs_of(spark, sf_dir)), _thresholds())


@query(f"""with recursive {_P}, {_GRID}, has as (select distinct patch_id from pairs), layers as (select k::int as k from range(1, 4) l(k)),
tents as (select p.patch_id, g.i, greatest(0, least(t - birth, death - t))::double as v, row_number() over (partition by p.patch_id, g.i order by greatest(0, least(t - birth, death - t)) desc) as k from pairs p, grid g where death is not null)
select h.patch_id, g.i, l.k, round(coalesce(t.v, 0), 6) as value from has h cross join grid g cross join layers l left join tents t on t.patch_id = h.patch_id and t.i = g.i and t.k = l.k""")
def landscape(spark, sf_dir):
    return diagrams.landscape(diagrams.points(pairs_of(spark, sf_dir)), _thresholds(), 3).withColumn("value", F.round("value", 6))


@query(f"""with recursive {_P}, has as (select distinct patch_id from pairs), px as (select i % 6 as px, i // 6 as py from range(0, 36) g(i))
select h.patch_id, px.px::int as px, px.py::int as py, round(coalesce(sum((death - birth) * exp(-(pow((birth - (0.0 + (px + 0.5) * 5.0)) / 5.0, 2) + pow(((death - birth) - (py + 0.5) * 5.0) / 5.0, 2)) / 2) / (2 * pi())), 0), 6) as value
from has h cross join px left join pairs p on p.patch_id = h.patch_id and p.death is not null group by all""")
def persistence_image_sampled(spark, sf_dir):
    return diagrams.image_sampled(diagrams.points(pairs_of(spark, sf_dir)), 6, 0.0, 30.0).withColumn("value", F.round("value", 6))


@query(f"""with {CELLS}, lv as (select patch_id, r, c, case when max(z) over w > min(z) over w then floor((z - min(z) over w) / (max(z) over w - min(z) over w) * 15) else 0 end::int as v from cells window w as (partition by patch_id)),
parts as (select patch_id, v, 1 as sign from lv
  union all select a.patch_id, greatest(a.v, b.v), -1 from lv a join lv b on b.patch_id = a.patch_id and ((b.r = a.r and b.c = a.c + 1) or (b.c = a.c and b.r = a.r + 1))
  union all select a.patch_id, greatest(a.v, b.v, d.v, e.v), 1 from lv a join lv b on b.patch_id = a.patch_id and b.r = a.r and b.c = a.c + 1 join lv d on d.patch_id = a.patch_id and d.r = a.r + 1 and d.c = a.c join lv e on e.patch_id = a.patch_id and e.r = a.r + 1 and e.c = a.c + 1)
select g.patch_id, g.level, coalesce((select sum(sign) from parts p where p.patch_id = g.patch_id and p.v <= g.level), 0)::bigint as chi from (select vec_id as patch_id, l::int as level from embeddings, range(0, 16) t(l)) g""")
def euler_curve(spark, sf_dir):
    return diagrams.euler_curve(cells(patches(spark, sf_dir)))


@query(f"""with recursive {_P}, pr as (select vec_id as a, vec_id + 1 as b from embeddings where vec_id + 1 in (select vec_id from embeddings)),
cap as (select pr.a, coalesce(max(p.death) * 1.5, 1.0)::double as cap from pr left join pairs p on p.patch_id in (pr.a, pr.b) group by all),
pt as (select pr.a, p.patch_id = pr.a as own, p.birth::double as x, coalesce(p.death, c.cap)::double as y from pr join cap c on c.a = pr.a join pairs p on p.patch_id in (pr.a, pr.b)),
ang as (select k, -pi() / 2 + k * pi() / 10 as t from range(0, 10) g(k)),
vals as (select a, k, true as side, case when own then x * cos(t) + y * sin(t) else (x + y) / 2 * (cos(t) + sin(t)) end as v from pt, ang
  union all select a, k, false, case when own then (x + y) / 2 * (cos(t) + sin(t)) else x * cos(t) + y * sin(t) end from pt, ang),
rk as (select *, row_number() over (partition by a, k, side order by v) as n from vals)
select pr.a as patch_id, round(coalesce(s.sw, 0), 5) as sw from pr left join (select l.a, sum(abs(l.v - r.v)) / 10 as sw from rk l join rk r on r.a = l.a and r.k = l.k and r.n = l.n and l.side and not r.side group by all) s on s.a = pr.a""")
def sliced_wasserstein(spark, sf_dir):
    """Between each patch's diagram and the next one's, over 10 directions."""
    return diagrams.sliced_wasserstein(neighbours_of(spark, sf_dir), 10).select("patch_id", F.round("sw", 5).alias("sw"))


@query()
def bottleneck(spark, sf_dir):
    return diagrams.bottleneck_rows(neighbours_of(spark, sf_dir), "patch_id")


@query()
def sublevel_ph(spark, sf_dir):
    return diagrams.cubical(patches(spark, sf_dir))


@query()
def superlevel_ph(spark, sf_dir):
    return diagrams.cubical(patches(spark, sf_dir), superlevel=True)


_DIRECTIONAL = f"""{CELLS}, m as (select *, avg(z) over (partition by patch_id) as mean from cells),
dir as (select m.patch_id, d::int as d, m.cell, round((c / 7.0::double * 2 - 1) * cos(d * 2 * pi() / 8) + (r / 7.0::double * 2 - 1) * sin(d * 2 * pi() / 8), 6) as height from m, range(0, 8) t(d) where m.z > m.mean)"""


@query(f"with {_DIRECTIONAL} select * from dir")
def directional_heights(spark, sf_dir):
    """Heights of the cells above the mean along 8 directions."""
    out = diagrams.directional(patches(spark, sf_dir)).select("patch_id", "d", F.posexplode("z").alias("cell", "height"))
    return out.where("height is not null").select("patch_id", "d", "cell", F.round("height", 6).alias("height"))


@query()
def directional_ph(spark, sf_dir):
    """Betti-0 curves of the heights along 8 directions, 10 thresholds each; cells at or below the mean come last."""
    heights = diagrams.directional(patches(spark, sf_dir)).withColumn("z", F.transform("z", lambda v: F.coalesce(v, F.lit(9.0))))
    keyed = heights.select((F.col("patch_id") * 8 + F.col("d")).alias("patch_id"), "label", "h", "w", "z")
    found = diagrams.points(diagrams.cubical(keyed).where("dim = 0"))
    curve = diagrams.betti_curve(found, F.array(*[F.lit(-1.45 + i * 0.3) for i in range(10)]))
    return curve.select(F.floor(F.col("patch_id") / 8).alias("patch_id"), (F.col("patch_id") % 8).cast("int").alias("d"), "i", "n")


@query(f"""with {_DIRECTIONAL}, mean as (select patch_id, d, avg(height) as v from dir group by all),
pr as (select vec_id as a from embeddings where vec_id + 1 in (select vec_id from embeddings)),
cost as (select pr.a, s::int as shift, sum(pow(x.v - y.v, 2)) as cost from pr, range(0, 8) t(s) join mean x on x.patch_id = pr.a join mean y on y.patch_id = pr.a + 1 and y.d = (x.d + s) % 8 group by all)
select a as patch_id, shift, round(cost, 6) as cost from (select *, row_number() over (partition by a order by round(cost, 6), shift) as k from cost) where k = 1""")
def directional_match(spark, sf_dir):
    """The cyclic shift of directions that best matches a patch's mean heights to the next one's."""
    heights = directional_heights(spark, sf_dir).groupBy("patch_id", "d").agg(F.avg("height").alias("v"))
    block = heights.groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("x")).select("patch_id", F.transform("x", lambda p: p["v"]).alias("x"))
    after = block.select((F.col("patch_id") - 1).alias("patch_id"), F.col("x").alias("y"))
    shifted = block.join(after, "patch_id").select("patch_id", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("shift"))
    term = F.transform("x", lambda v, i: (v - F.get("y", (i + F.col("shift")) % 8)) * (v - F.get("y", (i + F.col("shift")) % 8)))
    costs = shifted.select("patch_id", "shift", F.round(F.aggregate(term, F.lit(0.0), lambda a, v: a + v), 6).alias("cost"))
    return costs.groupBy("patch_id").agg(F.min(F.struct("cost", "shift")).alias("m")).select("patch_id", "m.shift", "m.cost")


_CAPPED = f"{_P}, cp as (select patch_id, log10(greatest(birth, 1)) as birth, coalesce(log10(greatest(death, 1)), (select max(log10(greatest(death, 1))) + 0.5 from pairs where death is not null)) as death from pairs)"


@query(f"with recursive {_CAPPED}, r as (select min(birth) as lo, max(birth) as hi, max(death - birth) as span from cp) select round(lo, 6) as lo, round(greatest(hi, lo + span / 30), 6) as hi, round(span, 6) as span, round(span / 30, 6) as pixel from r")
def image_grid(spark, sf_dir):
    """The grid of persistence images, frozen over the diagrams of all patches."""
    r = diagrams.image_grid(diagrams.log_capped(pairs_of(spark, sf_dir)))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query()
def persistence_image_mass(spark, sf_dir):
    """Pixel masses of every patch's capped diagram on the frozen grid."""
    capped = diagrams.log_capped(pairs_of(spark, sf_dir))
    grid = diagrams.image_grid(capped).first()
    return diagrams.image_mass(diagrams.points(capped), grid["lo"], grid["hi"], grid["span"], grid["pixel"])
