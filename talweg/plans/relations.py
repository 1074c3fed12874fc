"""Queries of quality checks, relational operators, boxes, evaluation and simplicial complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.functions import coords
from talweg.operators import evaluation, kernels, quality, raster, simplicial, spatial, topology
from talweg.operators.ranking import numbered
from talweg.plans.prelude import CELLS
from talweg.plans.registry import query
from talweg.sources.tables import boxes, cells, patches, table
from talweg.streaming import ingest

# Quality checks


@query("""with rules as (select * from (values ('click', 0.0, 50.0), ('view', 0.0, 100.0), ('purchase', 10.0, 200.0), ('signup', 0.0, 100.0)) r(event_type, lo, hi))
select e.event_type, count(*) as n, count(*) filter (where value < r.lo or value > r.hi) as n_outside, round(min(value), 6) as least, round(max(value), 6) as greatest, count(*) filter (where value < r.lo or value > r.hi) = 0 as passed from events e left join rules r on r.event_type = e.event_type group by all""")
def range_rules(spark, sf_dir):
    """Values outside the range that holds for their type; types without a rule pass."""
    rules = spark.createDataFrame([("click", 0.0, 50.0), ("view", 0.0, 100.0), ("purchase", 10.0, 200.0), ("signup", 0.0, 100.0)], "event_type string, lo double, hi double")
    outside = F.coalesce((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), F.lit(False))
    e = table(spark, sf_dir, "events").join(F.broadcast(rules), "event_type", "left").groupBy("event_type")
    return e.agg(F.count("*").alias("n"), F.count_if(outside).alias("n_outside"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("greatest"), (F.count_if(outside) == 0).alias("passed"))


@query("select event_type, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day, count(*) as n, count(distinct ts::date) as n_days, min(ts) <= timestamp '2024-01-08' and max(ts) >= timestamp '2024-01-20' as covers from events group by all")
def time_coverage(spark, sf_dir):
    """Whether each variable's times cover the expected range."""
    low, high = F.min("ts"), F.max("ts")
    covers = (low <= F.lit("2024-01-08").cast("timestamp")) & (high >= F.lit("2024-01-20").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.date_format(low, "yyyy-MM-dd").alias("first_day"), F.date_format(high, "yyyy-MM-dd").alias("last_day"), F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("n_days"), covers.alias("covers")
    )


@query("select count(*) as n, count(distinct l_partkey) as n_parts, count(distinct l_suppkey) as n_suppliers, round((count(*) filter (where nullif(l_linenumber, 1) is null) + count(*) filter (where nullif(l_discount, 0) is null))::double / (2 * count(*)), 6) as null_share from lineitem")
def null_pct(spark, sf_dir):
    """Rows, distinct keys and the share of nulls over required cells (line number 1 and discount 0 read as null)."""
    t = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.nullif("l_linenumber", F.lit(1)).alias("a"), F.nullif("l_discount", F.lit(0.0)).alias("b"))
    return t.agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.round(quality.null_share(t, ["a", "b"]), 6).alias("null_share"))


@query("select p_partkey, p_name, n from (select p_partkey, p_name, count(*) over (partition by lower(trim(p_name))) as n from part) where n > 1")
def duplicate_names(spark, sf_dir):
    """All members of groups of equal names."""
    n = F.count("*").over(W.partitionBy(F.lower(F.trim("p_name"))))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", n.alias("n")).where("n > 1")


_BAD = "m as (select event_type, event_id, case when event_id % 97 = 0 then 'nan'::double when event_id % 89 = 0 then 'inf'::double when event_id % 83 = 0 then '-inf'::double when event_id % 79 = 0 then 1e101 when event_id % 73 = 0 then 1e11 else value end as v from events)"


def _spoiled(spark: SparkSession, sf_dir: str, huge: bool = True) -> DataFrame:
    i = F.col("event_id")
    v = F.when(i % 97 == 0, float("nan")).when(i % 89 == 0, float("inf")).when(i % 83 == 0, float("-inf"))
    if huge:
        v = v.when(i % 79 == 0, 1e101).when(i % 73 == 0, 1e11)
    return table(spark, sf_dir, "events").select("event_type", "event_id", v.otherwise(F.col("value")).alias("v"))


@query(f"with {_BAD} select event_type, count(*) filter (where isnan(v)) as n_nan, count(*) filter (where isinf(v)) as n_inf, count(*) filter (where not isnan(v) and not isinf(v) and abs(v) > 1e100) as n_extreme, count(*) filter (where not isnan(v) and not isinf(v) and abs(v) > 1e10) as n_large from m group by all")
def matrix_quality(spark, sf_dir):
    return quality.matrix_quality(_spoiled(spark, sf_dir), "v", "event_type")


_MILD = _BAD.replace(" when event_id % 79 = 0 then 1e101 when event_id % 73 = 0 then 1e11", "")


@query(f"with {_MILD}, s as (select event_type, max(v) as hi, min(v) as lo, avg(v) as m, stddev_pop(v) as s from m where not isnan(v) and not isinf(v) group by all) select m.event_id, round(case when v = 'inf'::double then hi + 3 * s when v = '-inf'::double then lo - 3 * s when isnan(v) then s.m else v end, 4) as v from m join s on s.event_type = m.event_type")
def clean_columns(spark, sf_dir):
    return quality.cleaned_column(_spoiled(spark, sf_dir, huge=False), "v", "event_type").select("event_id", F.round("v", 4).alias("v"))


@query(f"with {_MILD}, z as (select event_type, event_id, case when isnan(v) or isinf(v) then 0 else v end as v from m), s as (select event_type, avg(v) as m, stddev_pop(v) as s from z group by all) select z.event_id, round(case when s.s > 0 then (v - s.m) / s.s else 0 end, 6) as v from z join s on s.event_type = z.event_type")
def standardize(spark, sf_dir):
    return quality.standardized(_spoiled(spark, sf_dir, huge=False), "v", "event_type").select("event_id", F.round("v", 6).alias("v"))


@query("with names as (select unnest(['A', 'N', 'R', 'X']) as zone), s as (select l_returnflag as zone, count(*) as n, avg(l_quantity) as mean, stddev_pop(l_quantity) as sd, min(l_quantity) as lo, max(l_quantity) as hi, quantile_cont(l_quantity, 0.5) as median from lineitem group by all) select n.zone, coalesce(s.n, 0) as n, round(coalesce(mean, 0), 6) as mean, round(coalesce(sd, 0), 6) as sd, coalesce(lo, 0)::double as lo, coalesce(hi, 0)::double as hi, coalesce(median, 0)::double as median from names n left join s on s.zone = n.zone")
def zonal_stats(spark, sf_dir):
    """Statistics of every named zone, zeros where a zone has no cells."""
    zones = spark.createDataFrame([(z,) for z in "ANRX"], "zone string")
    q = F.col("l_quantity")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("zone")).agg(F.count("*").alias("n"), F.avg(q).alias("mean"), F.stddev_pop(q).alias("sd"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.percentile(q, 0.5).alias("median"))
    out = F.broadcast(zones).join(s, "zone", "left").na.fill(0)
    return out.select("zone", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "lo", "hi", "median")


@query("with s as (select l_linestatus as channel, avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as s from lineitem group by all) select channel, round(m, 4) as mean, round(s, 4) as sd from s")
def norm_stats(spark, sf_dir):
    """Normalization parameters of each channel, in one pass."""
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("channel")).agg(F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_pop(p), 4).alias("sd"))


@query("with s as (select l_linestatus as channel, avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as s from lineitem group by all) select l_orderkey, l_linenumber, round(case when l_linestatus = 'O' then (l_extendedprice - m) / s else l_extendedprice end, 4) as x from lineitem join s on channel = l_linestatus")
def channel_normalize(spark, sf_dir):
    """Normalizes by a channel's parameters; channels other than O are left alone."""
    t = table(spark, sf_dir, "lineitem")
    p = F.col("l_extendedprice")
    s = t.groupBy("l_linestatus").agg(F.avg(p).alias("m"), F.stddev_pop(p).alias("s"))
    return t.join(F.broadcast(s), "l_linestatus").select("l_orderkey", "l_linenumber", F.round(F.when(F.col("l_linestatus") == "O", (p - F.col("m")) / F.col("s")).otherwise(p), 4).alias("x"))


@query("""with a as (select count(*) as n, count(distinct c_custkey) as k, count(*) filter (where c_acctbal is null) as nulls, min(c_acctbal) as lo, max(c_acctbal) as hi from customer), b as (select count(*) as n, count(*) filter (where o_totalprice <= 0) as bad from orders)
select 'customer' as dataset, 'not_empty' as "check", n > 0 as passed, 'error' as severity, n::varchar as message from a union all select 'customer', 'unique_key', n = k, 'error', (n - k)::varchar from a union all select 'customer', 'range', lo >= -500 and hi <= 9000, 'warning', null from a
union all select 'customer', 'no_nulls', nulls = 0, 'error', nulls::varchar from a union all select 'orders', 'positive_price', bad = 0, 'error', bad::varchar from b""")
def quality_report(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n, nulls, bad = F.count("*"), F.count_if(F.col("c_acctbal").isNull()), F.count_if(F.col("o_totalprice") <= 0)
    extra = n - F.count_distinct("c_custkey")
    return quality.report([
        quality.check(c, "customer", "not_empty", n > 0, n), quality.check(c, "customer", "unique_key", extra == 0, extra),
        quality.check(c, "customer", "range", (F.min("c_acctbal") >= -500) & (F.max("c_acctbal") <= 9000), F.lit(None), "warning"),
        quality.check(c, "customer", "no_nulls", nulls == 0, nulls), quality.check(o, "orders", "positive_price", bad == 0, bad),
    ])


@query("select s_suppkey, round(case when greatest(abs(s_acctbal), abs(s_suppkey)) < 1e-12 then 0 else abs(s_acctbal - s_suppkey) / greatest(abs(s_acctbal), abs(s_suppkey)) end, 6) as difference, round(case when s_suppkey <= 0 then 0 else abs(s_acctbal - s_suppkey) / s_suppkey end, 6) as error from supplier")
def percent_difference(spark, sf_dir):
    a, b = F.col("s_acctbal"), F.col("s_suppkey").cast("double")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(quality.percent_difference(a, b), 6).alias("difference"), F.round(quality.relative_error(a, b), 6).alias("error"))


@query("with c as (select label, count(*) as n from embeddings group by all) select label::int as label, n, n < 49 as rare from c")
def rare_labels(spark, sf_dir):
    """Labels with fewer than 49 members."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").cast("int").alias("label"), "n", (F.col("n") < 49).alias("rare"))


@query(f"with {CELLS}, t as (select patch_id, count(*) as n, max(r) + 1 as h, max(c) + 1 as w, round(min(z), 6) as lo from cells group by all), o as (select n as n0, h as h0, w as w0 from t where patch_id = 0) select t.patch_id, t.n = o.n0 as same_size, t.h = o.h0 and t.w = o.w0 as same_shape, t.lo between -10 and 10 as in_range from t, o")
def alignment_check(spark, sf_dir):
    """Size and shape of each patch against the first one's, and its range."""
    t = patches(spark, sf_dir).select("patch_id", F.size("z").alias("n"), "h", "w", F.array_min("z").alias("lo"))
    o = t.where("patch_id = 0").select(F.col("n").alias("n0"), F.col("h").alias("h0"), F.col("w").alias("w0"))
    return t.crossJoin(F.broadcast(o)).select("patch_id", F.col("n").eqNullSafe(F.col("n0")).alias("same_size"), (F.col("h").eqNullSafe(F.col("h0")) & F.col("w").eqNullSafe(F.col("w0"))).alias("same_shape"), F.col("lo").between(-10, 10).alias("in_range"))


# Keys, boxes and joins of boxes

_LL = "ll as (select c_custkey, (c_custkey * 7 % 360 - 180)::int as lon, (c_custkey * 11 % 160 - 80)::int as lat from customer)"
_KEY = "concat(case when {lat} >= 0 then 'n' else 's' end, lpad(abs({lat})::varchar, 2, '0'), case when lon >= 0 then 'e' else 'w' end, lpad(abs(lon)::varchar, 3, '0'))"


def _ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 360 - 180).cast("int").alias("lon"), (F.col("c_custkey") * 11 % 160 - 80).cast("int").alias("lat"))


@query(f"with {_LL} select c_custkey, {_KEY.format(lat='lat')} as sw, {_KEY.format(lat='(lat + 1)')} as nw, lon as min_lon, lat as min_lat, lon + 1 as max_lon, lat + 1 as max_lat from ll")
def tile_key_roundtrip(spark, sf_dir):
    """Both key conventions, and the box that the north-west key stands for."""
    out = _ll(spark, sf_dir).select("c_custkey", coords.key_sw(F.col("lon"), F.col("lat")).alias("sw"), coords.key_nw(F.col("lon"), F.col("lat")).alias("nw"))
    return out.withColumn("b", coords.box_of_key_nw(F.col("nw"))).select("c_custkey", "sw", "nw", "b.*")


@query("with s as (select s_suppkey, (s_suppkey * 3 % 50)::double + 0.25 as x, (s_suppkey * 5 % 40)::double + 0.5 as y from supplier) select s_suppkey, lon::int as lon, lat::int as lat from s, range(0, 60) a(lon), range(0, 60) b(lat) where lon >= floor(x) and lon < ceil(x + 2.0) and lat >= floor(y) and lat < ceil(y + 1.25)")
def tiles_covering_bbox(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 3 % 50).cast("double") + 0.25).alias("x"), ((F.col("s_suppkey") * 5 % 40).cast("double") + 0.5).alias("y"))
    return s.select("s_suppkey", F.explode(coords.tiles_covering(F.col("x"), F.col("y"), F.col("x") + 2, F.col("y") + 1.25)).alias("t")).select("s_suppkey", "t.lon", "t.lat")


def _boxes(t: str, key: str, as_: str) -> str:
    return f"{as_} as (select {key} as k, ({key} * 7 % 100)::double as x0, ({key} * 13 % 100)::double as y0, ({key} * 7 % 100 + 3 + {key} % 5)::double as x1, ({key} * 13 % 100 + 2 + {key} % 4)::double as y1 from {t})"


_CB = f"{_boxes('customer', 'c_custkey', 'cb')}, {_boxes('supplier', 's_suppkey', 'sb')}"
_MEET = "c.x0 <= s.x1 and s.x0 <= c.x1 and c.y0 <= s.y1 and s.y0 <= c.y1"
_SHARE = "c.x0 < s.x1 and s.x0 < c.x1 and c.y0 < s.y1 and s.y0 < c.y1"
_AREA = "(least(c.x1, s.x1) - greatest(c.x0, s.x0)) * (least(c.y1, s.y1) - greatest(c.y0, s.y0))"


def _cb(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return boxes(table(spark, sf_dir, "customer"), "c_custkey", "customer"), boxes(table(spark, sf_dir, "supplier"), "s_suppkey", "supplier").withColumnRenamed("b", "sb")


@query(f"with {_CB} select c.k as customer, s.k as supplier, {_AREA} as shared from cb c join sb s on {_SHARE}")
def bbox_join(spark, sf_dir):
    c, s = _cb(spark, sf_dir)
    return spatial.box_join(c, s, "b", "sb", strict=True).select("customer", "supplier", coords.overlap_area(F.col("b"), F.col("sb")).alias("shared"))


@query(f"with {_CB} select c.k as customer from cb c where exists (select 1 from sb s where {_MEET})")
def bbox_semi_join(spark, sf_dir):
    c, s = _cb(spark, sf_dir)
    return spatial.box_semi_join(c, s, "b", "sb", "customer").select("customer")


@query(f"with {_CB} select c.k as customer from cb c where not exists (select 1 from sb s where s.k % 10 = 0 and {_SHARE})")
def bbox_anti_join(spark, sf_dir):
    c, s = _cb(spark, sf_dir)
    return spatial.box_anti_join(c, s.where("supplier % 10 = 0"), "b", "sb", "customer").select("customer")


@query(f"with {_CB} select customer, supplier, shared from (select c.k as customer, s.k as supplier, {_AREA} as shared, row_number() over (partition by c.k order by {_AREA} desc, s.k % 5, s.k) as n from cb c join sb s on {_SHARE}) where n = 1")
def best_cover(spark, sf_dir):
    """For each customer's box the supplier's that covers most of it, then the finest (key modulo 5), then the first."""
    c, s = _cb(spark, sf_dir)
    return spatial.best_cover(c, s, "b", "sb", "customer", F.col("supplier") % 5, F.col("supplier")).select("customer", "supplier", F.col("overlap").alias("shared"))


@query(f"with {_CB} select c.k as customer from cb c where c.x0 <= 40 and c.x1 >= 20 and c.y0 <= 60 and c.y1 >= 30")
def bbox_range(spark, sf_dir):
    c, _ = _cb(spark, sf_dir)
    window = F.struct(F.lit(20.0).alias("min_x"), F.lit(30.0).alias("min_y"), F.lit(40.0).alias("max_x"), F.lit(60.0).alias("max_y"))
    return c.where(coords.intersects(F.col("b"), window)).select("customer")


@query(f"with {_CB} select k as customer, greatest(x0, 20) as x0, greatest(y0, 30) as y0, least(x1, 40) as x1, least(y1, 60) as y1 from cb c where x0 < 40 and x1 > 20 and y0 < 60 and y1 > 30")
def box_clip(spark, sf_dir):
    c, _ = _cb(spark, sf_dir)
    window = F.struct(F.lit(20.0).alias("min_x"), F.lit(30.0).alias("min_y"), F.lit(40.0).alias("max_x"), F.lit(60.0).alias("max_y"))
    return spatial.clipped(c, "b", window).select("customer", F.col("b.min_x").alias("x0"), F.col("b.min_y").alias("y0"), F.col("b.max_x").alias("x1"), F.col("b.max_y").alias("y1"))


@query(f"with {_CB} select r::int as r, c::int as c, max(s.k)::bigint as value from sb s, range(0, 110) a(r), range(0, 110) b(c) where c >= floor(x0) and c <= floor(x1) and r >= floor(y0) and r <= floor(y1) group by all")
def rasterize_boxes(spark, sf_dir):
    """Unit cells that suppliers' boxes touch; the greatest key wins."""
    _, s = _cb(spark, sf_dir)
    return spatial.rasterized(s, "sb", "supplier", "supplier", 110, 110)


@query(f"with {_CB} select count(*) as n_cells, round(count(*) / 12100.0::double, 6) as coverage from (select distinct r, c from sb s, range(0, 110) a(r), range(0, 110) b(c) where c >= floor(x0) and c <= floor(x1) and r >= floor(y0) and r <= floor(y1))")
def coverage_pct(spark, sf_dir):
    """Share of an area that the union of boxes covers, on unit cells."""
    _, s = _cb(spark, sf_dir)
    return spatial.rasterized(s, "sb", "supplier", "supplier", 110, 110).agg(F.count("*").alias("n_cells"), F.round(F.count("*") / 12100.0, 6).alias("coverage"))


@query(f"""with {_CB}, test as (select * from sb order by md5(k::varchar), k limit 5), rest as (select * from sb c where k not in (select k from test) and not exists (select 1 from test s where {_SHARE})), val as (select * from rest order by md5(k::varchar), k limit 5),
train as (select * from rest c where k not in (select k from val) and not exists (select 1 from val s where {_SHARE})) select k as supplier, case when k in (select k from test) then 'test' when k in (select k from val) then 'validation' when k in (select k from train) then 'train' end as split from sb""")
def independent_split(spark, sf_dir):
    _, s = _cb(spark, sf_dir)
    return spatial.independent_split(s, "supplier", "sb", 5, 5, F.md5(F.col("supplier").cast("string"))).select("supplier", "split")


@query(f"with {_CB} select s.k as supplier, (x1 - x0) * (y1 - y0) as area, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, (7 * k % 3 = 0) as boundary from sb s")
def footprint(spark, sf_dir):
    """Area by the box's ring, its centre, and a flag."""
    _, s = _cb(spark, sf_dir)
    b = F.col("sb")
    return s.select("supplier", coords.shoelace(coords.ring(b)).alias("area"), ((b["min_x"] + b["max_x"]) / 2).alias("cx"), ((b["min_y"] + b["max_y"]) / 2).alias("cy"), (7 * F.col("supplier") % 3 == 0).alias("boundary"))


@query(f"with {_CB} select c.k as customer, s.k as supplier from cb c join sb s on s.x0 < (c.x0 + c.x1) / 2 + 0.25 and (c.x0 + c.x1) / 2 + 0.25 < s.x1 and s.y0 < (c.y0 + c.y1) / 2 + 0.25 and (c.y0 + c.y1) / 2 + 0.25 < s.y1")
def point_in_ring(spark, sf_dir):
    """Centres (moved a quarter) inside rings, by ray crossings behind a join on cells, once for equal centres and boxes."""
    c, s = _cb(spark, sf_dir)
    b, p = F.col("b"), F.col("p")
    x, y = (b["min_x"] + b["max_x"]) / 2 + 0.25, (b["min_y"] + b["max_y"]) / 2 + 0.25
    centres = c.select("customer", F.struct(x.alias("min_x"), y.alias("min_y"), x.alias("max_x"), y.alias("max_y")).alias("p"))
    return spatial.point_join(centres, s, "p", "sb", "customer", "supplier", coords.inside_ring(p["min_x"], p["min_y"], coords.ring(F.col("sb"))))


@query(f"with {_LL} select c_custkey, round(radians(lon) * 6378137.0, 3) as x, round(ln(tan(radians(lat) / 2 + 0.7853981633974483::double)) * 6378137.0, 3) as y from ll")
def mercator(spark, sf_dir):
    return _ll(spark, sf_dir).select("c_custkey", coords.mercator(F.col("lon"), F.col("lat")).alias("m")).select("c_custkey", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


@query(f"""with {_CB}, cl as (select k, x0, y0 from cb), d as (select c.k, count(*) filter (where {_SHARE}) as n from cb c join sb s on {_MEET} group by all) select count(*) as n_touching, count(*) filter (where n > 0) as n_overlapping, count(*) filter (where n > 0) = 0 as passed from d""")
def leakage_gap(spark, sf_dir):
    """Customers' boxes that touch or overlap suppliers': touching is allowed, overlap is a leak."""
    c, s = _cb(spark, sf_dir)
    d = spatial.box_join(c, s, "b", "sb").groupBy("customer").agg(F.count_if(coords.overlaps(F.col("b"), F.col("sb"))).alias("n"))
    return d.agg(F.count("*").alias("n_touching"), F.count_if(F.col("n") > 0).alias("n_overlapping"), (F.count_if(F.col("n") > 0) == 0).alias("passed"))


@query("select p_partkey, p_name from (select p_partkey, p_name, row_number() over (partition by p_size order by case when p_name like '%red%' then 1 when p_name like 's%' then 2 else 3 end, p_partkey) as k from part) where k = 1")
def prioritized_match(spark, sf_dir):
    """The best match in each group by rank of its rule."""
    rank = F.when(F.col("p_name").contains("red"), 1).when(F.col("p_name").startswith("s"), 2).otherwise(3)
    best = table(spark, sf_dir, "part").groupBy("p_size").agg(F.min(F.struct(rank.alias("rank"), "p_partkey", "p_name")).alias("m"))
    return best.select("m.p_partkey", "m.p_name")


@query("with a as (select o_custkey as k, round(sum(o_totalprice), 2) as v from orders where o_orderstatus = 'O' group by all), b as (select o_custkey as k, round(sum(o_totalprice), 2) as v from orders where o_orderstatus <> 'P' group by all) select coalesce(a.k, b.k) as k, a.v as a, b.v as b, coalesce(abs(a.v - b.v) < 1e-6, false) as matches from a full outer join b on a.k = b.k")
def full_compare(spark, sf_dir):
    """Recomputed against stored values, key by key."""
    side = lambda keep, v: table(spark, sf_dir, "orders").where(keep).groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias(v))
    both = side(F.col("o_orderstatus") == "O", "a").join(side(F.col("o_orderstatus") != "P", "b"), "k", "full_outer")
    return both.select("k", "a", "b", F.coalesce(F.abs(F.col("a") - F.col("b")) < 1e-6, F.lit(False)).alias("matches"))


@query("select n_name, r_name, upper(trim(n_name)) as standard from nation join region on r_regionkey = n_regionkey where r_name in ('ASIA', 'EUROPE', 'AFRICA')")
def projection_filter(spark, sf_dir):
    keep = table(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE", "AFRICA"))
    return table(spark, sf_dir, "nation").join(keep, F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", "r_name", F.upper(F.trim("n_name")).alias("standard"))


@query("select c_custkey, count(o_orderkey) as n_orders from customer left join orders on o_custkey = c_custkey group by all")
def left_join_count(spark, sf_dir):
    """Counts before the join: one row a customer meets the customers."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("select a.n_nationkey as i, b.n_nationkey as j, a.n_regionkey = b.n_regionkey as same from nation a join nation b on a.n_nationkey < b.n_nationkey")
def theta_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    b = n.select(F.col("n_nationkey").alias("j"), F.col("n_regionkey").alias("r2"))
    return n.join(b, F.col("n_nationkey") < F.col("j")).select(F.col("n_nationkey").alias("i"), "j", (F.col("n_regionkey") == F.col("r2")).alias("same"))


@query("select k::int as k, rep::int as rep, r_name from range(0, 3) a(k), range(0, 4) b(rep), region")
def cartesian(spark, sf_dir):
    """Sizes x repetitions x regions, all of them small by definition."""
    grid = spark.range(12).select(F.floor(F.col("id") / 4).cast("int").alias("k"), (F.col("id") % 4).cast("int").alias("rep"))
    return table(spark, sf_dir, "region").select("r_name").crossJoin(F.broadcast(grid)).select("k", "rep", "r_name")


@query("select l_returnflag, l_linestatus, sum(l_quantity) as quantity, count(*) as n, count(distinct l_partkey) as parts from lineitem group by all")
def group_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))


@query("select s_nationkey, string_agg(s_suppkey::varchar, ',' order by s_suppkey) as members, count(*) as n from supplier group by all")
def group_collect(spark, sf_dir):
    members = F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: k.cast("string"))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(members, ",").alias("members"), F.count("*").alias("n"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, round(stddev_pop(value), 6) as sd0, round(stddev_samp(value), 6) as sd1 from events group by all")
def percentiles(spark, sf_dir):
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.get(q, F.lit(0)), 6).alias("median"), F.round(F.get(q, F.lit(1)), 6).alias("p95"), F.round(F.stddev_pop("value"), 6).alias("sd0"), F.round(F.stddev_samp("value"), 6).alias("sd1"))


@query(f"with {_MILD} select event_type, round(quantile_cont(case when not isnan(v) and not isinf(v) then v end, 0.5), 6) as median, round(max(case when not isnan(v) and not isinf(v) then v end), 6) as greatest from m group by all")
def nan_skipping(spark, sf_dir):
    v = quality.finite("v")
    return _spoiled(spark, sf_dir, huge=False).groupBy("event_type").agg(F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.max(v), 6).alias("greatest"))


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup_totals(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank, round(sum(o_totalprice) over (partition by o_custkey order by o_totalprice desc, o_orderkey rows unbounded preceding), 2) as running, round(o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_totalprice desc, o_orderkey), 2) as step from orders")
def ranked_running(spark, sf_dir):
    """Ranks, running sums and steps within each customer."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("rank"), F.round(F.sum(p).over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"), F.round(p - F.lag(p).over(w), 2).alias("step"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("select key, min(kind) as kind, count(*) as n from (select c_nationkey as key, 'customer' as kind from customer union all select s_nationkey, 'supplier' from supplier) group by all")
def union_layers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("supplier").alias("kind"))
    return c.unionByName(s).groupBy("key").agg(F.min("kind").alias("kind"), F.count("*").alias("n"))


@query("select distinct c_nationkey as key, c_mktsegment as segment from customer")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("segment")).distinct()


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderkey % 7 = 0")
def except_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("select c_custkey as k from customer intersect select o_custkey from orders")
def intersect_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("unpivot (select p_partkey, p_size::double as size, p_retailprice::double as price from part) on size, price into name class value area")
def unpivot_areas(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    return p.unpivot(["p_partkey"], ["size", "price"], "class", "area")


@query("select event_type, count(*) filter (where user_id % 3 = 0) as u0, count(*) filter (where user_id % 3 = 1) as u1, count(*) filter (where user_id % 3 = 2) as u2 from events group by all")
def pivot_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("u"))
    return e.groupBy("event_type").pivot("u", ["u0", "u1", "u2"]).agg(F.count("event_type")).na.fill(0)


@query("select p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 as pos, unnest(string_split(p_name, ' ')) as part from part")
def explode_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "part"))


@query("select c_custkey from customer order by md5(concat('17-', c_custkey)), c_custkey limit 100")
def sample_rows(spark, sf_dir):
    """A hundred rows without replacement, drawn by hash."""
    return table(spark, sf_dir, "customer").select("c_custkey").orderBy(F.md5(F.concat(F.lit("17-"), F.col("c_custkey").cast("string"))), "c_custkey").limit(100)


@query("select c_custkey, (c_custkey % 4)::int as shard from customer")
def shard_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(4)).cast("int").alias("shard"))


@query("select p_type, p_partkey from part where p_size = (select max(p_size) from part)")
def scalar_subquery(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.join(F.broadcast(p.agg(F.max("p_size").alias("m"))), F.col("p_size") == F.col("m")).select("p_type", "p_partkey")


@query("with n as (select p_partkey, concat(split_part(p_name, ' ', 1), '_', p_size, case when p_size % 2 = 0 then 'ms' else '' end) as name from part) select p_partkey, name, row_number() over (order by regexp_extract(name, '^(\\D*)', 1), regexp_extract(name, '(\\d+)', 1)::int, name like '%ms', p_partkey) as place from n")
def natural_order(spark, sf_dir):
    """Names in natural order: prefix, number, suffix."""
    name = F.concat(F.split("p_name", " ")[0], F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "ms").otherwise(""))
    n = table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("key", coords.natural_key(F.col("name")))
    return numbered(n, ["key", "p_partkey"], "place").select("p_partkey", "name", (F.col("place") + 1).cast("int").alias("place"))


@query("select event_id, props, coalesce(json_extract_string(props, '$.k'), 'none') as k from events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "props", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k"))


@query("select l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d') as day, datediff('day', timestamp '1992-01-01', l_shipdate)::int as days from lineitem")
def date_fields(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd").alias("day"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("days"))


_FL = """fl as (select s_suppkey as line, s_nationkey as tile, list_transform(range(0, 2 + s_suppkey % 3), lambda i: {'x': ((s_suppkey * 3 + i * (1 + s_suppkey % 2)) % 6)::double / 10, 'y': ((s_suppkey * 5 + i) % 4)::double / 10}) as v from supplier),
ed as (select tile, line, (v[1].x / 0.0001::double) as sx, (v[1].y / 0.0001::double) as sy, (v[len(v)].x / 0.0001::double) as dx, (v[len(v)].y / 0.0001::double) as dy, list_sum(list_transform(range(1, len(v)), lambda i: sqrt(pow(v[i + 1].x - v[i].x, 2) + pow(v[i + 1].y - v[i].y, 2)))) as degrees from fl),
e as (select tile, line, degrees, concat(round_even(sx, 0)::bigint, ':', round_even(sy, 0)::bigint) as src, concat(round_even(dx, 0)::bigint, ':', round_even(dy, 0)::bigint) as dst from ed),
ok as (select * from e where src <> dst)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = lambda i: F.struct(((k * 3 + i * (1 + k % 2)) % 6 / 10).cast("double").alias("x"), ((k * 5 + i) % 4 / 10).cast("double").alias("y"))
    return table(spark, sf_dir, "supplier").select(k.alias("line_id"), F.col("s_nationkey").alias("tile"), F.transform(F.sequence(F.lit(0).cast("long"), 1 + k % 3), at).alias("vertices"))


@query(f"with {_FL}, n as (select tile, dst as node, count(*) as n from ok group by all) select o.tile, count(*) as edges, (select count(*) from n where n.tile = o.tile and n.n >= 2) as junctions, (select count(*) from n where n.tile = o.tile and not exists (select 1 from ok k where k.tile = n.tile and k.src = n.node)) as roots, round(sum(degrees) * 111 / 1000.0::double, 6) as density from ok o group by all")
def flowline_network(spark, sf_dir):
    out = topology.flowline_statistics(topology.flowline_edges(_lines(spark, sf_dir)), F.lit(1000.0))
    return out.withColumn("density", F.round("density", 6))


@query()
def flowline_branching(spark, sf_dir):
    """Junctions, roots, orders, ratio and density of each tile's flowlines."""
    out = topology.flowline_branching(topology.flowline_edges(_lines(spark, sf_dir)), F.lit(1000.0))
    return out.select(*[F.round(c, 6).alias(c) if c in ("density", "rb") else c for c in out.columns])


@query()
def branching_agreement(spark, sf_dir):
    """Patches and flowlines side by side, tile by tile (labels against nations)."""
    edges = topology.flowline_edges(_lines(spark, sf_dir))
    nodes = kernels.merge_tree(patches(spark, sf_dir), 2).withColumnRenamed("label", "tile")
    dist = topology.distribution(nodes, "tile")
    drained = kernels.stream_cells(patches(spark, sf_dir), 2).groupBy("patch_id").agg(F.count("*").alias("n")).join(patches(spark, sf_dir).select("patch_id", F.col("label").alias("tile")), "patch_id")
    density = drained.groupBy("tile").agg((F.sum("n") / (F.count("*") * 64)).alias("density"))
    own = topology.junctions(nodes, "tile").join(topology.bifurcation(dist, "tile"), "tile").join(density, "tile")
    lines = topology.flowline_branching(edges, F.lit(1000.0)).withColumn("tile", F.col("tile").cast("int"))
    of_lines = topology.flowline_orders(edges).withColumn("tile", F.col("tile").cast("int"))
    out = topology.branching_agreement(own, lines, dist, of_lines)
    return out.select("tile", *[F.round(c, 6).alias(c) for c in out.columns if c != "tile"])


@query(f"with {_FL}, d as (select tile, round(sum(degrees) * 111, 6) as km from ed where degrees > 0 group by all) select tile, km, (rank() over (order by km desc, tile))::int as place from d")
def flowline_density(spark, sf_dir):
    v = F.col("vertices")
    length = F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), F.lit(0.0), lambda a, i: a + F.hypot(F.get(v, i)["x"] - F.get(v, i - 1)["x"], F.get(v, i)["y"] - F.get(v, i - 1)["y"]))
    d = _lines(spark, sf_dir).withColumn("degrees", length).where("degrees > 0").groupBy("tile").agg(F.round(F.sum("degrees") * 111, 6).alias("km"))
    return d.withColumn("place", F.rank().over(W.orderBy(F.desc("km"), "tile")))


@query(f"with {CELLS} select patch_id, (patch_id * 1.5)::double as gb, round(greatest(n / 64.0::double * patch_id * 1.5, n * 4 * 0.5 / 1000)::double, 6) as estimate, case patch_id % 3 when 0 then 'float32' when 1 then 'uint8' else 'int16' end as kind from (select patch_id, count(*) as n from cells group by all)")
def size_estimate(spark, sf_dir):
    """Output sizes by share of the area or by pixels, whichever is more; and the raster type of an array type."""
    kinds = F.array(F.lit("float32"), F.lit("uint8"), F.lit("int16"))
    n, gb = F.size("z"), F.col("patch_id") * 1.5
    return patches(spark, sf_dir).select("patch_id", gb.cast("double").alias("gb"), F.round(F.greatest(n / 64.0 * gb, n * 4 * 0.5 / 1000), 6).alias("estimate"), F.get(kinds, (F.col("patch_id") % 3).cast("int")).alias("kind"))


@query(f"with {CELLS}, bx as (select s_suppkey as k, (s_suppkey % 5)::int as r0, (s_suppkey % 4)::int as c0 from supplier) select k as box, patch_id, r - r0 as r, c - c0 as c, round(z, 6) as z from cells join bx on bx.k = patch_id and r between r0 and r0 + 3 and c between c0 and c0 + 3")
def patch_extract(spark, sf_dir):
    """Cells of each patch inside its box, for all boxes, in the box's own rows and columns."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("box"), (F.col("s_suppkey") % 5).cast("int").alias("r0"), (F.col("s_suppkey") % 4).cast("int").alias("c0"))
    at = cells(patches(spark, sf_dir)).join(b, F.col("box") == F.col("patch_id"))
    inside = at.where((F.col("r") >= F.col("r0")) & (F.col("r") <= F.col("r0") + 3) & (F.col("c") >= F.col("c0")) & (F.col("c") <= F.col("c0") + 3))
    return inside.select("box", "patch_id", (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), F.round("z", 6).alias("z"))


@query("select n_name, r_name from nation, region where n_regionkey = r_regionkey and n_nationkey between 3 and 15")
def scan_filter(spark, sf_dir):
    """Column pruning and a filter that reaches the scan."""
    n = table(spark, sf_dir, "nation").where(F.col("n_nationkey").between(3, 15)).select("n_name", "n_regionkey")
    return n.join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, sf_dir):
    """Tumbling windows, as the stream makes them."""
    return ingest.event_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("select event_type, event_id, ts from (select event_type, event_id, ts, row_number() over (partition by event_type order by ts, event_id) as k from events) where k <= 10")
def first_steps(spark, sf_dir):
    """The first ten time steps of each variable."""
    k = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_type", "event_id", "ts", k.alias("k")).where("k <= 10").drop("k")


@query("select doc_id, quality, row_number() over (partition by quality order by md5(doc_id::varchar), doc_id) <= 0.2 * count(*) over (partition by quality) as test from labels")
def stratified_split(spark, sf_dir):
    """A fifth of each class as test set, drawn by hash."""
    k = numbered(table(spark, sf_dir, "labels").select("doc_id", "quality", F.md5(F.col("doc_id").cast("string")).alias("h")), ["h", "doc_id"], "k", ("quality",))
    n = k.groupBy("quality").agg(F.count("*").alias("n"))
    return k.join(F.broadcast(n), "quality").select("doc_id", "quality", (F.col("k") + 1 <= 0.2 * F.col("n")).alias("test"))


@query(f"with {_CB} select c.k as customer, count(*) as n_centres from cb c join sb s on (s.x0 + s.x1) / 2 between c.x0 and c.x1 and (s.y0 + s.y1) / 2 between c.y0 and c.y1 group by all")
def content_validation(spark, sf_dir):
    """Expected centres that lie inside actual bounds."""
    c, s = _cb(spark, sf_dir)
    b = F.col("sb")
    x, y = (b["min_x"] + b["max_x"]) / 2, (b["min_y"] + b["max_y"]) / 2
    centres = s.withColumn("sb", F.struct(x.alias("min_x"), y.alias("min_y"), x.alias("max_x"), y.alias("max_y")))
    return spatial.box_join(c, centres, "b", "sb").groupBy("customer").agg(F.count("*").alias("n_centres"))


# Evaluation

_EV = "ev as (select l.doc_id, u.name, u.truth, ((d.n_chars * (case when u.name = 'quality' then 7 else 13 end)) % 101 / 100.0::double) as score from labels l join documents d on d.doc_id = l.doc_id cross join lateral (values ('quality', l.quality), ('toxic', l.toxic)) u(name, truth))"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels of each document with scores made by rule from its length."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").unpivot(["doc_id", "n_chars"], ["quality", "toxic"], "name", "truth")  # noqa: E741
    factor = F.when(F.col("name") == "quality", 7).otherwise(13)
    return l.select("doc_id", "name", "truth", (F.col("n_chars") * factor % 101 / 100.0).alias("score"))


_COUNTS = f"{_EV}, ct as (select name, count(*) filter (where score >= 0.5 and truth = 1) as tp, count(*) filter (where score >= 0.5 and truth = 0) as fp, count(*) filter (where score < 0.5 and truth = 1) as fn, count(*) filter (where score < 0.5 and truth = 0) as tn from ev group by all), lm as (select name, tp + fn as support, (tp + tn) / (tp + fp + fn + tn)::double as accuracy, coalesce(tp / nullif(tp + fp, 0)::double, 0) as \"precision\", coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as f1 from ct)"


@query(f'with {_COUNTS} select name, support, round(accuracy, 6) as accuracy, round("precision", 6) as "precision", round(recall, 6) as recall, round(f1, 6) as f1 from lm')
def label_metrics(spark, sf_dir):
    out = evaluation.label_metrics(scores(spark, sf_dir), F.lit(0.5), "name")
    return out.select("name", "support", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f'with {_COUNTS} select round(avg("precision"), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum("precision" * support) / sum(support), 6) as weighted_precision, round(sum(recall * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from lm')
def global_metrics(spark, sf_dir):
    out = evaluation.global_metrics(evaluation.label_metrics(scores(spark, sf_dir), F.lit(0.5), "name"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"with {_EV}, w as (select doc_id, sum(((score >= 0.5)::int <> truth)::int) as w, count(*) as n from ev group by all) select round(sum(w) / sum(n)::double, 6) as hamming, round(avg((w = 0)::int), 6) as subset_accuracy from w")
def subset_metrics(spark, sf_dir):
    out = evaluation.subset_metrics(scores(spark, sf_dir), F.lit(0.5), "doc_id")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"with {_EV}, r as (select name, truth, rank() over (partition by name order by score) + (count(*) over (partition by name, score) - 1) / 2.0::double as rk from ev) select name, round((sum(rk) filter (where truth = 1) - sum(truth) * (sum(truth) + 1) / 2) / (sum(truth) * (count(*) - sum(truth))), 6) as auroc from r group by all")
def auroc(spark, sf_dir):
    return evaluation.auroc(scores(spark, sf_dir), "name").withColumn("auroc", F.round("auroc", 6))


_CURVE = f"{_EV}, s as (select name, score, sum(truth) as p, sum(1 - truth) as n from ev group by all), cv as (select name, score, sum(p) over d as tp, sum(n) over d as fp, sum(p) over (partition by name) as np, sum(n) over (partition by name) as nn from s window d as (partition by name order by score desc rows unbounded preceding))"


@query(f'with {_CURVE} select name, score, tp::bigint as tp, fp::bigint as fp, round(tp / (tp + fp)::double, 6) as "precision", round(coalesce(tp / nullif(np, 0)::double, 0), 6) as recall, round(coalesce(fp / nullif(nn, 0)::double, 0), 6) as fpr from cv')
def pr_curve(spark, sf_dir):
    out = evaluation.curve(scores(spark, sf_dir), "name")
    return out.select("name", "score", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr")])


@query(f"with {_CURVE}, st as (select name, tp / (tp + fp)::double as pr, (tp - coalesce(lag(tp) over (partition by name order by score desc), 0)) / np::double as step from cv) select name, round(sum(pr * step), 6) as ap from st group by all")
def average_precision(spark, sf_dir):
    return evaluation.average_precision(scores(spark, sf_dir), "name").withColumn("ap", F.round("ap", 6))


@query(f"with {_CURVE}, f as (select name, score, 2 * (tp / (tp + fp)::double) * (tp / np::double) / (tp / (tp + fp)::double + tp / np::double + 1e-8) as f1 from cv) select name, score as threshold, round(f1, 6) as f1 from (select *, row_number() over (partition by name order by f1 desc, score desc) as k from f) where k = 1")
def optimal_threshold(spark, sf_dir):
    return evaluation.best_threshold(scores(spark, sf_dir), "name").withColumn("f1", F.round("f1", 6))


@query(f"with {_EV} select name, sum(truth)::bigint as n, round(100.0 * sum(truth) / count(*), 4) as pct from ev group by all")
def label_distribution(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("name").agg(F.sum("truth").alias("n"), F.round(100.0 * F.sum("truth") / F.count("*"), 4).alias("pct"))


@query("with m as (select p_type as method, avg(p_retailprice) as score, sum(p_size)::bigint as cost from part group by all), b as (select score from m order by method limit 1) select method, row_number() over (order by m.score desc, method) as place, round(m.score - b.score, 4) as gain, round(100 * (m.score - b.score) / b.score, 4) as gain_pct, round(cost / sum(cost) over ()::double, 6) as cost_share from m, b")
def method_ranking(spark, sf_dir):
    """Methods by score, gains over the first by name, and shares of the cost."""
    m = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("method")).agg(F.avg("p_retailprice").alias("score"), F.sum("p_size").cast("long").alias("cost"))
    b = m.agg(F.min_by("score", "method").alias("b"))
    whole = W.partitionBy(F.lit(0))
    gain = F.col("score") - F.col("b")
    return m.crossJoin(F.broadcast(b)).select("method", F.row_number().over(W.orderBy(F.desc("score"), "method")).alias("place"), F.round(gain, 4).alias("gain"), F.round(100 * gain / F.col("b"), 4).alias("gain_pct"), F.round(F.col("cost") / F.sum("cost").over(whole), 6).alias("cost_share"))


@query(f"with {_EV}, x as (select doc_id, name, truth, (score - 0.5) * 4 as z from ev), c as (select *, greatest(z, 0) - z * truth + ln(1 + exp(-abs(z))) as ce from x) select doc_id, name, round(0.25 * pow(1 - exp(-ce), 2) * ce, 6) as loss from c")
def focal_loss(spark, sf_dir):
    return scores(spark, sf_dir).select("doc_id", "name", F.round(evaluation.focal_loss(F.col("truth"), (F.col("score") - 0.5) * 4), 6).alias("loss"))


# Simplicial complexes

_FAC = "fac as (select * from (values (0, [0]), (1, [0]), (1, [1]), (2, [0, 1]), (3, [0, 1]), (3, [1, 2]), (3, [0, 2]), (4, [0, 1, 2]), (5, [0, 1]), (5, [1, 2]), (5, [2, 3]), (5, [0, 3])) t(complex_id, v))"


def facets(spark: SparkSession) -> DataFrame:
    """Point, two points, edge, loop, filled triangle, and the boundary of a square."""
    given = {0: [[0]], 1: [[0], [1]], 2: [[0, 1]], 3: [[0, 1], [1, 2], [0, 2]], 4: [[0, 1, 2]], 5: [[0, 1], [1, 2], [2, 3], [0, 3]]}
    return spark.createDataFrame([(k, v) for k, vs in given.items() for v in vs], "complex_id long, verts array<int>")


_CLOSED = f"{_FAC}, cl as (select distinct complex_id, list_filter(v, lambda x, i: (m >> (i - 1)) & 1 = 1) as verts from fac, range(1, 8) g(m) where m < 1 << len(v))"


@query(f"with {_CLOSED} select complex_id::bigint as complex_id, array_to_string(verts, ',') as verts from cl")
def facet_closure(spark, sf_dir):
    return simplicial.closure(facets(spark)).select("complex_id", F.array_join(F.transform("verts", lambda x: x.cast("string")), ",").alias("verts"))


@query(f"with {_CLOSED} select complex_id::bigint as complex_id, sum(case when len(verts) % 2 = 1 then 1 else -1 end)::bigint as chi, (max(len(verts)) - 1)::int as dim from cl group by all")
def euler_characteristic(spark, sf_dir):
    return simplicial.euler(simplicial.closure(facets(spark)))


@query()
def betti_mod2(spark, sf_dir):
    return simplicial.betti(simplicial.closure(facets(spark)))


@query()
def random_complex(spark, sf_dir):
    return simplicial.euler(simplicial.random_complex(spark, 20, 10, 0.5))


@query()
def eroded_complex(spark, sf_dir):
    whole = simplicial.closure(spark.range(10).select(F.col("id").alias("complex_id"), F.array(*map(F.lit, range(5))).alias("verts")))
    return simplicial.euler(simplicial.eroded(whole, 0.7, 4))


@query()
def forest_cv(spark, sf_dir):
    """F1 of a random forest on two halves of the vectors in turn: the other half is the training set."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    out = []
    for fold in range(2):
        model = RandomForestClassifier(numTrees=20, maxDepth=4, seed=7).fit(v.where(F.col("vec_id") % 2 != fold))
        rows = model.transform(v.where(F.col("vec_id") % 2 == fold)).select(F.lit(fold).alias("fold"), F.col("label").cast("int").alias("truth"), F.col("prediction").alias("score"))
        out.append(evaluation.label_metrics(rows, F.lit(0.5), "fold"))
    return out[0].unionByName(out[1])


@query()
def logistic_match(spark, sf_dir):
    """Probabilities of a logistic regression on the first features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.slice(F.col("embedding").cast("array<double>"), 1, 8)).alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    return LogisticRegression(maxIter=20, regParam=0.1).fit(v).transform(v).select("vec_id", F.round(vector_to_array("probability")[1], 4).alias("p"))


@query(f"""with {CELLS}, g as (select i // 16 as r, i % 16 as c, least(7, greatest(0, (i // 16 + 0.5) * 8 / 16 - 0.5))::double as y, least(7, greatest(0, (i % 16 + 0.5) * 8 / 16 - 0.5))::double as x from range(0, 256) t(i)),
q as (select r, c, floor(y)::int as y0, floor(x)::int as x0, y - floor(y) as fy, x - floor(x) as fx from g),
f as (select k.patch_id, k.label, q.r, q.c, sum(k.z * (case when k.r = y0 then 1 - fy else fy end) * (case when k.c = x0 then 1 - fx else fx end)) as z from q join cells k on k.r between y0 and y0 + 1 and k.c between x0 and x0 + 1 group by all),
d as (select label, case when r = 0 then lead(z) over v - z when r = 15 then z - lag(z) over v else (lead(z) over v - lag(z) over v) / 2 end as gy, case when c = 0 then lead(z) over h - z when c = 15 then z - lag(z) over h else (lead(z) over h - lag(z) over h) / 2 end as gx
  from f window v as (partition by patch_id, c order by r), h as (partition by patch_id, r order by c)),
s as (select label, pi() / 2 - atan(sqrt(gx * gx + gy * gy)) as sl, atan2(-gx, gy) as asp from d)
select label, round(avg(greatest(0, least(1, (sin(radians(45.0::double)) * sin(sl) + cos(radians(45.0::double)) * cos(sl) * cos(radians(135.0::double) - pi() / 2 - asp) + 1) / 2))), 6) as shade, count(*) as n from s group by all""")
def patch_resampled_hillshade(spark, sf_dir):
    """Hillshade of patches resampled to 16 x 16."""
    fine = raster.resampled(patches(spark, sf_dir), 16, 16)
    return raster.hillshade(raster.gradient(fine)).groupBy("label").agg(F.round(F.avg("shade"), 6).alias("shade"), F.count("*").alias("n"))
