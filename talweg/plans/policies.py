"""Queries of geometry policies, key matching, catalogs, and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.functions import coords
from talweg.operators import quality, spatial
from talweg.plans.registry import query
from talweg.plans.relations import _AREA, _CB, _MEET, _SHARE, _cb
from talweg.sources import files
from talweg.sources.tables import boxes, table

_CRS = "case when {k} % 4 = 0 then 'EPSG:3857' else 'EPSG:4326' end"


@query(f"select count(*) as n, count(*) filter (where crs <> 'EPSG:4326') as n_offenders, coalesce(string_agg(n_name, ',' order by n_name) filter (where crs <> 'EPSG:4326'), '') as offenders, count(*) filter (where crs <> 'EPSG:4326') = 0 as passed from (select n_name, {_CRS.format(k='n_nationkey')} as crs from nation)")
def crs_policy(spark, sf_dir):
    """All frames are to be in one reference system; those that are not are named."""
    frames = table(spark, sf_dir, "nation").select(F.col("n_name").alias("frame"), F.when(F.col("n_nationkey") % 4 == 0, "EPSG:3857").otherwise("EPSG:4326").alias("crs"))
    return quality.policy(frames, "frame", F.col("crs") == "EPSG:4326")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' boxes, some missing, some without area, some turned about."""
    s = boxes(table(spark, sf_dir, "supplier"), "s_suppkey", "supplier")
    k, b = F.col("supplier"), F.col("b")
    turned = F.struct(b["max_x"].alias("min_x"), b["min_y"].alias("min_y"), b["min_x"].alias("max_x"), b["max_y"].alias("max_y"))
    flat = F.struct(b["min_x"].alias("min_x"), b["min_y"].alias("min_y"), b["min_x"].alias("max_x"), b["max_y"].alias("max_y"))
    return s.withColumn("b", F.when(k % 17 == 0, None).when(k % 13 == 0, flat).when(k % 11 == 0, turned).otherwise(b))


_DAMAGED = f"""{_CB}, dm as (select k, k % 17 = 0 as gone, case when k % 11 = 0 and k % 13 <> 0 then x1 else x0 end as x0, y0, case when k % 13 = 0 then x0 when k % 11 = 0 then x0 else x1 end as x1, y1 from sb),
st as (select *, case when gone then 'missing' when x1 < x0 or y1 < y0 then 'invalid' when x1 = x0 or y1 = y0 then 'empty' else 'valid' end as state from dm)"""


@query(f"with {_DAMAGED} select state, count(*) as n from st group by all")
def geometry_validity(spark, sf_dir):
    """Boxes that are missing, empty, invalid or valid."""
    return _damaged(spark, sf_dir).groupBy(spatial.box_state(F.col("b")).alias("state")).agg(F.count("*").alias("n"))


@query(f"with {_DAMAGED} select k as supplier, least(x0, x1) as x0, y0, greatest(x0, x1) as x1, y1 from st where state in ('valid', 'invalid')")
def geometry_repair(spark, sf_dir):
    """Boxes turned the right way; missing and empty ones go."""
    b = F.col("b")
    return spatial.repaired(_damaged(spark, sf_dir), "b").select("supplier", b["min_x"].alias("x0"), b["min_y"].alias("y0"), b["max_x"].alias("x1"), b["max_y"].alias("y1"))


@query(f"with {_DAMAGED} select s_nationkey as nation, count(*) filter (where state = 'valid') as n_parts, count(*) filter (where state = 'valid') = 1 as contiguous from st join supplier on s_suppkey = k group by all")
def contiguity(spark, sf_dir):
    """Whether each nation has exactly one part with an area."""
    parts = _damaged(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation")), "supplier")
    n = F.count_if(spatial.box_state(F.col("b")) == "valid")
    return parts.groupBy("nation").agg(n.alias("n_parts"), (n == 1).alias("contiguous"))


_UNION = f"{_CB}, own as (select s_nationkey as nation, x0, y0, x1, y1 from sb join supplier on s_suppkey = k), un as (select distinct nation, x::int as x, y::int as y from own, range(0, 110) a(x), range(0, 110) b(y) where x >= x0 and x < x1 and y >= y0 and y < y1)"


def _nation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = boxes(table(spark, sf_dir, "supplier"), "s_suppkey", "supplier")
    return s.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation")), "supplier")


@query(f"with {_UNION} select nation, count(*)::double as area from un group by all")
def box_union(spark, sf_dir):
    """Area of the union of each nation's boxes, on the unit grid that they are snapped to."""
    cells = spatial.union_cells(_nation_boxes(spark, sf_dir), "b", "nation")
    return cells.groupBy("nation").agg(F.count("*").cast("double").alias("area"))


@query(f"""with {_UNION}, area as (select nation, count(*)::double as area from un group by all), hit as (select o.nation, count(*) as n from own o join cb v on o.x0 < v.x1 and v.x0 < o.x1 and o.y0 < v.y1 and v.y0 < o.y1 group by all)
select n_regionkey as province, sum(area) as area, round(sum(area) / sum(sum(area)) over (), 6) as share, coalesce(sum(n), 0)::bigint as n_overlaps, coalesce(sum(n), 0) = 0 as disjoint from nation join area on nation = n_nationkey left join hit using (nation) group by all""")
def province_coverage(spark, sf_dir):
    """Area and share of each province, and whether its parts are disjoint from the customers' boxes."""
    own = _nation_boxes(spark, sf_dir)
    area = spatial.union_cells(own, "b", "nation").groupBy("nation").agg(F.count("*").cast("double").alias("area"))
    held = boxes(table(spark, sf_dir, "customer"), "c_custkey", "customer").withColumnRenamed("b", "vb")
    hits = spatial.box_join(own, held, "b", "vb", strict=True).groupBy("nation").agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("province"))
    by = n.join(area, "nation").join(hits, "nation", "left").groupBy("province").agg(F.sum("area").alias("area"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_overlaps"))
    share = F.col("area") / F.sum("area").over(W.partitionBy(F.lit(0)))  # a row a province
    return by.select("province", "area", F.round(share, 6).alias("share"), "n_overlaps", (F.col("n_overlaps") == 0).alias("disjoint"))


@query(f"with {_CB} select c.k as customer, count(*) as n_near from cb c join sb s on c.x0 - 0.5 < s.x1 and s.x0 < c.x1 + 0.5 and c.y0 - 0.5 < s.y1 and s.y0 < c.y1 + 0.5 group by all")
def leakage_buffer(spark, sf_dir):
    """Customers' boxes that suppliers' come nearer than a buffer of half a unit."""
    c, s = _cb(spark, sf_dir)
    grown = c.withColumn("b", coords.grown(F.col("b"), 0.5))
    return spatial.box_join(grown, s, "b", "sb", strict=True).groupBy("customer").agg(F.count("*").alias("n_near"))


_CATALOG = f"""{_CB}, met as (select c.k as search, s.k as item, 1 + s.k % 3 as gsd, {_AREA} as shared from cb c join sb s on {_SHARE}), fine as (select search from met where gsd = 1 group by all)"""


@query(f"with {_CATALOG} select m.search, m.item, m.gsd::bigint as gsd, f.search is not null as by_gsd from met m left join fine f on f.search = m.search where f.search is null or m.gsd = 1")
def catalog_search(spark, sf_dir):
    """Items that meet each search's box at the wanted ground distance; searches without any take all that meet it."""
    c, s = _cb(spark, sf_dir)
    items = s.select(F.col("supplier").alias("item"), F.col("sb").alias("ib"), (1 + F.col("supplier") % 3).alias("gsd"))
    return spatial.catalog(c.withColumnRenamed("customer", "search"), items, "b", "ib", "search", F.col("gsd") == 1).select("search", "item", "gsd", "by_gsd")


_KEYS = "ids as (select p_partkey as n, concat('k', (p_partkey % 40)::varchar, case p_partkey % 5 when 0 then '' when 1 then '-13' when 2 then '-1' when 3 then '-x' else 'b' end) as id from part), want as (select distinct concat('k', (s_suppkey % 60)::varchar) as wanted from supplier)"


@query(f"with {_KEYS} select wanted, id from (select wanted, id, row_number() over (partition by wanted order by case when id = wanted then 0 when id = concat(wanted, '-13') then 1 when id = concat(wanted, '-1') then 2 else 3 end, n) as k from want join ids on starts_with(id, wanted)) where k = 1")
def key_match(spark, sf_dir):
    """For each key the exact id, then the id with -13, then with -1, then the first that starts with it."""
    suffix = F.element_at(F.array(*map(F.lit, ("", "-13", "-1", "-x", "b"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.concat(F.lit("k"), (F.col("p_partkey") % 40).cast("string"), suffix).alias("id"))
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), (F.col("s_suppkey") % 60).cast("string")).alias("wanted")).distinct()
    return spatial.prefix_match(wanted, ids, "wanted", "id", "n", ("-13", "-1"))


@query("select n_nationkey, case n_regionkey when 0 then 'south' when 1 then 'west' when 2 then 'east' else 'other' end as side from nation")
def map_lookup(spark, sf_dir):
    """A value by key from a map, with a default for keys that it has not."""
    names = F.create_map(*[F.lit(x) for pair in ((0, "south"), (1, "west"), (2, "east")) for x in pair])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.try_element_at(names, F.col("n_regionkey").cast("int")), F.lit("other")).alias("side"))


@query("select n_nationkey, n_name as name, [n_nationkey::bigint, n_regionkey::bigint] as keys, len(n_name)::bigint as size from nation")
def json_fields(spark, sf_dir):
    """Rows written as JSON and read back under a schema, nested fields and arrays included."""
    n = table(spark, sf_dir, "nation")
    body = F.to_json(F.struct(F.struct(F.col("n_name").alias("name"), F.length("n_name").alias("size")).alias("of"), F.array("n_nationkey", "n_regionkey").alias("keys")))
    read = F.from_json(body, "of struct<name:string,size:long>, keys array<long>")
    return n.select("n_nationkey", read.alias("x")).select("n_nationkey", "x.of.name", "x.keys", "x.of.size")


@query("select s_suppkey, concat(h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32]) as id from (select s_suppkey, md5(s_name) as h from supplier)")
def name_uuid(spark, sf_dir):
    """A name's digest in the form of an id, the same in every run."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", coords.digest_id(F.col("s_name")).alias("id"))


@query("select s_nationkey, count(*) as n, round(sum(s_acctbal), 2) as balance from supplier group by all")
def csv_scan(spark, sf_dir):
    """A table written as CSV and scanned under a schema."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    schema = "s_suppkey long, s_nationkey " + dict(t.dtypes)["s_nationkey"] + ", s_acctbal double"
    path = files.written(t, "csv", header=True)
    return files.read_csv(spark, path, schema).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query(f"with {_CB} select s.k as supplier, c.k as customer from sb s join cb c on {_MEET} where c.x0 >= s.x0 and c.x1 <= s.x1 + 4 and c.y0 >= s.y0 and c.y1 <= s.y1 + 4")
def boxes_within(spark, sf_dir):
    """Boxes that lie inside another, grown by four units to the east and north."""
    c, s = _cb(spark, sf_dir)
    b, o = F.col("b"), F.col("sb")
    inside = (b["min_x"] >= o["min_x"]) & (b["max_x"] <= o["max_x"] + 4) & (b["min_y"] >= o["min_y"]) & (b["max_y"] <= o["max_y"] + 4)
    return spatial.box_join(c, s, "b", "sb").where(inside).select("supplier", "customer")
