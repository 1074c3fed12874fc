"""Queries over patches: raster and topology operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.operators import kernels, raster, topology
from talweg.plans.prelude import ACC, CELLS, DIST, FLOW, PAIRS, tree
from talweg.plans.registry import query
from talweg.sources.tables import cells, overlapping_windows, patches, table, window_grid

TAU = 2


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.merge_tree(patches(spark, sf_dir), TAU)


@query(f"""with recursive {tree()}, {DIST}, grouped as (select e.label, d.strahler, sum(d.n) as n from dist d join (select vec_id, label::int as label from embeddings) e on e.vec_id = d.patch_id group by all),
ratios as (select label, strahler, n, n / lead(n) over (partition by label order by strahler) as ratio from grouped)
select label, strahler, n::bigint as n, round(avg(ratio) over (partition by label), 6) as rb from ratios""")
def strahler_by_tile(spark, sf_dir):
    """Strahler-order distribution and Horton ratio per patch group."""
    dist = topology.distribution(nodes_of(spark, sf_dir), "label")
    return dist.join(topology.bifurcation(dist, "label"), "label").select("label", "strahler", "n", F.round("rb", 6).alias("rb"))


@query(f"with {CELLS} select patch_id, label, cell, r, c, round(z, 6) as z from cells")
def cells_explode(spark, sf_dir):
    return cells(patches(spark, sf_dir)).withColumn("z", F.round("z", 6))


@query("""select vec_id as patch_id, r0::int as r0, c0::int as c0 from embeddings, range(0, 6, 3) a(r0), range(0, 6, 3) b(c0)""")
def patch_windows(spark, sf_dir):
    return window_grid(patches(spark, sf_dir), 3).select("patch_id", "r0", "c0")


@query("""select vec_id as patch_id, r0::int as r0, c0::int as c0, concat('p_4_50_', (r0 // 2) * 3 + c0 // 2) as window_id from embeddings, range(0, 5, 2) a(r0), range(0, 5, 2) b(c0)""")
def windows_overlapping(spark, sf_dir):
    return overlapping_windows(patches(spark, sf_dir), 4, 0.5, "p").select("patch_id", "r0", "c0", "window_id")


@query(f"with {CELLS} select patch_id, (r - 2)::int as r, (c - 1)::int as c, round(z, 6) as z from cells where r between 2 and 4 and c between 1 and 3")
def window_read(spark, sf_dir):
    """A 3 x 3 window at row 2, column 1."""
    out = cells(patches(spark, sf_dir)).where(F.col("r").between(2, 4) & F.col("c").between(1, 3))
    return out.select("patch_id", (F.col("r") - 2).alias("r"), (F.col("c") - 1).alias("c"), F.round("z", 6).alias("z"))


@query(f"with {CELLS} select patch_id, (r - 2)::int as r, (c - 2)::int as c, round(z, 6) as z from cells where r between 2 and 5 and c between 2 and 5")
def centered_crop(spark, sf_dir):
    out = cells(patches(spark, sf_dir))
    off = (8 - 4) // 2
    return out.where(F.col("r").between(off, off + 3) & F.col("c").between(off, off + 3)).select("patch_id", (F.col("r") - off).alias("r"), (F.col("c") - off).alias("c"), F.round("z", 6).alias("z"))


@query(f"with {FLOW} select c.patch_id, c.cell, coalesce(f.code, -1) as code, f.recv from cells c left join flow f on f.patch_id = c.patch_id and f.cell = c.cell")
def d8_flow(spark, sf_dir):
    return kernels.flow(patches(spark, sf_dir)).select("patch_id", "cell", "code", "recv")


@query("""with p as (select l_orderkey, l_linenumber, (case l_quantity::int % 10 when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 8 when 4 then 16 when 5 then 32 when 6 then 64 when 7 then 128 when 8 then 0 else 5 end) as pointer from lineitem)
select l_orderkey, l_linenumber, pointer, case pointer when 64 then 7 when 128 then 0 when 1 then 1 when 32 then 6 when 2 then 2 when 16 then 5 when 8 then 4 when 4 then 3 when 0 then -1 end as code from p""")
def pointer_codes(spark, sf_dir):
    values = F.array(*map(F.lit, (1, 2, 4, 8, 16, 32, 64, 128, 0, 5)))
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.get(values, F.col("l_quantity").cast("int") % 10).alias("pointer"))
    return raster.codes_of_pointers(out)


@query(f"with recursive {ACC} select patch_id, cell, acc from acc")
def flow_accumulation(spark, sf_dir):
    return kernels.flow(patches(spark, sf_dir)).select("patch_id", "cell", "acc")


@query(f"with recursive {ACC} select patch_id, count(*) as n_mask, sum(acc)::bigint as mask_acc from acc where acc >= 2 group by all")
def channel_mask(spark, sf_dir):
    return kernels.flow(patches(spark, sf_dir)).where(F.col("acc") >= TAU).groupBy("patch_id").agg(F.count("*").alias("n_mask"), F.sum("acc").alias("mask_acc"))


@query(f"with recursive {tree()} select patch_id, cell, donors from dn where donors > 0")
def donor_counts(spark, sf_dir):
    flow = kernels.flow(patches(spark, sf_dir)).where(F.col("acc") >= TAU)
    # What flows in from masked cells is in the mask: accumulation rises downstream.
    return flow.where("recv is not null").groupBy("patch_id", F.col("recv").alias("cell")).agg(F.count("*").alias("donors"))


@query(f"with recursive {ACC} select patch_id, greatest(acc, 1)::double as tau from (select patch_id, acc, row_number() over (partition by patch_id order by acc desc) as k from acc) where k = 16")
def tau_kth(spark, sf_dir):
    return raster.kth_threshold(kernels.flow(patches(spark, sf_dir)), 16)


@query("""with t as (select c_custkey, (c_custkey % 360 - 180)::double as lon, (c_custkey % 120 - 60)::double as lat from customer)
select c_custkey, round(111.32 * cos(radians(lat + 0.5)) * 110.57, 6) as area_km2, round((111.32 * cos(radians(lat + 0.5)) / 64 + 110.57 / 64) / 2, 6) as cell_km,
  round_even(1.7319 * (111.32 * cos(radians(lat + 0.5)) * 110.57) / ((111.32 * cos(radians(lat + 0.5)) / 64 + 110.57 / 64) / 2), 0)::bigint as k from t""")
def tile_area(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") % 120 - 60).cast("double").alias("lat"))
    edges = (F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1)
    area, size = raster.tile_area_km2(*edges), raster.cell_size_km(*edges, F.lit(64), F.lit(64))
    return t.select("c_custkey", F.round(area, 6).alias("area_km2"), F.round(size, 6).alias("cell_km"), raster.density_rank(F.lit(1.7319), area, size).cast("long").alias("k"))


@query(f"""with recursive {ACC} select patch_id, cell, (cell // 8)::int as r, (cell % 8)::int as c, acc, not ((cell // 8) between 2 and 5 and (cell % 8) between 2 and 5) as outside
from (select patch_id, cell, acc, row_number() over (partition by patch_id order by acc desc, cell) as k from acc) where k = 1""")
def max_accum_cell(spark, sf_dir):
    """Dominant basin: the cell of greatest accumulation, and whether the centered 4 x 4 crop leaves it out."""
    # The greatest accumulation, and of equal ones the first cell in row order.
    top = kernels.flow(patches(spark, sf_dir)).groupBy("patch_id").agg(F.max_by(F.struct("cell", "r", "c", "acc"), F.struct("acc", -F.col("cell"))).alias("m"))
    return top.select("patch_id", "m.*").withColumn("outside", ~(F.col("r").between(2, 5) & F.col("c").between(2, 5)))


@query("select p_partkey, (p_size * 100)::bigint as full_cells, (p_partkey % 50 * 100)::bigint as run_cells, round(case when p_size = 0 then 1.0 else (p_partkey % 50) / p_size::double end, 6) as fraction from part")
def processed_fraction(spark, sf_dir):
    full, part = (F.col("p_size") * 100).cast("long"), (F.col("p_partkey") % 50 * 100).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", full.alias("full_cells"), part.alias("run_cells"), F.round(F.when(full == 0, 1.0).otherwise(part / full), 6).alias("fraction"))


@query(f"""with {CELLS}, o as (select a.v as dr, b.v as dc from range(-2, 3) a(v), range(-2, 3) b(v)),
spot as (select patch_id, cell, z, r + dr as rr, c + dc as cc from cells, o),
m as (select patch_id, cell, z, case when rr < 0 then -rr - 1 when rr >= 8 then 15 - rr else rr end as rr, case when cc < 0 then -cc - 1 when cc >= 8 then 15 - cc else cc end as cc from spot)
select m.patch_id, m.cell, round(sqrt(greatest(avg(k.z * k.z) - avg(k.z) * avg(k.z), 0)), 6) as rough from m join cells k on k.patch_id = m.patch_id and k.r = m.rr and k.c = m.cc group by all""")
def local_roughness(spark, sf_dir):
    return raster.local_roughness(patches(spark, sf_dir)).select("patch_id", "cell", F.round("rough", 6).alias("rough"))


_GRAD = f"""{CELLS}, g as (select patch_id, label, cell, r, c, z,
  case when r = 0 then lead(z) over v - z when r = 7 then z - lag(z) over v else (lead(z) over v - lag(z) over v) / 2 end as gy,
  case when c = 0 then lead(z) over h - z when c = 7 then z - lag(z) over h else (lead(z) over h - lag(z) over h) / 2 end as gx
  from cells window v as (partition by patch_id, c order by r), h as (partition by patch_id, r order by c))"""


@query(f"with {_GRAD} select patch_id, cell, round(gy, 6) as gy, round(gx, 6) as gx, round(sqrt(gx * gx + gy * gy), 6) as slope from g")
def gradient_slope(spark, sf_dir):
    out = raster.gradient(cells(patches(spark, sf_dir)))
    return out.select("patch_id", "cell", F.round("gy", 6).alias("gy"), F.round("gx", 6).alias("gx"), F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), 6).alias("slope"))


@query(f"""with {_GRAD}, s as (select *, pi() / 2 - atan(sqrt(gx * gx + gy * gy)) as sl, atan2(-gx, gy) as asp from g)
select patch_id, cell, round(greatest(0, least(1, (sin(radians(45.0::double)) * sin(sl) + cos(radians(45.0::double)) * cos(sl) * cos(radians(135.0::double) - pi() / 2 - asp) + 1) / 2)), 6) as shade from s""")
def hillshade(spark, sf_dir):
    return raster.hillshade(raster.gradient(cells(patches(spark, sf_dir)))).select("patch_id", "cell", F.round("shade", 6).alias("shade"))


_NORM = f"""{CELLS}, e as (select patch_id, quantile_cont(z, 0.02) as lo, quantile_cont(z, 0.98) as hi from cells group by all),
nm as (select c.*, greatest(0.0, least(1.0, (c.z - e.lo) / (case when e.hi <= e.lo then 1 else e.hi - e.lo end))) as norm from cells c join e on e.patch_id = c.patch_id)"""


@query(f"with {_NORM} select patch_id, cell, round(norm, 6) as norm from nm")
def robust_normalize(spark, sf_dir):
    return raster.normalized(cells(patches(spark, sf_dir))).select("patch_id", "cell", F.round("norm", 6).alias("norm"))


@query(f"""with {_NORM} select patch_id, cell, least(255, greatest(0, round_even(round(norm, 6) * 255, 0)))::int as level from nm""")
def geomorphic_uint8(spark, sf_dir):
    return raster.normalized(cells(patches(spark, sf_dir))).select("patch_id", "cell", raster.to_uint8(F.round("norm", 6)).alias("level"))


_TRENCH = f"""{CELLS}, lowest as (select patch_id, min(z) as low from cells group by all),
carved as (select c.patch_id, c.label, c.cell, c.r, c.c, case when c.r = c.c then least(c.z, l.low - 1.0::double * (c.r + 1) / 8) else c.z end as z from cells c join lowest l on l.patch_id = c.patch_id)"""


@query(f"with {_TRENCH} select patch_id, cell, round(z, 6) as z from carved")
def trench_carve(spark, sf_dir):
    return cells(raster.trench(patches(spark, sf_dir), 1.0)).select("patch_id", "cell", F.round("z", 6).alias("z"))


_CARVED = f"""{ACC},
lowest as (select patch_id, min(z) as low from cells group by all),
carved as (select c.patch_id, c.cell, c.r, c.c, case when c.r = c.c then least(c.z, l.low - 1.0::double * (c.r + 1) / 8) else c.z end as z from cells c join lowest l on l.patch_id = c.patch_id),
flow2 as (select patch_id, cell, code, recv from (
  select a.patch_id, a.cell, d.code, b.cell as recv, row_number() over (partition by a.patch_id, a.cell order by (a.z - b.z) / d.dist desc, d.code) as k
  from carved a cross join dirs d join carved b on b.patch_id = a.patch_id and b.r = a.r + d.dr and b.c = a.c + d.dc where a.z > b.z) where k = 1),
ways2 as (select patch_id, cell as src, cell as spot from carved union all select w.patch_id, w.src, f.recv from ways2 w join flow2 f on f.patch_id = w.patch_id and f.cell = w.spot),
drained2 as (select patch_id, spot as cell, count(*) as n from ways2 group by all),
acc2 as (select a.patch_id, a.cell, case when f.cell is not null or a.n > 1 then a.n else 0 end as acc, coalesce(f.code, -1) as code from drained2 a left join flow2 f on f.patch_id = a.patch_id and f.cell = a.cell)"""


def _carved_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patches(spark, sf_dir)
    after = kernels.flow(raster.trench(p, 1.0)).select("patch_id", "cell", F.col("acc").alias("acc2"), F.col("code").alias("code2"))
    return kernels.flow(p).select("patch_id", "cell", "acc", "code").join(after, ["patch_id", "cell"])


@query(f"with recursive {_CARVED} select a.patch_id, round(case when sum(a.acc) > 0 then sum(abs(b.acc - a.acc)) / (2.0 * sum(a.acc))::double end, 6) as moved from acc a join acc2 b on b.patch_id = a.patch_id and b.cell = a.cell group by all")
def mass_moved(spark, sf_dir):
    out = _carved_pair(spark, sf_dir).groupBy("patch_id").agg(F.sum(F.abs(F.col("acc2") - F.col("acc"))).alias("d"), F.sum("acc").alias("t"))
    return out.select("patch_id", F.round(F.when(F.col("t") > 0, F.col("d") / (2.0 * F.col("t"))), 6).alias("moved"))


@query(f"with recursive {_CARVED} select a.patch_id, count(*) filter (where a.code <> b.code) as flips from acc a join acc2 b on b.patch_id = a.patch_id and b.cell = a.cell group by all")
def receiver_flips(spark, sf_dir):
    return _carved_pair(spark, sf_dir).groupBy("patch_id").agg(F.count_if(F.col("code") != F.col("code2")).alias("flips"))


@query(f"""with recursive {tree(TAU)}, {PAIRS}, {_GRAD[len(CELLS) + 2:]}, k as (select a.patch_id, a.acc, c.z, row_number() over (partition by a.patch_id order by a.acc, a.cell) as k, count(*) over (partition by a.patch_id) as n from acc a join cells c on c.patch_id = a.patch_id and c.cell = a.cell),
own as (select patch_id, stddev_pop(z) / (max(z) - min(z)) as std_over_range, max(z) - min(z) as range, 2 * sum(k * acc)::double / (max(n) * sum(acc))::double - (max(n) + 1) / max(n)::double as gini,
  sum(acc) filter (where k > n - greatest(1, n // 100))::double / sum(acc)::double as top_share, max(acc) / max(n)::double as max_over_size, greatest(max(acc), 1) as amax, count(*) filter (where acc >= {TAU}) as channel_cells from k group by all),
rms as (select patch_id, sqrt(avg(gx * gx + gy * gy)) as rms from g group by all), fe as (select patch_id, count(*) as n_h0, quantile_cont(death - birth, 0.5) as median, max(death - birth) as greatest from pairs group by all),
ro as (select patch_id, count(*) as n_roots from nodes where parent is null group by all)
select o.patch_id, round(std_over_range, 6) as std_over_range, round(gini, 6) as gini, round(top_share, 6) as top_share, round(max_over_size, 6) as max_over_size, round(rms / range, 6) as grad_over_range, coalesce(n_h0, 0) as n_h0, coalesce(n_roots, 0) as n_roots,
  round(coalesce(median, 0) / amax, 6) as median_persistence, round(coalesce(greatest, 0) / amax, 6) as max_persistence, channel_cells, round(coalesce(n_roots, 0) / greatest(1, channel_cells)::double, 6) as roots_over_channel
from own o join rms on rms.patch_id = o.patch_id left join fe on fe.patch_id = o.patch_id left join ro on ro.patch_id = o.patch_id""")
def substrate_descriptors(spark, sf_dir):
    """Smoothness, concentration of accumulation, diagram and basin structure of each patch, without units."""
    p, nodes = patches(spark, sf_dir), nodes_of(spark, sf_dir)
    flow = kernels.flow(p)
    own = raster.descriptors(flow)
    sizes = flow.groupBy("patch_id").agg(F.greatest(F.max("acc"), F.lit(1)).alias("amax"), F.count_if(F.col("acc") >= TAU).alias("channel_cells"), (F.max("z") - F.min("z")).alias("range"))
    rms = raster.gradient(cells(p)).groupBy("patch_id").agg(F.sqrt(F.avg(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("rms"))
    life = F.col("death") - F.col("birth")
    features = topology.persistence_pairs(nodes).groupBy("patch_id").agg(F.count("*").alias("n_h0"), F.percentile(life, 0.5).alias("median"), F.max(life).alias("greatest"))
    roots = nodes.where("parent is null").groupBy("patch_id").agg(F.count("*").alias("n_roots"))
    whole = own.join(sizes, "patch_id").join(rms, "patch_id").join(features, "patch_id", "left").join(roots, "patch_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    return whole.select(
        "patch_id", *[F.round(c, 6).alias(c) for c in own.columns if c != "patch_id"], F.round(F.col("rms") / F.col("range"), 6).alias("grad_over_range"), count("n_h0").alias("n_h0"), count("n_roots").alias("n_roots"),
        F.round(count("median") / F.col("amax"), 6).alias("median_persistence"), F.round(count("greatest") / F.col("amax"), 6).alias("max_persistence"), "channel_cells", F.round(count("n_roots") / F.greatest(F.lit(1), "channel_cells"), 6).alias("roots_over_channel"),
    )


@query(f"""with {CELLS} select a.patch_id, round(corr(a.z, b.z), 6) as r, count(*) as n from cells a join cells b on b.patch_id = a.patch_id + 1 and b.cell = a.cell
where a.z > -10000 and b.z > -10000 group by all having count(*) >= 50""")
def elevation_corr(spark, sf_dir):
    """Correlation of each patch with the next one, from 50 joint cells on."""
    a = cells(patches(spark, sf_dir)).where("z > -10000")
    b = a.select((F.col("patch_id") - 1).alias("patch_id"), "cell", F.col("z").alias("z2"))
    return a.join(b, ["patch_id", "cell"]).groupBy("patch_id").agg(F.round(F.corr("z", "z2"), 6).alias("r"), F.count("*").alias("n")).where("n >= 50")


@query(f"""with {CELLS}, placed as (select patch_id, r + (patch_id % 3) * 4 as y, c + (patch_id // 3 % 3) * 4 as x, z, patch_id // 9 as sheet from cells)
select sheet, y, x, round(z, 6) as z, patch_id as source from (select *, row_number() over (partition by sheet, y, x order by patch_id) as k from placed) where k = 1""")
def mosaic_first(spark, sf_dir):
    """Overlapping patches on common sheets; of cells that meet, the first patch's stays."""
    p = F.col("patch_id")
    sheet = F.floor(p / 9).cast("long")
    placed = cells(patches(spark, sf_dir)).select(sheet.alias("sheet"), (F.col("r") + p % 3 * 4).alias("y"), (F.col("c") + F.floor(p / 3).cast("long") % 3 * 4).alias("x"), "z", p.alias("source"))
    return placed.groupBy("sheet", "y", "x").agg(F.min_by("z", "source").alias("z"), F.min("source").alias("source")).withColumn("z", F.round("z", 6))


@query(f"""with {CELLS}, g as (select i // 4 as r, i % 4 as c, i::int as cell from range(0, 16) t(i)),
q as (select e.vec_id as patch_id, g.cell, (g.r + 0.5) * 8 / 4 - 0.5 as y, (g.c + 0.5) * 8 / 4 - 0.5 as x from embeddings e, g),
f as (select *, floor(y)::int as y0, floor(x)::int as x0, y - floor(y) as fy, x - floor(x) as fx from q)
select f.patch_id, f.cell, round(sum(k.z * (case when k.r = y0 then 1 - fy else fy end) * (case when k.c = x0 then 1 - fx else fx end)), 6) as z
from f join cells k on k.patch_id = f.patch_id and k.r between y0 and y0 + 1 and k.c between x0 and x0 + 1 group by all""")
def resample_bilinear(spark, sf_dir):
    return raster.resampled(patches(spark, sf_dir), 4, 4).select("patch_id", "cell", F.round("z", 6).alias("z"))


@query(f"with {_GRAD}, s as (select patch_id, label, avg(sqrt(gx * gx + gy * gy)) as relief from g group by all) select label, patch_id, round(relief, 6) as relief from (select *, row_number() over (partition by label order by relief desc, patch_id) as k from s) where k = 1")
def highest_relief(spark, sf_dir):
    slope = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    relief = raster.gradient(cells(patches(spark, sf_dir))).groupBy("label", "patch_id").agg(F.avg(slope).alias("relief"))
    return relief.groupBy("label").agg(F.max_by(F.struct("patch_id", "relief"), F.struct("relief", -F.col("patch_id"))).alias("m")).select("label", "m.patch_id", F.round("m.relief", 6).alias("relief"))


# Topology


@query(f"with recursive {tree()} select patch_id, node, parent, is_head, birth, death from nodes")
def merge_tree_nodes(spark, sf_dir):
    return nodes_of(spark, sf_dir).select("patch_id", "node", "parent", "is_head", "birth", "death")


_MATCHED = tree("(select t.tau from taus t where t.patch_id = a.patch_id)", ACC + ", taus as (select patch_id, greatest(acc, 1) as tau from (select patch_id, acc, row_number() over (partition by patch_id order by acc desc) as k from acc) where k = 16)")


@query(f"with recursive {_MATCHED} select n.patch_id, n.node, n.parent, n.birth, n.death, o.strahler from nodes n join ord o on o.patch_id = n.patch_id and o.node = n.node")
def density_matched_tree(spark, sf_dir):
    """Each patch at its own threshold, the 16th greatest accumulation."""
    return kernels.merge_tree(patches(spark, sf_dir), kth=16).select("patch_id", "node", "parent", "birth", "death", "strahler")


@query(f"""with recursive {tree()}, {DIST}, {PAIRS}, rb as (select patch_id, avg(ratio) as rb from (select patch_id, n / lead(n) over (partition by patch_id order by strahler) as ratio from dist) group by all),
pp as (select patch_id, count(death) as n_finite, coalesce(max(death - birth), 0)::double as longest from pairs group by all), jj as (select patch_id, count(*) filter (where is_head) as leaves, count(*) filter (where not is_head) as junctions from nodes group by all)
select e.vec_id as patch_id, e.label::int as label, jj.leaves, jj.junctions, round(rb.rb, 6) as rb, pp.n_finite, pp.longest from embeddings e left join jj on jj.patch_id = e.vec_id left join rb on rb.patch_id = e.vec_id left join pp on pp.patch_id = e.vec_id""")
def patch_summary(spark, sf_dir):
    """One row for each patch from elevation to tree, diagram and ratios; a patch without a channel has nulls.

    The node table is joined to itself by patch only, and every side is one row a patch."""
    nodes = nodes_of(spark, sf_dir)
    rb = topology.bifurcation(topology.distribution(nodes, "patch_id"), "patch_id")
    stats = topology.persistence_statistics(topology.persistence_pairs(nodes), "patch_id").select("patch_id", "n_finite", "longest")
    out = patches(spark, sf_dir).select("patch_id", "label").join(topology.junctions(nodes, "patch_id").drop("roots"), "patch_id", "left").join(rb, "patch_id", "left").join(stats, "patch_id", "left")
    return out.select("patch_id", "label", "leaves", "junctions", F.round("rb", 6).alias("rb"), "n_finite", "longest")


@query(f"with recursive {tree()}, ids as (select patch_id, node, parent, row_number() over (partition by patch_id order by node) - 1 as segment from nodes) select a.patch_id, a.segment, b.segment as into_segment, 1 as edge_cells from ids a join ids b on b.patch_id = a.patch_id and b.node = a.parent")
def merge_tree_edges(spark, sf_dir):
    """Segment graph: nodes renumbered within the patch."""
    ids = nodes_of(spark, sf_dir).select("patch_id", "node", "parent", (F.row_number().over(W.partitionBy("patch_id").orderBy("node")) - 1).cast("long").alias("segment"))
    into = ids.select("patch_id", F.col("node").alias("parent"), F.col("segment").alias("into_segment"))
    return ids.join(into, ["patch_id", "parent"]).select("patch_id", "segment", "into_segment", F.lit(1).alias("edge_cells"))


@query(f"with recursive {tree()}, {PAIRS} select * from pairs")
def persistence_pairs(spark, sf_dir):
    return topology.persistence_pairs(nodes_of(spark, sf_dir)).drop("label")


@query(f"with recursive {tree()} select patch_id, node, strahler from ord")
def strahler_order(spark, sf_dir):
    return nodes_of(spark, sf_dir).select("patch_id", "node", "strahler")


@query(f"with recursive {tree()}, {DIST} select * from dist")
def strahler_distribution(spark, sf_dir):
    return topology.distribution(nodes_of(spark, sf_dir), "patch_id")


@query(f"with recursive {tree()} select patch_id, count(*) filter (where is_head) as leaves, count(*) filter (where not is_head) as junctions, count(*) filter (where parent is null) as roots from nodes group by all")
def junction_count(spark, sf_dir):
    return topology.junctions(nodes_of(spark, sf_dir), "patch_id")


@query(f"with recursive {tree()} select patch_id, root, n_below from (select n.patch_id, n.node as root, o.n_below, row_number() over (partition by n.patch_id order by o.n_below desc, n.node) as k from nodes n join old o on o.patch_id = n.patch_id and o.node = n.node where n.parent is null) where k = 1")
def largest_basin(spark, sf_dir):
    return topology.basins(nodes_of(spark, sf_dir)).drop("label")


_RB = "rb as (select patch_id, avg(ratio) as rb from (select patch_id, n / lead(n) over (partition by patch_id order by strahler) as ratio from dist) group by all)"


@query(f"with recursive {tree()}, {DIST}, {_RB} select patch_id, round(rb, 6) as rb from rb")
def bifurcation_ratio(spark, sf_dir):
    return topology.bifurcation(topology.distribution(nodes_of(spark, sf_dir), "patch_id"), "patch_id").withColumn("rb", F.round("rb", 6))


@query(f"""with recursive {tree()}, big as (select patch_id, root from (select n.patch_id, n.node as root, row_number() over (partition by n.patch_id order by o.n_below desc, n.node) as k from nodes n join old o on o.patch_id = n.patch_id and o.node = n.node where n.parent is null) where k = 1),
dist as (select o.patch_id, o.strahler, count(*) as n from ord o join rootof r on r.patch_id = o.patch_id and r.node = o.node join big b on b.patch_id = r.patch_id and b.root = r.root group by all), {_RB} select patch_id, round(rb, 6) as rb from rb""")
def bifurcation_ratio_largest(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    inside = nodes.join(topology.basins(nodes).select("patch_id", "root"), ["patch_id", "root"])
    return topology.bifurcation(topology.distribution(inside, "patch_id"), "patch_id").withColumn("rb", F.round("rb", 6))


@query(f"""with recursive {tree()}, {PAIRS} select patch_id, count(death) as n_finite, count(*) - count(death) as n_essential, coalesce(sum(death - birth), 0)::double as total, coalesce(max(death - birth), 0)::double as longest, round(coalesce(avg(death - birth), 0), 6) as mean from pairs group by all""")
def persistence_stats(spark, sf_dir):
    return topology.persistence_statistics(topology.persistence_pairs(nodes_of(spark, sf_dir)), "patch_id").withColumn("mean", F.round("mean", 6))


@query(f"""with recursive {tree()}, links as (select a.patch_id, a.cell, b.cell as other from mask a join mask b on b.patch_id = a.patch_id and a.cell <> b.cell and abs(a.cell // 8 - b.cell // 8) <= 1 and abs(a.cell % 8 - b.cell % 8) <= 1),
reach as (select patch_id, cell, cell as least from mask union select l.patch_id, l.other, r.least from reach r join links l on l.patch_id = r.patch_id and l.cell = r.cell),
comp as (select patch_id, count(*) filter (where cell = least) as c from (select patch_id, cell, min(least) as least from reach group by all) group by all),
ve as (select m.patch_id, (select count(*) from mask x where x.patch_id = m.patch_id) as v, (select count(*) // 2 from links x where x.patch_id = m.patch_id) as e from mask m group by all)
select v.patch_id, v.v, v.e, c.c as components, v.e - v.v + c.c as h1, 0::bigint as donor_h1 from ve v join comp c on c.patch_id = v.patch_id""")
def mask_h1(spark, sf_dir):
    """Loops of the mask over 8 neighbours, and along the flow, where there are none. Patches without a masked cell are left out."""
    return topology.mask_h1(patches(spark, sf_dir), TAU).where("v > 0")


@query(f"with {CELLS} select patch_id, count(*) as n, count(*) filter (where z is null or not isfinite(z)) as n_nodata, round(min(z), 6) as lo, round(max(z), 6) as hi, min(z) >= -500 and max(z) <= 9000 as in_range, count(*) * 8 < 1024 as too_small from cells group by all")
def raster_checks(spark, sf_dir):
    """Cells, nodata, range and size of each raster, from the patch row alone."""
    bad = F.size(F.filter("z", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    n = F.size("z")
    return patches(spark, sf_dir).select(
        "patch_id", n.cast("long").alias("n"), bad.cast("long").alias("n_nodata"), F.round(F.array_min("z"), 6).alias("lo"), F.round(F.array_max("z"), 6).alias("hi"), ((F.array_min("z") >= -500) & (F.array_max("z") <= 9000)).alias("in_range"), (n * 8 < 1024).alias("too_small")
    )


_STREAM = f"{tree(TAU)}, sc as (select n.patch_id, n.node as cell, n.node as segment from nodes n union all select w.patch_id, w.spot, w.node from walk w join dn d on d.patch_id = w.patch_id and d.cell = w.spot where d.donors = 1)"


@query(f"with recursive {_STREAM} select s.patch_id, s.cell, s.segment, o.strahler from sc s join ord o on o.patch_id = s.patch_id and o.node = s.segment")
def stream_raster(spark, sf_dir):
    """Channel cells with their segment and its Strahler order."""
    return kernels.stream_cells(patches(spark, sf_dir), TAU).drop("acc")


@query(f"with recursive {_STREAM} select s.patch_id, s.segment, count(*) as n_cells, string_agg(s.cell::varchar, ',' order by a.acc) as cells from sc s join acc a on a.patch_id = s.patch_id and a.cell = s.cell group by all")
def stream_segments(spark, sf_dir):
    """Segments as lines: their cells downstream, from a node to before the next."""
    line = F.array_sort(F.collect_list(F.struct("acc", "cell")))
    out = kernels.stream_cells(patches(spark, sf_dir), TAU).groupBy("patch_id", "segment").agg(F.count("*").alias("n_cells"), line.alias("line"))
    return out.select("patch_id", "segment", "n_cells", F.concat_ws(",", F.transform("line", lambda x: x["cell"].cast("string"))).alias("cells"))


@query()
def cubical_confluences(spark, sf_dir):
    return topology.cubical_confluences(patches(spark, sf_dir), TAU)


@query()
def superlevel_confluences(spark, sf_dir):
    return topology.cubical_confluences(patches(spark, sf_dir), descending=True)


@query()
def filled_flow(spark, sf_dir):
    """Depressions filled, then routed: cells whose flow stays inside the patch."""
    return kernels.flow(raster.filled(patches(spark, sf_dir))).groupBy("patch_id").agg(F.count_if(F.col("recv").isNull()).alias("outlets"), F.max("acc").alias("greatest"))


@query()
def breached_flow(spark, sf_dir):
    """Depressions breached by least-cost ways, then routed: cells whose flow stays inside the patch."""
    return kernels.flow(raster.conditioned(patches(spark, sf_dir), "breach")).groupBy("patch_id").agg(F.count_if(F.col("recv").isNull()).alias("outlets"), F.max("acc").alias("greatest"))


_MIRROR = "case when {i} < 0 then -{i} - 1 when {i} >= 8 then 15 - {i} else {i} end"


@query(f"""with {CELLS}, o as (select (i - 4)::int as d, exp(-0.5 * (i - 4) * (i - 4)) / (select sum(exp(-0.5 * (j - 4) * (j - 4))) from range(0, 9) t(j)) as w from range(0, 9) g(i))
select c.patch_id, c.cell, round(sum(a.w * b.w * k.z), 6) as z from cells c, o a, o b join cells k on k.patch_id = c.patch_id and k.r = {_MIRROR.format(i='(c.r + a.d)')} and k.c = {_MIRROR.format(i='(c.c + b.d)')} group by all""")
def smoothed_field(spark, sf_dir):
    return cells(raster.smoothed(patches(spark, sf_dir), 1.0)).select("patch_id", "cell", F.round("z", 6).alias("z"))


@query()
def noise_field(spark, sf_dir):
    return cells(raster.noisy(patches(spark, sf_dir), 0.1, 1.0)).select("patch_id", "cell", F.round("z", 6).alias("z"))


@query()
def phase_surrogate(spark, sf_dir):
    return cells(raster.phase_surrogate(patches(spark, sf_dir))).select("patch_id", "cell", F.round("z", 6).alias("z"))
