"""Queries of two-sample statistics and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.operators import diagrams, topology, twosample
from talweg.operators.ranking import numbered
from talweg.plans.prelude import DIST, PAIRS, tree
from talweg.plans.registry import query
from talweg.plans.shapes import pairs_of
from talweg.plans.terrain import nodes_of
from talweg.sources.files import cut
from talweg.sources.tables import patches, table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("tile"), F.col("embedding").alias("x"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return twosample.block_pairs(cut(twosample.vector_blocks(v, v.count())))


def sums_of(spark: SparkSession, sf_dir: str, kind: str = "gauss") -> DataFrame:
    p = pairs(spark, sf_dir)
    return twosample.block_sums(p, twosample.median_sigma(p) if kind == "gauss" else 1.0, kind)


def sizes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("n_items"))


def tiles_of(spark: SparkSession, sf_dir: str) -> list[int]:
    """The tiles, few beside their items."""
    return [r["tile"] for r in sizes_of(spark, sf_dir).orderBy("tile").collect()]


def splits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced splits of all tiles."""
    return spark.createDataFrame(twosample.balanced_splits(tiles_of(spark, sf_dir)), "split int, tile long, side string")


#: Tiles of a second population have the numbers of the first, and this more for each population.
POPULATION = 1 << 20


def moved(v: DataFrame, population: int, amount: float) -> DataFrame:
    """Another population: each vector with `amount` added to every second of its numbers, under new ids and tiles."""
    shift = F.transform("x", lambda x, k: F.when(k % 2 == 0, x + amount).otherwise(x))
    return v.select((F.col("id") + (population << 40)).alias("id"), (F.col("tile") + population * POPULATION).alias("tile"), shift.alias("x"))


def populations(spark: SparkSession, sf_dir: str, amounts: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """(block sums, sizes) of the vectors and of populations moved by `amounts`; the bandwidth is that of the vectors."""
    v, p = vectors(spark, sf_dir), pairs(spark, sf_dir)
    n, sigma = v.count(), twosample.median_sigma(p)
    sums, v = [cut(twosample.block_sums(p, sigma))], v.withColumn("x", F.col("x").cast("array<double>"))
    every = [v, *[moved(v, k + 1, amount) for k, amount in enumerate(amounts)]]
    for other in every[1:]:
        # One population at a time, so that the blocks sent are those of two.
        blocks = cut(reduce(DataFrame.unionByName, [twosample.vector_blocks(x, n, population=k, populations=2) for k, x in enumerate((v, other))]))
        sums.append(cut(twosample.block_sums(twosample.block_pairs(blocks, 2, first=False), sigma), blocks))
    return reduce(DataFrame.unionByName, sums), reduce(DataFrame.unionByName, every).groupBy("tile").agg(F.count("*").alias("n_items"))


def against_moved(splits: DataFrame, population: int | Column) -> DataFrame:
    """The splits with side a taken from another population."""
    return splits.withColumn("tile", F.when(F.col("side") == "a", F.col("tile") + population * POPULATION).otherwise(F.col("tile")))


_D = "v as (select vec_id as id, label::bigint as tile, list_transform(embedding, lambda x: x::double) as x from embeddings), pd as (select a.id as i, b.id as j, a.tile as ta, b.tile as tb, sqrt(greatest(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x), 0)) as d, list_dot_product(a.x, b.x) as dot from v a join v b on a.id < b.id)"
_SIGMA = f"{_D}, sg as (select coalesce(quantile_cont(d, 0.5), 1.0) as sigma from pd where d > 0)"


def _sums(kernel: str) -> str:
    return f"{_SIGMA}, sums as (select least(ta, tb) as tile_a, greatest(ta, tb) as tile_b, sum({kernel}) as sum_k, count(*) as n from pd, sg group by all), sizes as (select tile, count(*) as n_items from v group by all)"


_GAUSS = _sums("exp(-(d * d) / (2 * sigma * sigma))")
_SPLITS = "tiles as (select tile, row_number() over (order by tile) - 1 as i from (select distinct tile from v)), split as (select m::int as split, t.tile, case when (m >> t.i) & 1 = 1 then 'a' else 'b' end as side from range(0, 1024) g(m), tiles t where bit_count(m) = 5)"


def _mmd(splits: str, key: str) -> str:
    return f"""pr as (select l.{key}, sum(case when l.side = 'a' and r.side = 'a' then s.sum_k else 0 end) as kaa, sum(case when l.side = 'b' and r.side = 'b' then s.sum_k else 0 end) as kbb, sum(case when l.side <> r.side then s.sum_k else 0 end) as kab
  from {splits} l join {splits} r on r.{key} = l.{key} and l.tile <= r.tile join sums s on s.tile_a = l.tile and s.tile_b = r.tile group by all),
nn as (select p.{key}, sum(case when side = 'a' then n_items else 0 end)::bigint as n_a, sum(case when side = 'b' then n_items else 0 end)::bigint as n_b from {splits} p join sizes z on z.tile = p.tile group by all),
mmd as (select pr.{key}, n_a, n_b, case when n_a > 1 and n_b > 1 then 2 * kaa / (n_a * (n_a - 1)) + 2 * kbb / (n_b * (n_b - 1)) - 2 * kab / (n_a * n_b) else 0 end as mmd2 from pr join nn on nn.{key} = pr.{key})"""


@query(f"with {_D} select i, j, round(d, 6) as d from pd")
def l2_pairs(spark, sf_dir):
    return twosample.pair_distances(pairs(spark, sf_dir), digits=6)


@query(f"""with recursive {tree()}, {PAIRS}, lab as (select vec_id as patch_id, label::int as label from embeddings), tp as (select l.label, p.birth, p.death from pairs p join lab l on l.patch_id = p.patch_id),
pr as (select a.label as i, b.label as j from (select distinct label from tp) a join (select distinct label from tp) b on a.label < b.label),
cap as (select i, j, coalesce(max(t.death) * 1.5, 1.0)::double as cap from pr left join tp t on t.label in (i, j) group by all),
pt as (select c.i, c.j, t.label = c.i as own, t.birth::double as x, coalesce(t.death, c.cap)::double as y from cap c join tp t on t.label in (c.i, c.j)),
ang as (select k, -pi() / 2 + k * pi() / 5 as t from range(0, 5) g(k)),
vals as (select i, j, k, true as side, case when own then x * cos(t) + y * sin(t) else (x + y) / 2 * (cos(t) + sin(t)) end as v from pt, ang union all select i, j, k, false, case when own then (x + y) / 2 * (cos(t) + sin(t)) else x * cos(t) + y * sin(t) end from pt, ang),
rk as (select *, row_number() over (partition by i, j, k, side order by v) as n from vals)
select l.i, l.j, round(sum(abs(l.v - r.v)) / 5, 3) as sw from rk l join rk r on r.i = l.i and r.j = l.j and r.k = l.k and r.n = l.n and l.side and not r.side group by all""")
def sw_matrix(spark, sf_dir):
    """Sliced Wasserstein between the pooled diagrams of every two tiles."""
    pooled = diagrams.points(pairs_of(spark, sf_dir).select(F.col("label").alias("patch_id"), "birth", "death"))
    duos = pooled.toDF("i", "a").join(pooled.toDF("j", "b"), F.col("i") < F.col("j"))
    return diagrams.sliced_wasserstein(duos, 5).select("i", "j", F.round("sw", 3).alias("sw"))


_POINTS = f"""{tree()}, {PAIRS}, item as (select vec_id as id, label::bigint as tile, coalesce(pts, []) as pts from embeddings left join (select patch_id, list({{'x': birth::double, 'y': death::double}}) as pts from pairs group by all) on patch_id = vec_id)"""
_SLICED = """duo as (select a.id as i, b.id as j, a.pts as a, b.pts as b, coalesce(greatest(list_max(list_transform(a.pts, lambda p: p.y)), list_max(list_transform(b.pts, lambda p: p.y))) * 1.5, 1.0) as cap from item a join item b on a.id < b.id),
ang as (select cos(t) as c, sin(t) as s from (select -pi() / 2 + k * pi() / 50 as t from range(0, 50) g(k))),
sides as (select i, j, list_sort(list_concat(list_transform(a, lambda p: p.x * c + coalesce(p.y, cap) * s), list_transform(b, lambda p: (p.x + coalesce(p.y, cap)) / 2 * (c + s)))) as u,
  list_sort(list_concat(list_transform(b, lambda p: p.x * c + coalesce(p.y, cap) * s), list_transform(a, lambda p: (p.x + coalesce(p.y, cap)) / 2 * (c + s)))) as v from duo, ang),
sw as (select i, j, sum(coalesce(list_sum(list_transform(list_zip(u, v), lambda z: abs(z[1] - z[2]))), 0)) / 50 as d from sides group by all)"""


def diagram_pairs(spark: SparkSession, sf_dir: str, eps: float = 0.0, found: DataFrame | None = None) -> DataFrame:
    """Pairs of blocks of the patches' diagrams, without the finite pairs shorter than eps."""
    found = diagrams.points(diagrams.pruned(pairs_of(spark, sf_dir) if found is None else found, eps))
    items = patches(spark, sf_dir).select("patch_id", "label").join(found, "patch_id", "left")
    points = F.coalesce("points", F.array().cast(found.schema["points"].dataType))
    items = diagrams.as_items(items.select(F.col("patch_id").alias("id"), F.col("label").cast("long").alias("tile"), points.alias("points")))
    items = cut(items)
    return twosample.block_pairs(cut(twosample.vector_blocks(items, items.count()), items))


@query(f"with recursive {_POINTS}, {_SLICED} select i, j, round(d, 4) as sw from sw")
def sw_items(spark, sf_dir):
    """Sliced Wasserstein distances over 50 directions between the diagrams of every two patches."""
    return twosample.pair_distances(diagram_pairs(spark, sf_dir), "sliced", 4).withColumnRenamed("d", "sw")


#: Distances of so many items, 1 GB of them, are kept for the passes of a test; those of more are worked out in each.
HELD_ITEMS = 16_384


def sliced_test(spark: SparkSession, sf_dir: str, eps: float, whole: DataFrame) -> DataFrame:
    """The test of one population of patches against another over their diagrams: floor, median, ratio, share above, p, verdict.

    The populations are the patches of even and of odd id, in the same tiles."""
    found = diagram_pairs(spark, sf_dir, eps, whole)
    odd = F.transform("ids_a", lambda i: i % 2), F.transform("ids_b", lambda i: i % 2)
    mark = lambda tiles, flags: F.zip_with(tiles, flags, lambda t, f: t + f * POPULATION)
    marked = found.withColumn("tiles_a", mark("tiles_a", odd[0])).withColumn("tiles_b", mark("tiles_b", odd[1]))
    marked.blocks = found.blocks
    n, metric = found.blocks.agg(F.sum(F.size("ids"))).first()[0] or 0, "sliced"
    if n <= HELD_ITEMS:
        marked, metric = twosample.held(marked, metric), "held"
    sums = cut(twosample.block_sums(marked, twosample.median_sigma(marked, metric), metric=metric), *([marked] if metric == "held" else []), found.blocks)
    sizes = vectors(spark, sf_dir).groupBy((F.col("tile") + F.pmod("id", F.lit(2)) * POPULATION).alias("tile")).agg(F.count("*").alias("n_items"))
    splits = splits_of(spark, sf_dir)
    null, test = (cut(twosample.mmd2(sums, x, sizes, "split")) for x in (splits, against_moved(splits, 1)))
    return twosample.against_null(test, null)


@query()
def pruning_rerun(spark, sf_dir):
    """Distances, bandwidth, null and test over diagrams pruned at 0 and at percentiles of the finite lengths, threshold by threshold."""
    shares = (0.1, 0.25, 0.5, 0.75, 0.9)
    whole = cut(pairs_of(spark, sf_dir))
    found = whole.where("death is not null").agg(F.percentile(F.col("death") - F.col("birth"), F.array(*map(F.lit, shares))).alias("q")).first()["q"]
    out = None
    for share, eps in zip((0.0, *shares), (0.0, *(found or [0.0] * len(shares))), strict=True):
        row = sliced_test(spark, sf_dir, eps, whole).select(F.lit(share).alias("share"), F.lit(float(eps)).alias("eps"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {_D} select ta % 2 + tb % 2 as kind, count(*) as n, round(avg(d), 6) as mean from pd group by all")
def population_blocks(spark, sf_dir):
    """Mean distances within and across two populations (even and odd tiles), as blocks of one matrix: 0 and 2 within, 1 across."""
    v = vectors(spark, sf_dir).withColumn("tile", F.col("tile") % 2)
    sums = twosample.block_sums(twosample.block_pairs(twosample.vector_blocks(v, v.count())), 1.0, "distance")
    return sums.select((F.col("tile_a") + F.col("tile_b")).alias("kind"), "n", F.round(F.col("sum_k") / F.col("n"), 6).alias("mean"))


@query(f"with {_SIGMA} select round(sigma, 6) as sigma from sg")
def median_sigma(spark, sf_dir):
    return spark.createDataFrame([(round(twosample.median_sigma(pairs(spark, sf_dir)), 6),)], "sigma double")


@query(f"with {_GAUSS} select tile_a, tile_b, round(sum_k, 5) as sum_k, n from sums")
def mmd2_blocks(spark, sf_dir):
    return sums_of(spark, sf_dir).withColumn("sum_k", F.round("sum_k", 5))


@query(f"with {_GAUSS}, {_SPLITS}, {_mmd('split', 'split')} select split, n_a, n_b, round(mmd2, 7) as mmd2 from mmd")
def spatial_null(spark, sf_dir):
    """All balanced splits of the tiles."""
    return twosample.mmd2(sums_of(spark, sf_dir), splits_of(spark, sf_dir), sizes_of(spark, sf_dir), "split").withColumn("mmd2", F.round("mmd2", 7))


_SIZED = "tiles as (select tile, row_number() over (order by tile) - 1 as i from (select distinct tile from v)), ks as (select bit_count(a)::int as k, a, b, (bit_count(a) * 1048576 + a * 1024 + b)::int as split from range(1, 1024) x(a), range(1, 1024) y(b) where a & b = 0 and bit_count(a) = bit_count(b) and bit_count(a) <= 5), sz as (select split, t.tile, case when (a >> t.i) & 1 = 1 then 'a' else 'b' end as side from ks, tiles t where ((a | b) >> t.i) & 1 = 1)"


@query(f"""with {_GAUSS}, {_SIZED}, {_mmd('sz', 'split')} select k.k, count(*) as reps, round(avg((n_a + n_b) / 2), 6) as side_mean, min(least(n_a, n_b)) as side_min, round(quantile_cont(mmd2, 0.5), 6) as median, round(quantile_cont(mmd2, 0.95), 6) as p95, round(max(mmd2), 6) as greatest
from mmd join ks k on k.split = mmd.split group by k.k""")
def power_curve(spark, sf_dir):
    """The null of K tiles against K others for K up to half the number of tiles; the SQL is for ten tiles."""
    tiles = tiles_of(spark, sf_dir)
    rows = [(k, *x) for k in range(1, len(tiles) // 2 + 1) for x in twosample.sized_splits(tiles, k)]
    splits = spark.createDataFrame(rows, "k int, split int, tile long, side string")
    null = twosample.mmd2(cut(sums_of(spark, sf_dir)), splits, sizes_of(spark, sf_dir), "k", "split")
    return twosample.null_summary(null, "k").select("k", "reps", "side_min", *[F.round(c, 6).alias(c) for c in ("side_mean", "median", "p95", "greatest")])


def _moved_sql(amounts: tuple[float, ...]) -> str:
    """The SQL of populations(): v holds all, sg the bandwidth of the first."""
    more = " union all ".join(f"select id + ({k + 1}::bigint << 40), tile + {(k + 1) * POPULATION}, list_transform(x, lambda e, i: case when i % 2 = 1 then e + {amount} else e end) from v0" for k, amount in enumerate(amounts))
    d = "sqrt(greatest(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x), 0))"
    return f"""v0 as (select vec_id as id, label::bigint as tile, list_transform(embedding, lambda e: e::double) as x from embeddings), v as (select id, tile, x from v0 union all {more}),
sg as (select coalesce(quantile_cont(d, 0.5), 1.0) as sigma from (select {d} as d from v0 a join v0 b on a.id < b.id) where d > 0), pd as (select a.tile as ta, b.tile as tb, {d} as d from v a join v b on a.id < b.id),
sums as (select least(ta, tb) as tile_a, greatest(ta, tb) as tile_b, sum(exp(-(d * d) / (2 * sigma * sigma))) as sum_k, count(*) as n from pd, sg group by all), sizes as (select tile, count(*) as n_items from v group by all),
tiles as (select tile, row_number() over (order by tile) - 1 as i from (select distinct tile from v0)), split as (select m::int as split, t.tile, case when (m >> t.i) & 1 = 1 then 'a' else 'b' end as side from range(0, 1024) g(m), tiles t where bit_count(m) = 5)"""


_AMOUNTS = (0.002, 0.005, 0.01, 0.02)
_TEST = f"tsplit as (select split, case when side = 'a' then tile + {POPULATION} else tile end as tile, side from split)"


@query(f"""with {_moved_sql((0.01,))}, {_TEST}, {_mmd('split', 'split')}, {_mmd('tsplit', 'split').replace('pr as', 'tpr as').replace('nn as', 'tnn as').replace('mmd as', 'test as').replace('from pr join nn on nn.split = pr.split', 'from tpr pr join tnn nn on nn.split = pr.split')},
f as (select quantile_cont(mmd2, 0.95) as floor from mmd), m as (select quantile_cont(mmd2, 0.5) as median from test)
select round(floor, 6) as floor, round(median, 6) as median, round(median / floor, 4) as ratio, round((select avg((mmd2 > floor)::int) from test, f), 6) as above, round((select avg((mmd2 >= median)::int) from mmd, m), 6) as p, median > floor as rejected from f, m""")
def test_vs_null(spark, sf_dir):
    """A second population's tiles against the first's, split by split, beside the null of the first against itself."""
    sums, sizes = populations(spark, sf_dir, (0.01,))
    splits = splits_of(spark, sf_dir)
    null, test = (cut(twosample.mmd2(sums, x, sizes, "split")) for x in (splits, against_moved(splits, 1)))
    out = twosample.against_null(test, null)
    return out.select(F.round("floor", 6).alias("floor"), F.round("median", 6).alias("median"), F.round("ratio", 4).alias("ratio"), F.round("above", 6).alias("above"), F.round("p", 6).alias("p"), "rejected")


@query(f"with {_sums('pow(dot / 64 + 1, 3)')}, {_SPLITS}, {_mmd('split', 'split')} select split, round(mmd2 * 10000, 3) + 0.0 as kid from mmd")
def kid(spark, sf_dir):
    out = twosample.mmd2(sums_of(spark, sf_dir, "cubic"), splits_of(spark, sf_dir), sizes_of(spark, sf_dir), "split")
    return out.select("split", (F.round(F.col("mmd2") * 10000, 3) + 0.0).alias("kid"))


@query(f"""with {_GAUSS}, prov as (select distinct tile, tile % 3 as p from v), duo as (select a.p * 10 + b.p as duo, a.p as pa, b.p as pb from (select distinct p from prov) a, (select distinct p from prov) b where a.p < b.p),
sp as (select duo, tile, case when p = pa then 'a' else 'b' end as side from duo join prov on p in (pa, pb)), {_mmd('sp', 'duo')} select duo::bigint as duo, n_a, n_b, round(mmd2, 7) as mmd2 from mmd""")
def province_pairs(spark, sf_dir):
    """MMD2 between every two provinces (tile modulo 3)."""
    tiles = sizes_of(spark, sf_dir).select("tile", (F.col("tile") % 3).alias("p"))
    provinces = tiles.select("p").distinct()
    duos = provinces.select(F.col("p").alias("pa")).join(provinces.select(F.col("p").alias("pb")), F.col("pa") < F.col("pb")).withColumn("duo", F.col("pa") * 10 + F.col("pb"))
    splits = duos.join(tiles, (F.col("p") == F.col("pa")) | (F.col("p") == F.col("pb"))).select("duo", "tile", F.when(F.col("p") == F.col("pa"), "a").otherwise("b").alias("side"))
    return twosample.mmd2(sums_of(spark, sf_dir), splits, sizes_of(spark, sf_dir), "duo").withColumn("mmd2", F.round("mmd2", 7))


_LEFT = "tiles as (select tile, row_number() over (order by tile) - 1 as i from (select distinct tile from v)), size as (select (count(*) - 1) // 2 as k, count(*) as n from tiles), ks as (select a, b, (a * 1024 + b)::int as split from size, range(1, 1024) x(a), range(1, 1024) y(b) where a & b = 0 and bit_count(a) = k and bit_count(b) = k and (a | b) < (1 << n)), sz as (select split, t.tile, case when (a >> t.i) & 1 = 1 then 'a' else 'b' end as side from ks, tiles t where ((a | b) >> t.i) & 1 = 1)"


@query(f"""with {_GAUSS}, {_LEFT}, {_mmd('sz', 'split')}, loo as (select t.tile, quantile_cont(m.mmd2, 0.95) as p95 from tiles t join ks on ((a | b) >> t.i) & 1 = 0 join mmd m on m.split = ks.split group by all)
select count(*) as n, round(min(p95), 6) as least, round(max(p95), 6) as greatest, round(avg(p95), 6) as mean, round(stddev_samp(p95), 7) as sd from loo""")
def jackknife(spark, sf_dir):
    """95th percentile of the null over splits of K against K other tiles, K as large as fits without one tile, tile by tile, and its spread."""
    tiles = tiles_of(spark, sf_dir)
    rows = [(t, *x) for t in tiles for x in twosample.sized_splits([o for o in tiles if o != t], (len(tiles) - 1) // 2)]
    splits = spark.createDataFrame(rows, "left_out long, split int, tile long, side string")
    null = twosample.mmd2(sums_of(spark, sf_dir), splits, sizes_of(spark, sf_dir), "left_out", "split")
    by_tile = null.groupBy("left_out").agg(F.percentile("mmd2", 0.95).alias("p95"))
    return by_tile.agg(F.count("*").alias("n"), F.round(F.min("p95"), 6).alias("least"), F.round(F.max("p95"), 6).alias("greatest"), F.round(F.avg("p95"), 6).alias("mean"), F.round(F.stddev_samp("p95"), 7).alias("sd"))


@query(f"""with {_D}, w as (select d, ta = tb as same from pd) select round(avg(d) filter (where not same) / avg(d) filter (where same), 6) as mean_ratio, round(quantile_cont(d, 0.5) filter (where not same) / quantile_cont(d, 0.5) filter (where same), 6) as median_ratio from w""")
def raw_movement(spark, sf_dir):
    """Distances across tiles over those within."""
    p = pairs(spark, sf_dir)
    within = F.col("tile_a") == F.col("tile_b")
    mean = lambda c: F.sum(F.when(c, F.col("sum_k"))) / F.sum(F.when(c, F.col("n")))
    middle = twosample.distance_quantiles(p, 0.5, "tiles", positive=False)
    median = round(middle[0] / middle[1], 6) if len(middle) == 2 else None
    return twosample.block_sums(p, 1.0, "distance").agg(F.round(mean(~within) / mean(within), 6).alias("mean_ratio")).withColumn("median_ratio", F.lit(median).cast("double"))


@query(f"""with recursive {tree()}, {PAIRS}, e as (select quantile_cont(death - birth, [0.1, 0.25, 0.5, 0.75, 0.9]) as q from pairs where death is not null), lv as (select i::int as level, q[i + 1] as eps from e, range(0, 5) g(i))
select l.level, round(l.eps, 6) as eps, count(*) filter (where death is null or death - birth >= l.eps) as kept from pairs, lv l group by all""")
def pruning_sweep(spark, sf_dir):
    """What stays of all diagrams at thresholds from the percentiles of finite lengths."""
    p = pairs_of(spark, sf_dir)
    levels = p.where("death is not null").agg(F.percentile(F.col("death") - F.col("birth"), F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q")).select(F.posexplode("q").alias("level", "eps"))
    kept = F.count_if(F.col("death").isNull() | (F.col("death") - F.col("birth") >= F.col("eps")))
    return p.crossJoin(F.broadcast(levels)).groupBy("level", "eps").agg(kept.alias("kept")).withColumn("eps", F.round("eps", 6))


_REPS = 2000


@query(f"""with {_GAUSS}, {_SPLITS}, {_mmd('split', 'split')}, vals as (select mmd2, row_number() over (order by split) - 1 as i, count(*) over () as n from mmd),
draws as (select rep, ('0x' || md5(rep || ',' || k)[1:8])::bigint % n as i from range(0, {_REPS}) r(rep), (select distinct n from vals), range(0, (select count(*) from mmd)) k(k)),
p as (select rep, quantile_cont(mmd2, 0.95) as p95 from draws join vals using (i) group by all)
select round(quantile_cont(p95, 0.025), 6) as low, round(quantile_cont(p95, 0.975), 6) as high, count(*) as reps from p""")
def bootstrap_ci(spark, sf_dir):
    """Interval of the null's 95th percentile over resamples of all its values with replacement, drawn by a hash."""
    null = twosample.mmd2(sums_of(spark, sf_dir), splits_of(spark, sf_dir), sizes_of(spark, sf_dir), "split")
    p = twosample.resampled(null, _REPS, ["split"]).groupBy("rep").agg(F.percentile("mmd2", 0.95).alias("p95"))
    return p.agg(F.round(F.percentile("p95", 0.025), 6).alias("low"), F.round(F.percentile("p95", 0.975), 6).alias("high"), F.count("*").alias("reps"))


@query(f"""with {_moved_sql(_AMOUNTS)}, lv as (select l::int as level from range(0, {len(_AMOUNTS)}) g(l)),
every as (select -1 as level, split, tile, side from split union all select level, split, case when side = 'a' then tile + (level + 1) * {POPULATION} else tile end, side from split, lv), keyed as (select (level + 1) * 4096 + split as spot, tile, side from every), {_mmd('keyed', 'spot')},
f as (select quantile_cont(mmd2, 0.95) as floor from mmd where spot < 4096), t as (select (spot // 4096 - 1)::int as level, quantile_cont(mmd2, 0.5) as median from mmd where spot >= 4096 group by 1)
select level, round(median / floor, 4) as ratio, median / floor >= 1 as reached, coalesce(level = (select min(level) from t, f where median >= floor), false) as first_reached from t, f""")
def effect_curve(spark, sf_dir):
    """Perturbed tiles against others, level by level: the median over the null's 95th percentile, whether it reaches it, and the first level that does."""
    sums, sizes = populations(spark, sf_dir, _AMOUNTS)
    splits = splits_of(spark, sf_dir)
    levels = spark.range(len(_AMOUNTS)).select(F.col("id").cast("int").alias("level"))
    floor = twosample.mmd2(sums, splits, sizes, "split").agg(F.percentile("mmd2", 0.95).alias("floor"))
    test = twosample.mmd2(sums, against_moved(splits.crossJoin(F.broadcast(levels)), F.col("level") + 1), sizes, "level", "split")
    t = test.groupBy("level").agg(F.percentile("mmd2", 0.5).alias("median")).crossJoin(F.broadcast(floor)).select("level", (F.col("median") / F.col("floor")).alias("r"))
    first = F.min(F.when(F.col("r") >= 1, F.col("level"))).over(W.partitionBy(F.lit(0)))  # a row a level
    return t.select("level", F.round("r", 4).alias("ratio"), (F.col("r") >= 1).alias("reached"), F.coalesce(F.col("level") == first, F.lit(False)).alias("first_reached"))


@query()
def frechet_distance(spark, sf_dir):
    """Between the vectors of even and odd tiles."""
    v = vectors(spark, sf_dir)
    (_, ma, ca), (_, mb, cb) = (twosample.moments(v.where(F.col("tile") % 2 == k), 64) for k in (0, 1))
    return spark.createDataFrame([(twosample.frechet(ma, ca, mb, cb),)], "distance double")


# Summaries of forests by tile


_FOREST = f"""{tree()}, {DIST}, lab as (select vec_id as patch_id, label::int as label from embeddings),
per as (select n.patch_id, l.label, count(*) filter (where not is_head) as junctions, count(*) filter (where is_head) as leaves from nodes n join lab l on l.patch_id = n.patch_id group by all)"""


def per_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(spark, sf_dir).groupBy("patch_id", "label").agg(F.count_if(~F.col("is_head")).alias("junctions"), F.count_if("is_head").alias("leaves"))


@query(f"""with recursive {_FOREST}, a as (select l.label, d.strahler::double as x, sum(d.n) as wa from dist d join lab l on l.patch_id = d.patch_id group by all), t as (select strahler::double as x, sum(n) as wb from dist group by all),
g as (select lb.label, t.x, coalesce(a.wa, 0) as wa, t.wb from (select distinct label from lab) lb cross join t left join a on a.label = lb.label and a.x = t.x),
s as (select label, x, wa / sum(wa) over (partition by label) as sa, wb / sum(wb) over (partition by label) as sb from g),
c as (select label, abs(sum(sa) over (partition by label order by x) - sum(sb) over (partition by label order by x)) * (lead(x) over (partition by label order by x) - x) as gap from s)
select label, round(coalesce(sum(gap), 0), 6) as w1 from c group by all""")
def strahler_w1(spark, sf_dir):
    """Distance of each tile's order distribution from that of all tiles."""
    dist = topology.distribution(nodes_of(spark, sf_dir), "label")
    whole = dist.groupBy("strahler").agg(F.sum("n").alias("b"))
    tiles = dist.select("label").distinct()
    grid = tiles.crossJoin(F.broadcast(whole)).join(dist.withColumnRenamed("n", "a"), ["label", "strahler"], "left")
    return topology.wasserstein1(grid, "a", "b", "strahler", "label").withColumn("w1", F.round("w1", 6))


@query(f"""with recursive {_FOREST}, st as (select label, sum(junctions)::bigint as junctions, sum(leaves)::bigint as leaves from per group by all) select a.label, b.label as other, b.junctions - a.junctions as d_junctions, round(abs(b.junctions - a.junctions) / greatest(a.junctions, 1)::double, 6) as shift, round(b.leaves / a.leaves::double, 6) as leaf_ratio from st a join st b on b.label = a.label + 1""")
def branching_compare(spark, sf_dir):
    """Each tile's branching beside the next one's."""
    st = per_patch(spark, sf_dir).groupBy("label").agg(F.sum("junctions").alias("junctions"), F.sum("leaves").alias("leaves"))
    after = st.select((F.col("label") - 1).alias("label"), F.col("label").alias("other"), F.col("junctions").alias("j2"), F.col("leaves").alias("l2"))
    change = topology.branching_shift(F.col("junctions"), F.col("j2"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.0), F.lit(1))
    return st.join(after, "label").select("label", "other", (F.col("j2") - F.col("junctions")).alias("d_junctions"), F.round(change, 6).alias("shift"), F.round(F.col("l2") / F.col("leaves"), 6).alias("leaf_ratio"))


_BRANCH = f"""{_FOREST}, dl as (select l.label, d.strahler, sum(d.n)::double as n from dist d join lab l on l.patch_id = d.patch_id group by all), rb as (select label, avg(ratio) as rb, max(strahler) as orders from (select label, strahler, n / lead(n) over (partition by label order by strahler) as ratio from dl) group by label),
st as (select p.label, sum(junctions)::bigint as junctions, any_value(r.rb) as rb, any_value(r.orders) as orders from per p join rb r on r.label = p.label group by all),
cum as (select a.label as la, b.label as lb, x, coalesce((select sum(n) from dl where label = a.label and strahler <= x), 0) / (select sum(n) from dl where label = a.label) as ca, coalesce((select sum(n) from dl where label = b.label and strahler <= x), 0) / (select sum(n) from dl where label = b.label) as cb
  from rb a join rb b on b.label = a.label + 1, range(1, 20) g(x)), w as (select la, sum(abs(ca - cb)) as w1 from cum group by all)"""


@query(f"""with recursive {_BRANCH} select a.label, b.label as other, round(w.w1, 6) as w1, round(abs(b.rb - a.rb), 6) as d_rb,
  round(greatest(abs(b.junctions - a.junctions) / greatest(a.junctions, 1)::double, abs(b.rb - a.rb) / a.rb, w.w1 / greatest(a.orders, 1)), 6) as shift from st a join st b on b.label = a.label + 1 join w on w.la = a.label""")
def branching_shift(spark, sf_dir):
    """The greatest relative change between each tile's branching and the next one's: junctions, ratio, and distance of orders by their number."""
    dist = topology.distribution(nodes_of(spark, sf_dir), "label")
    st = per_patch(spark, sf_dir).groupBy("label").agg(F.sum("junctions").alias("junctions")).join(topology.bifurcation(dist, "label"), "label").join(dist.groupBy("label").agg(F.max("strahler").alias("orders")), "label")
    after = st.select((F.col("label") - 1).alias("label"), F.col("label").alias("other"), F.col("junctions").alias("j2"), F.col("rb").alias("rb2"))
    weights = dist.withColumnRenamed("n", "a").join(dist.select((F.col("label") - 1).alias("label"), "strahler", F.col("n").alias("b")), ["label", "strahler"], "full")
    w = topology.wasserstein1(weights, "a", "b", "strahler", "label")
    change = topology.branching_shift(F.col("junctions"), F.col("j2"), F.col("rb"), F.col("rb2"), F.col("w1"), F.col("orders"))
    return st.join(after, "label").join(w, "label").select("label", "other", F.round("w1", 6).alias("w1"), F.round(F.abs(F.col("rb2") - F.col("rb")), 6).alias("d_rb"), F.round(change, 6).alias("shift"))


@query(f"with recursive {_FOREST} select label % 3 as province, count(*) as n, round(case when stddev_pop(leaves) > 0 and stddev_pop(junctions) > 0 then corr(leaves, junctions) end, 6) as pearson, quantile_cont(junctions, 0.5)::double as median_junctions from per group by grouping sets ((label % 3), ())")
def construct_summary(spark, sf_dir):
    """Per province and over all, by grouping sets."""
    rows = per_patch(spark, sf_dir).withColumn("province", F.col("label") % 3)
    pearson = twosample.correlation(F.col("leaves"), F.col("junctions"))
    return rows.groupingSets([[F.col("province")], []], F.col("province")).agg(F.count("*").alias("n"), F.round(pearson, 6).alias("pearson"), F.percentile("junctions", 0.5).alias("median_junctions"))


@query(f"with recursive {_FOREST}, r as (select leaves, junctions, rank() over (order by leaves) + (count(*) over (partition by leaves) - 1) / 2.0::double as ra, rank() over (order by junctions) + (count(*) over (partition by junctions) - 1) / 2.0::double as rb from per) select round(corr(ra, rb), 6) as spearman, round(corr(leaves, junctions), 6) as pearson, count(*) as n from r")
def junction_spearman(spark, sf_dir):
    rows = per_patch(spark, sf_dir)
    ranked = twosample.average_ranks(twosample.average_ranks(rows, "leaves", "ra"), "junctions", "rb")
    return ranked.agg(F.round(F.corr("ra", "rb"), 6).alias("spearman"), F.round(F.corr("leaves", "junctions"), 6).alias("pearson"), F.count("*").alias("n"))


@query(f"with recursive {_FOREST}, m as (select label, avg(junctions) as j, avg(leaves) as l from per group by all), t as (select avg(j) as cj, avg(l) as cl from m) select label, round(j - cj, 6) as junction_gap, round(l - cl, 6) as leaf_gap, j >= 0.95 * cj as junctions_pass, l <= 1.05 * cl as leaves_pass from m, t")
def side_gap(spark, sf_dir):
    """Each tile's means against the ceiling of all: at least 95 % of the junctions, at most 105 % of the leaves."""
    m = per_patch(spark, sf_dir).groupBy("label").agg(F.avg("junctions").alias("j"), F.avg("leaves").alias("l"))
    t = m.agg(F.avg("j").alias("cj"), F.avg("l").alias("cl"))
    return m.crossJoin(F.broadcast(t)).select("label", F.round(F.col("j") - F.col("cj"), 6).alias("junction_gap"), F.round(F.col("l") - F.col("cl"), 6).alias("leaf_gap"), (F.col("j") >= 0.95 * F.col("cj")).alias("junctions_pass"), (F.col("l") <= 1.05 * F.col("cl")).alias("leaves_pass"))


@query(f"with recursive {_FOREST} select label % 3 as province, count(*) as n, round_even(20 * count(*) / sum(count(*)) over (), 0)::bigint as share from per group by 1")
def allocation(spark, sf_dir):
    counts = per_patch(spark, sf_dir).groupBy((F.col("label") % 3).alias("province")).agg(F.count("*").alias("n"))
    return twosample.allocation(counts, 20)


_LINE = "x as (select l_linenumber, l_quantity as q, l_extendedprice as p from lineitem)"


@query(f"with {_LINE}, e as (select quantile_cont(q, [0, 0.25, 0.5, 0.75, 1]) as e from x), b as (select i::int as bin, e[i + 1] as lo, e[i + 2] as hi from e, range(0, 4) g(i)) select b.bin, b.lo, b.hi, count(*) as n, round(avg(p), 4) as mean from b join x on x.q between b.lo and b.hi group by all")
def quantile_bins(spark, sf_dir):
    """Quarters closed at both ends, so that values at an edge count in both."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    edges = x.agg(F.percentile("q", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("e"))
    bins = edges.select("e", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bin")).select("bin", F.get("e", F.col("bin")).alias("lo"), F.get("e", F.col("bin") + 1).alias("hi"))
    return x.join(F.broadcast(bins), F.col("q").between(F.col("lo"), F.col("hi"))).groupBy("bin", "lo", "hi").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean"))


@query("""with c as (select l_linenumber::double as f, avg(l_extendedprice) as b from lineitem group by all), t as (select 0.5::double + i as f from range(0, 8) g(i)), s as (select f, b, lead(f) over (order by f) as f2, lead(b) over (order by f) as b2 from c)
select t.f as target, round(coalesce((select s.b + (s.b2 - s.b) * (t.f - s.f) / (s.f2 - s.f) from s where t.f >= s.f and t.f < s.f2), case when t.f < (select min(f) from c) then (select min_by(b, f) from c) else (select max_by(b, f) from c) end), 4) as unit from t""")
def interpolated_control(spark, sf_dir):
    """Mean price at line numbers between the given ones, held at the ends."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("f")).agg(F.avg("l_extendedprice").alias("b"))
    w = W.partitionBy(F.lit(0)).orderBy("f")
    s = c.withColumn("f2", F.lead("f").over(w)).withColumn("b2", F.lead("b").over(w))
    ends = c.agg(F.min("f").alias("low"), F.min_by("b", "f").alias("first"), F.max_by("b", "f").alias("last"))
    t = spark.range(8).select((F.col("id") + 0.5).cast("double").alias("target")).crossJoin(F.broadcast(ends))
    hit = t.join(F.broadcast(s), (F.col("target") >= F.col("f")) & (F.col("target") < F.col("f2")), "left")
    value = F.coalesce(F.col("b") + (F.col("b2") - F.col("b")) * (F.col("target") - F.col("f")) / (F.col("f2") - F.col("f")), F.when(F.col("target") < F.col("low"), F.col("first")).otherwise(F.col("last")))
    return hit.select("target", F.round(value, 4).alias("unit"))


@query("""with t as (select o_orderpriority as kind, o_totalprice / 100000 as r, o_custkey % 7 as f from orders), u as (select kind, count(*) filter (where f < 1) as excluded, quantile_cont(r, 0.95) filter (where f >= 1) as p95, quantile_cont(r, 0.5) filter (where f >= 1) as median from t group by all) select kind, excluded, round(p95, 6) as p95, round(median, 6) as median, p95 < 3.0 as stable from u""")
def invariant_verdict(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_totalprice") / 100000).alias("r"), (F.col("o_custkey") % 7).alias("f"))
    kept = F.when(F.col("f") >= 1, F.col("r"))
    u = t.groupBy("kind").agg(F.count_if(F.col("f") < 1).alias("excluded"), F.percentile(kept, 0.95).alias("p95"), F.percentile(kept, 0.5).alias("median"))
    return u.select("kind", "excluded", F.round("p95", 6).alias("p95"), F.round("median", 6).alias("median"), (F.col("p95") < 3.0).alias("stable"))


@query("with a as (select l_linenumber as amp, quantile_cont(l_discount, 0.5) as d, quantile_cont(l_tax, 0.5) as t from lineitem group by all) select amp, round(d, 6) as d, round(t, 6) as t, amp = (select max(amp) from a where d <= 0.06 and t <= 0.05) as picked from a")
def amplitude_frontier(spark, sf_dir):
    """Medians by amplitude (line number), and the largest amplitude within two thresholds."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("amp")).agg(F.percentile("l_discount", 0.5).alias("d"), F.percentile("l_tax", 0.5).alias("t"))
    best = a.agg(F.max(F.when((F.col("d") <= 0.06) & (F.col("t") <= 0.05), F.col("amp"))).alias("best"))
    return a.crossJoin(F.broadcast(best)).select("amp", F.round("d", 6).alias("d"), F.round("t", 6).alias("t"), (F.col("amp") == F.col("best")).alias("picked"))


@query("""with u as (unpivot (select label, embedding[1]::double as e1, embedding[2]::double as e2, embedding[3]::double as e3 from embeddings) on e1, e2, e3 into name descriptor value v), b as (select descriptor, quantile_cont(v, 0.05) filter (where label % 2 = 0) as lo, quantile_cont(v, 0.95) filter (where label % 2 = 0) as hi, quantile_cont(v, 0.5) filter (where label % 2 = 1) as median from u group by all)
select descriptor, round(lo, 6) as lo, round(hi, 6) as hi, round(median, 6) as median, median between lo and hi as inside from b""")
def in_family(spark, sf_dir):
    """Whether the median of one population lies in the 5th to 95th percentile of the other, descriptor by descriptor."""
    e = table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(3)])
    u = e.unpivot(["label"], ["e1", "e2", "e3"], "descriptor", "v")
    even, odd = F.when(F.col("label") % 2 == 0, F.col("v")), F.when(F.col("label") % 2 == 1, F.col("v"))
    b = u.groupBy("descriptor").agg(F.percentile(even, 0.05).alias("lo"), F.percentile(even, 0.95).alias("hi"), F.percentile(odd, 0.5).alias("median"))
    return b.select("descriptor", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "median")], F.col("median").between(F.col("lo"), F.col("hi")).alias("inside"))


@query(f"""with {_D}, far as (select i, j, d from pd where d >= (select quantile_cont(d, 0.95) from pd)), near as (select f.i, f.j, f.d, abs(a.x[1] - b.x[1]) as gap from far f join v a on a.id = f.i join v b on b.id = f.j) select i, j, round(d, 6) as d, round(gap, 6) as gap from near order by near.gap, i, j limit 1""")
def found_pair(spark, sf_dir):
    """Of the pairs at or beyond the 95th percentile of distance, the one that is closest in its first feature."""
    p = pairs(spark, sf_dir)
    best = twosample.closest_far_pairs(p, twosample.distance_quantiles(p, 0.95, positive=False).get(0, 0.0))
    return best.orderBy("gap", "i", "j").limit(1).select("i", "j", F.round("d", 6).alias("d"), F.round("gap", 6).alias("gap"))


@query("select label::int as label, (g.i - 1)::int as pos, round(avg(embedding[g.i]::double), 6) as mean from embeddings, range(1, 65) g(i) group by all")
def ensemble_mean(spark, sf_dir):
    """Element-wise mean vector of each tile."""
    return patches(spark, sf_dir).select("label", F.posexplode("z").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("with r as (select s_suppkey, s_acctbal, row_number() over (order by s_acctbal, s_suppkey) - 1 as k, count(*) over () as n from supplier), t as (select i::int as pick, floor(i * (n - 1) / 9.0::double + 0.5)::bigint as k from range(0, 10) g(i), (select max(n) as n from r)) select t.pick, r.s_suppkey, r.s_acctbal from t join r on r.k = t.k")
def spread_pick(spark, sf_dir):
    """Ten suppliers at evenly spaced ranks of their balance."""
    r = cut(numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"]))
    t = spark.range(10).select(F.col("id").cast("int").alias("pick")).crossJoin(F.broadcast(r.agg(F.count("*").alias("m")))).withColumn("k", F.floor(F.col("pick") * (F.col("m") - 1) / 9.0 + 0.5))
    return t.join(r, "k").select("pick", "s_suppkey", "s_acctbal")


@query("with e as (select quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) as e from customer) select c_custkey, (1 + (e[1] < c_acctbal)::int + (e[2] < c_acctbal)::int + (e[3] < c_acctbal)::int + (e[4] < c_acctbal)::int)::int as bucket from customer, e")
def quintile_bucket(spark, sf_dir):
    """1 plus the number of quintile edges strictly below."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    edges = c.agg(F.percentile("c_acctbal", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("e"))
    return c.crossJoin(F.broadcast(edges)).select("c_custkey", (1 + F.size(F.filter("e", lambda x: x < F.col("c_acctbal")))).cast("int").alias("bucket"))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("with u as (unpivot (select row_number() over () as id, l_quantity::double as l_quantity, l_extendedprice::double as l_extendedprice, l_discount::double as l_discount, l_tax::double as l_tax from lineitem) on l_quantity, l_extendedprice, l_discount, l_tax into name f value v) select a.f as a, b.f as b, round(corr(a.v, b.v), 6) as r, abs(corr(a.v, b.v)) >= 0.3 as strong from u a join u b on b.id = a.id and a.f < b.f group by all")
def corr_matrix(spark, sf_dir):
    """Correlations of every two number columns, in one pass over the table."""
    t = table(spark, sf_dir, "lineitem")
    duos = [(a, b) for i, a in enumerate(sorted(_NUM)) for b in sorted(_NUM)[i + 1 :]]
    row = t.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in duos])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in duos])).alias("x")).select("x.*")
    return out.select("a", "b", F.round("r", 6).alias("r"), (F.abs("r") >= 0.3).alias("strong"))


@query("select l_returnflag, round(avg(l_quantity), 6) as mean, quantile_cont(l_quantity, 0.5)::double as median, quantile_cont(l_quantity, 0.25)::double as q1, quantile_cont(l_quantity, 0.75)::double as q3, round(stddev_samp(l_quantity), 6) as sd, count(*) as n from lineitem group by all")
def describe_groups(spark, sf_dir):
    q = F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.get(q, F.lit(1)).alias("median"), F.get(q, F.lit(0)).alias("q1"), F.get(q, F.lit(2)).alias("q3"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.count("*").alias("n"))


@query("select p_type as method, count(*) as n, count(*) filter (where p_retailprice > 1000) as tier_1, count(*) filter (where p_retailprice between 500 and 1000) as tier_2 from part group by all having count(*) >= 5")
def significance_tiers(spark, sf_dir):
    """Tier counts of precomputed results, groups of five or more."""
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("method")).agg(F.count("*").alias("n"), F.count_if(price > 1000).alias("tier_1"), F.count_if(price.between(500, 1000)).alias("tier_2")).where("n >= 5")
