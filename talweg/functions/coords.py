"""Tile keys and boxes as column expressions.

Two conventions name a one-degree tile with the same kind of key: by its north-west corner (nw) and by its south-west
corner (sw). They are never mixed here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(lon: Column, lat: Column) -> Column:
    ns, ew = F.when(lat >= 0, "n").otherwise("s"), F.when(lon >= 0, "e").otherwise("w")
    return F.concat(ns, F.lpad(F.abs(lat).cast("string"), 2, "0"), ew, F.lpad(F.abs(lon).cast("string"), 3, "0"))


def key_sw(lon: Column, lat: Column) -> Column:
    """Key by the south-west corner (whole degrees)."""
    return _key(lon.cast("int"), lat.cast("int"))


def key_nw(lon: Column, lat: Column) -> Column:
    """Key by the north-west corner, given the south-west one."""
    return _key(lon.cast("int"), lat.cast("int") + 1)


def box_of_key_nw(key: Column) -> Column:
    """struct min_lon, min_lat, max_lon, max_lat of a north-west key; null for anything else."""
    pattern = r"^([ns])(\d{2})([ew])(\d{3})$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    top = F.when(part(1) == "n", part(2).try_cast("int")).otherwise(-part(2).try_cast("int"))
    left = F.when(part(3) == "e", part(4).try_cast("int")).otherwise(-part(4).try_cast("int"))
    return F.when(key.rlike(pattern), F.struct(left.alias("min_lon"), (top - 1).alias("min_lat"), (left + 1).alias("max_lon"), top.alias("max_lat")))


def tiles_covering(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Array of south-west corners of the one-degree tiles that a box touches, by latitude, then longitude."""
    steps = lambda lo, hi: F.sequence(F.floor(lo).cast("int"), F.greatest(F.ceil(hi).cast("int") - 1, F.floor(lo).cast("int")))
    return F.flatten(F.transform(steps(min_lat, max_lat), lambda y: F.transform(steps(min_lon, max_lon), lambda x: F.struct(x.alias("lon"), y.alias("lat")))))


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two boxes (min_x, min_y, max_x, max_y) share."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("min_x", "max_x") * side("min_y", "max_y")


def area(a: Column) -> Column:
    return (a["max_x"] - a["min_x"]) * (a["max_y"] - a["min_y"])


def overlaps(a: Column, b: Column) -> Column:
    """Whether boxes share more than an edge."""
    return (a["min_x"] < b["max_x"]) & (b["min_x"] < a["max_x"]) & (a["min_y"] < b["max_y"]) & (b["min_y"] < a["max_y"])


def intersects(a: Column, b: Column) -> Column:
    """Whether boxes share at least a point."""
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def ring(a: Column) -> Column:
    """The closed ring of a box: five points, counter-clockwise from its least corner."""
    point = lambda x, y: F.struct(a[x].alias("x"), a[y].alias("y"))
    return F.array(point("min_x", "min_y"), point("max_x", "min_y"), point("max_x", "max_y"), point("min_x", "max_y"), point("min_x", "min_y"))


def shoelace(vertices: Column) -> Column:
    """Area of a closed ring of points."""
    n = F.size(vertices)
    cross = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(vertices, i)["x"] * F.get(vertices, i + 1)["y"] - F.get(vertices, i + 1)["x"] * F.get(vertices, i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def inside_ring(x: Column, y: Column, vertices: Column) -> Column:
    """Whether a point is inside a closed ring, by the crossings of a ray to the right."""
    # The point goes into the array: a lambda that names outer columns can be pushed below a join, to where they are not.
    n = F.greatest(F.size(vertices) - 1, F.lit(0))
    edges = F.arrays_zip(F.slice(vertices, 1, n).alias("a"), F.slice(vertices, 2, n).alias("b"), F.array_repeat(x, n).alias("x"), F.array_repeat(y, n).alias("y"))

    def crossed(e: Column) -> Column:
        a, b, px, py = e["a"], e["b"], e["x"], e["y"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges, crossed)) % 2 == 1


def mercator(lon: Column, lat: Column) -> Column:
    """struct x, y in spherical Mercator metres (EPSG:3857) of degrees."""
    radius = 6378137.0
    return F.struct((F.radians(lon) * radius).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + 0.7853981633974483)) * radius).alias("y"))


def mercator_inverse(x: Column, y: Column) -> Column:
    """Longitude and latitude of spherical Mercator metres."""
    radius = 6378137.0
    return F.struct(F.degrees(x / radius).alias("lon"), F.degrees(2 * F.atan(F.exp(y / radius)) - F.pi() / 2).alias("lat"))


def grown(a: Column, by: float) -> Column:
    """A box with a buffer around it."""
    return F.struct((a["min_x"] - by).alias("min_x"), (a["min_y"] - by).alias("min_y"), (a["max_x"] + by).alias("max_x"), (a["max_y"] + by).alias("max_y"))


def digest_id(name: Column) -> Column:
    """The MD5 of a text in the form 8-4-4-4-12."""
    h = F.md5(name)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def natural_key(name: Column) -> Column:
    """Sort key of names like `model_12ms`: prefix, number, whether it ends in ms."""
    return F.struct(F.regexp_extract(name, r"^(\D*)", 1).alias("prefix"), F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("int"), F.lit(-1)).alias("number"), name.endswith("ms").alias("ms"))
