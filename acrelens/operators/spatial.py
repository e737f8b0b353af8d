"""Spatial joins on longitude and latitude columns by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.functions.projection import SPHERE_SHARE, geodesic_m
from acrelens.scratch import materialize

EARTH_M = 6_371_008.8
MILE_M = 1609.344
#: Half of the way round: every place is within it.
FARTHEST_M = math.pi * EARTH_M * 1.001
#: How often a cell can be halved each way where places stand close.
SPLITS = 5


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the mean sphere."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _columns(lon: Column, size: float) -> Column:
    """Number of the cell of a longitude, on a circle of whole cells."""
    return F.pmod(F.floor((lon + 180.0) / size).cast("long"), F.lit(round(360.0 / size)))


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def split_cells(places: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """keys, y, x, leaves: the grid cells that hold more than so many places, and what each is cut into.

    ``places`` has keys and v, u: its cell in a grid SPLITS times halved. A cell with too many
    places is cut into its four quarters, these again, and so on; ``leaves`` are the parts that
    are cut no more, with level, place in the grid of that level, and in how many ``parts``
    the rows of a smallest cell are dealt that still holds too many (places on one spot).
    Counted in one pass over the places: sums of every level come from those of the finest
    cells, and a cell has at most 4 ** SPLITS leaves.
    """
    fine = places.groupBy(*keys, "v", "u").agg(F.count(F.lit(1)).alias("n"))
    levels = F.sequence(F.lit(0), F.lit(SPLITS))
    nodes = fine.withColumn("level", F.explode(levels)).withColumn("down", F.lit(SPLITS) - F.col("level"))
    nodes = nodes.groupBy(*keys, "level", _shift(F.col("v"), F.col("down")).alias("ny"), _shift(F.col("u"), F.col("down")).alias("nx")).agg(F.sum("n").alias("n"))
    full = F.col("n") > rows
    up = lambda c: _shift(F.col(c), F.col("level"))
    # A node is met with the nodes of its own cell only; those of cells that hold few places are dropped first.
    nodes = nodes.withColumn("y", up("ny")).withColumn("x", up("nx"))
    crowded = nodes.filter(full & (F.col("level") == 0)).select(*keys, "y", "x")
    nodes = nodes.join(crowded, [*keys, "y", "x"], "left_semi")
    node = F.struct(F.col("level"), F.col("ny").alias("y"), F.col("nx").alias("x"))
    trees = nodes.groupBy(*keys, "y", "x").agg(
        F.collect_set(F.when(full & (F.col("level") < SPLITS), node)).alias("cut"),
        F.collect_list(F.when(~full | (F.col("level") == SPLITS), F.struct(node.alias("node"), F.ceil(F.col("n") / rows).cast("int").alias("parts")))).alias("ends"),
    )
    above = lambda e: F.struct((e["node"]["level"] - 1).alias("level"), _shift(e["node"]["y"], F.lit(1)).alias("y"), _shift(e["node"]["x"], F.lit(1)).alias("x"))
    leaves = F.transform(F.filter("ends", lambda e: F.array_contains("cut", above(e))), lambda e: F.struct(e["node"]["level"].alias("level"), e["node"]["y"].alias("y"), e["node"]["x"].alias("x"), e["parts"].alias("parts")))
    return trees.select(*keys, "y", "x", leaves.alias("leaves"))


def within_radius(left: DataFrame, right: DataFrame, keys: list[str], radius_m: float, condition: str = "true", cell_rows: int | None = None) -> DataFrame:
    """Pairs (structs l and r) with equal keys and at most the radius apart, for which ``condition`` on l.* and r.* holds.

    Both sides have lat and lon. The left side is spread over the cells that its circle
    touches, about nine and more towards the poles, round the date line too; each pair
    meets in exactly one of them and the join is an equi-join that AQE can split.

    With ``cell_rows``, cells that hold more rows of the right side are cut by ``split_cells``
    until none does; a left row goes to the parts that the box round its circle touches, so in
    dense places it meets fewer rows out of reach. The pairs are the same. What a smallest
    cell holds beyond that is dealt to parts by hash: these hold about so many rows each, and
    equal rows of the right side stay together whatever their number.

    Distances are on the ellipsoid. The mean sphere's differ by less than SPHERE_SHARE, so
    it settles all pairs but those near the radius, and only for these the geodesic is worked
    out (places nearly opposite on the earth keep the sphere's distance).
    """
    most = radius_m / (1 - SPHERE_SHARE)
    a, b, on = dealt(left, right, keys, most, cell_rows)
    ends = F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon")
    near = a.join(b, on).filter(F.expr(condition)).withColumn("apart", distance_m(*ends)).filter(F.col("apart") <= most)
    unsure = F.col("apart") > radius_m / (1 + SPHERE_SHARE)
    return near.filter(~unsure | (F.coalesce(geodesic_m(*ends), "apart") <= radius_m)).select("l", "r")


def neighbour_counts(places: DataFrame, keys: list[str], name: str, radius_m: float, cell_rows: int | None = None) -> DataFrame:
    """keys, ``name`` and neighbours: how many rows of other names with equal keys are within the radius of a name's rows; names without any are left out.

    ``within_radius`` meets spots, each with how many rows stand on it, so rows of one place
    (units of a building) cost no pairs among themselves. Of a row's sum the rows of its own
    name go: by spots of the name, met with each other the same way. Names are mostly on one
    spot, whose rows are then simply subtracted.
    """
    at = [*keys, "lat", "lon"]
    told = " and ".join(f"{c} is not null" for c in [*keys, name])
    # Zeros of either sign are one place.
    rows = places.filter("lat is not null and lon is not null").filter(told).select(*keys, name, *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in ("lat", "lon")])
    named = rows.groupBy(*at, name).agg(F.count(F.lit(1)).alias("own"))
    spots = materialize(named.groupBy(*at).agg(F.sum("own").alias("n")), "spots")
    pairs = within_radius(spots.drop("n"), spots, keys, radius_m, cell_rows=cell_rows)
    reach = pairs.groupBy(*[F.col(f"l.{c}").alias(c) for c in at]).agg(F.sum("r.n").alias("reach"))
    met = named.join(reach, at).groupBy(*keys, name).agg(F.sum(F.col("own") * F.col("reach")).alias("all"), F.sum(F.col("own") * F.col("own")).alias("same"), F.count(F.lit(1)).alias("spots"))
    several = met.filter("spots > 1").select(*keys, name)
    moved = named.join(several, [*keys, name], "left_semi")
    apart = within_radius(moved, moved, [*keys, name], radius_m, "l.lat <> r.lat or l.lon <> r.lon")
    apart = apart.groupBy(*[F.col(f"l.{c}").alias(c) for c in [*keys, name]]).agg(F.sum(F.col("l.own") * F.col("r.own")).alias("apart"))
    left = met.join(apart, [*keys, name], "left").select(*keys, name, (F.col("all") - F.col("same") - F.coalesce("apart", F.lit(0))).alias("neighbours"))
    return left.filter("neighbours > 0")


def dealt(left: DataFrame, right: DataFrame, keys: list[str], radius_m: float, cell_rows: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """The two sides of a radius join, structs l and r, and the columns on which rows within the radius on the sphere meet once."""
    reach = min(math.degrees(radius_m / EARTH_M) * 1.000001, 180.0)
    high, wide = max(reach, 1e-6), 360.0 / max(1, math.floor(360.0 / max(reach, 1e-6)))
    named = [f"k_{k}" for k in keys]
    at = F.col("l.lat"), F.col("l.lon")
    # How far the circle reaches east and west: to all longitudes where it holds a pole.
    across = F.when(F.abs(at[0]) + reach >= 89.999, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians(at[0])), F.lit(1.0)))) * 1.000001)
    span = lambda parts: (cell(at[0] - reach, high / parts), cell(at[0] + reach, high / parts), cell(at[1] - across + 180.0, wide / parts), cell(at[1] + across + 180.0, wide / parts))
    south, north, west, east = span(1)
    columns = F.array_distinct(F.transform(F.sequence(west, east), lambda x: F.pmod(x, F.lit(round(360.0 / wide)))))
    a = left.filter("lat is not null and lon is not null").select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.struct("*").alias("l"))
    b = right.filter("lat is not null and lon is not null").select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.struct("*").alias("r"), cell(F.col("lat"), high).alias("y"), _columns(F.col("lon"), wide).alias("x"))
    a = a.withColumn("y", F.explode(F.sequence(south, north))).withColumn("x", F.explode(columns))
    if cell_rows is None:
        return a, b, [*named, "y", "x"]

    finest = 2**SPLITS
    b = b.withColumn("v", cell(F.col("r.lat"), high / finest)).withColumn("u", _columns(F.col("r.lon"), wide / finest))
    trees = split_cells(b.select(*named, "v", "u"), named, cell_rows)
    down = lambda leaf: F.lit(SPLITS) - leaf["level"]
    south, north, west, east = span(finest)
    here = lambda leaf: (_shift(F.col("v"), down(leaf)) == leaf["y"]) & (_shift(F.col("u"), down(leaf)) == leaf["x"])

    def touched(leaf: Column) -> Column:
        first, last, around = _shift(west, down(leaf)), _shift(east, down(leaf)), F.call_function("shiftleft", F.lit(round(360.0 / wide)).cast("long"), leaf["level"])
        return leaf["y"].between(_shift(south, down(leaf)), _shift(north, down(leaf))) & (F.pmod(leaf["x"] - first, around) <= last - first)

    whole = F.array(F.struct(F.lit(0).alias("level"), F.col("y"), F.col("x"), F.lit(1).alias("parts")))
    # What cells are cut into has no bound that a driver could hold, so it is never broadcast.
    met = lambda rows, test: rows.join(trees.hint("merge"), [*named, "y", "x"], "left").withColumn("leaf", F.explode(F.coalesce(F.filter("leaves", test), whole))).drop("leaves", "y", "x", "v", "u")
    a = met(a, touched).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("leaf.parts") - 1)))
    b = met(b, here).withColumn("part", F.pmod(F.xxhash64("r"), F.col("leaf.parts")).cast("int"))
    split = lambda rows, side: rows.select(*named, side, "leaf.level", "leaf.y", "leaf.x", "part")
    return split(a, "l"), split(b, "r"), [*named, "level", "y", "x", "part"]


def inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a polygon's outer ring, array<struct<lon,lat>>, by counting crossings."""
    def crossing(i: Column) -> Column:
        p, q = F.element_at(ring, i.cast("int")), F.element_at(ring, (i % F.size(ring) + 1).cast("int"))
        at = F.try_divide((q["lon"] - p["lon"]) * (lat - p["lat"]), q["lat"] - p["lat"]) + p["lon"]
        return F.when(((p["lat"] > lat) != (q["lat"] > lat)) & (lon < at), 1).otherwise(0)

    sides = F.transform(F.sequence(F.lit(1), F.size(ring)), crossing)
    return F.aggregate(sides, F.lit(0), lambda a, x: a + x) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Area of a ring in square degrees."""
    def part(i: Column) -> Column:
        p, q = F.element_at(ring, i.cast("int")), F.element_at(ring, (i % F.size(ring) + 1).cast("int"))
        return p["lon"] * q["lat"] - q["lon"] * p["lat"]

    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(1), F.size(ring)), part), F.lit(0.0), lambda a, x: a + x)) / 2


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid of a ring as struct<lon,lat>."""
    def parts(i: Column) -> Column:
        p, q = F.element_at(ring, i.cast("int")), F.element_at(ring, (i % F.size(ring) + 1).cast("int"))
        cross = p["lon"] * q["lat"] - q["lon"] * p["lat"]
        return F.struct(cross.alias("w"), ((p["lon"] + q["lon"]) * cross).alias("x"), ((p["lat"] + q["lat"]) * cross).alias("y"))

    sides = F.transform(F.sequence(F.lit(1), F.size(ring)), parts)
    total = lambda field: F.aggregate(F.transform(sides, lambda s: s[field]), F.lit(0.0), lambda a, v: a + v)
    return F.struct(F.try_divide(total("x"), 3 * total("w")).alias("lon"), F.try_divide(total("y"), 3 * total("w")).alias("lat"))


def tiles(lat_low: Column, lat_high: Column, size: float) -> Column:
    return F.sequence(cell(lat_low, size), cell(lat_high, size))


def containing(points: DataFrame, polygons: DataFrame, key: list[str], size: float = 0.25) -> DataFrame:
    """Pairs of points (key, lat, lon) and polygons (name, ring) that hold them: key, name, area.

    A polygon stands in every grid tile that its box touches; a point in one. Polygons may
    have ``holes``, rings that lie inside, and an ``area`` of their own.
    """
    holes = F.col("holes") if "holes" in polygons.columns else F.array().cast("array<array<struct<lon:double,lat:double>>>")
    area = F.col("area") if "area" in polygons.columns else ring_area(F.col("ring"))
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    shapes = polygons.select(F.col("name"), "ring", holes.alias("holes"), area.alias("area"), F.array_min(lats).alias("s"), F.array_max(lats).alias("n"), F.array_min(lons).alias("w"), F.array_max(lons).alias("e"))
    shapes = shapes.withColumn("y", F.explode(tiles(F.col("s"), F.col("n"), size))).withColumn("x", F.explode(tiles(F.col("w"), F.col("e"), size)))
    spots = points.select(*key, "lat", "lon", cell(F.col("lat"), size).alias("y"), cell(F.col("lon"), size).alias("x"))
    met = spots.join(shapes, ["y", "x"]).filter("lat between s and n and lon between w and e").filter(inside(F.col("lat"), F.col("lon"), F.col("ring")) & ~F.exists("holes", lambda h: inside(F.col("lat"), F.col("lon"), h)))
    return met.select(*key, "name", "area")


def edges(polygons: DataFrame, band: float) -> DataFrame:
    """(shape, slab, lat1, lon1, lat2, lon2): sides of all rings of polygons (shape, ring, holes) in every band of latitude that they cross."""
    def sides(ring: Column) -> Column:
        def side(i: Column) -> Column:
            p, q = F.element_at(ring, i.cast("int")), F.element_at(ring, (i % F.size(ring) + 1).cast("int"))
            return F.struct(p["lat"].alias("lat1"), p["lon"].alias("lon1"), q["lat"].alias("lat2"), q["lon"].alias("lon2"))

        return F.transform(F.sequence(F.lit(1), F.size(ring)), side)

    rings = polygons.select("shape", F.explode(F.concat(F.array("ring"), "holes")).alias("r")).filter("size(r) > 0")
    rows = rings.select("shape", F.explode(sides(F.col("r"))).alias("e")).select("shape", "e.*").filter("lat1 <> lat2")
    slabs = F.sequence(cell(F.least("lat1", "lat2"), band), cell(F.greatest("lat1", "lat2"), band))
    return rows.select("shape", F.explode(slabs).alias("slab"), "lat1", "lon1", "lat2", "lon2")


def containing_by_slabs(points: DataFrame, polygons: DataFrame, key: list[str], band: float = 0.01, size: float = 0.25) -> DataFrame:
    """``containing`` for polygons of very many corners: key, name, area, by an index of their sides.

    Sides are dealt to bands of latitude. A point meets, of each polygon whose box holds it,
    the sides in its own band only; whether a ray crosses an odd number of them is a partial
    sum, so no row holds a ring and no task all sides of one. Holes' sides count like others.
    Points of one spot meet the sides once.
    """
    holes = F.col("holes") if "holes" in polygons.columns else F.array().cast("array<array<struct<lon:double,lat:double>>>")
    area = F.col("area") if "area" in polygons.columns else ring_area(F.col("ring"))
    shapes = materialize(polygons.select("name", "ring", holes.alias("holes"), area.alias("area"), F.monotonically_increasing_id().alias("shape")), "shapes")
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    boxes = shapes.select("shape", "name", "area", F.array_min(lats).alias("s"), F.array_max(lats).alias("n"), F.array_min(lons).alias("w"), F.array_max(lons).alias("e"))
    boxes = boxes.withColumn("y", F.explode(tiles(F.col("s"), F.col("n"), size))).withColumn("x", F.explode(tiles(F.col("w"), F.col("e"), size)))
    spots = points.select("lat", "lon").distinct().select("lat", "lon", cell(F.col("lat"), size).alias("y"), cell(F.col("lon"), size).alias("x"))
    held = spots.join(boxes, ["y", "x"]).filter("lat between s and n and lon between w and e").select("lat", "lon", "shape", "name", "area", cell(F.col("lat"), band).alias("slab"))
    met = held.join(edges(shapes.select("shape", "ring", "holes"), band), ["shape", "slab"])
    crossed = ((F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))) & (F.col("lon") < F.try_divide((F.col("lon2") - F.col("lon1")) * (F.col("lat") - F.col("lat1")), F.col("lat2") - F.col("lat1")) + F.col("lon1"))
    odd = met.groupBy("lat", "lon", "shape", "name", "area").agg((F.count_if(crossed) % 2 == 1).alias("inside"))
    return points.select(*key, "lat", "lon").join(odd.filter("inside"), ["lat", "lon"]).select(*key, "name", "area")


def largest_containing(points: DataFrame, polygons: DataFrame, key: list[str]) -> DataFrame:
    """key, name of the largest polygon that holds each point, ties to the lesser name."""
    return containing(points, polygons, key).groupBy(*key).agg(F.min_by("name", F.struct(-F.col("area"), F.col("name"))).alias("name"))


def any_containing(points: DataFrame, polygons: DataFrame, key: list[str]) -> DataFrame:
    """key, least name of the polygons that hold each point."""
    return containing(points, polygons, key).groupBy(*key).agg(F.min("name").alias("name"))


def nearest_place(points: DataFrame, places: DataFrame, key: list[str], radii_m: tuple[float, ...] = (5_000.0, 40_000.0, 320_000.0, 2_560_000.0)) -> DataFrame:
    """key, name, metres on the ellipsoid of the nearest place (name, lat, lon) of every point, ties to the lesser name.

    Rings of growing radius, the last one round the earth: a point that a smaller one
    settles does not enter the next, and no further ring is made when none is left.
    """
    out, left = None, points.filter("lat is not null and lon is not null").select(*key, "lat", "lon")
    for radius in (*radii_m, FARTHEST_M):
        ends = F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon")
        pairs = within_radius(left, places.select("name", "lat", "lon"), [], radius).select(*[F.col(f"l.{k}").alias(k) for k in key], "l", "r", distance_m(*ends).alias("apart"))
        # On the sphere the nearest is within this of the least distance; for those alone the geodesic is worked out.
        least = F.min("apart").over(Window.partitionBy(*key)) * ((1 + SPHERE_SHARE) / (1 - SPHERE_SHARE))
        near = pairs.withColumn("most", least).filter("apart <= most")
        metres = F.coalesce(geodesic_m(*ends), "apart")
        best = near.select(*key, F.struct(metres.alias("metres"), F.col("r.name").alias("name")).alias("b")).groupBy(*key).agg(F.min("b").alias("b"))
        best = materialize(best.select(*key, "b.name", "b.metres"), "nearest")
        out = best if out is None else out.unionByName(best)
        left = left.join(best, key, "left_anti")
        if left.isEmpty():
            break
    return out


def outside_box(rows: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """How many rows there are and how many lie outside a box; rows stay."""
    ok = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("outside"))


def street_vote(rows: DataFrame, street: Column, value: str, share: float = 0.8) -> DataFrame:
    """street, value, votes, share for streets where one value has at least the share of those known."""
    counted = rows.filter(F.col(value).isNotNull()).select(street.alias("street"), F.col(value).alias("value")).filter("street <> ''").groupBy("street", "value").count()
    total = counted.groupBy("street").agg(F.sum("count").alias("n"), F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value"), F.max("count").alias("votes"))
    return total.withColumn("share", F.col("votes") / F.col("n")).filter(F.col("share") >= share).select("street", "value", "votes", "share")


def rank_within(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
