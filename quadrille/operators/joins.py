"""Spatial joins as equi-joins on grid cells, overlay precedence, and edge cancellation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grids import Grid, covered_tiles


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes overlap; touching counts."""
    return (a["maxx"] >= b["minx"]) & (a["minx"] <= b["maxx"]) & (a["maxy"] >= b["miny"]) & (a["miny"] <= b["maxy"])


def window(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose stored box overlaps a window: four comparisons that reach the scan."""
    return df.filter((F.col("maxx") >= box[0]) & (F.col("minx") <= box[2]) & (F.col("maxy") >= box[1]) & (F.col("miny") <= box[3]))


def size_gate(df: DataFrame, least: float) -> DataFrame:
    """Rows but polygons that are smaller than the least area; lines and points (area 0) always pass."""
    return df.filter(large_enough(least))


def large_enough(least: float) -> Column:
    """Whether a feature's stored area passes a size gate."""
    return ~(F.lit(least > 0) & (F.col("area") > 0) & (F.col("area") < least))


def tile_features(features: DataFrame, grid: Grid, z: int, least: float = 0.0) -> DataFrame:
    """The features of every tile: gated first, then one row for each tile that a box reaches into."""
    return covered_tiles(size_gate(features, least), grid, z)


def _cells(df: DataFrame, size: float, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / F.lit(float(size))).cast("long")
    out = df.withColumn("__cx", F.explode(F.sequence(cell(x0), cell(x1))))
    return out.withColumn("__cy", F.explode(F.sequence(cell(y0), cell(y1))))


def least_of(df: DataFrame, by: list[str], order: str, limit: int) -> DataFrame:
    """The first `limit` rows by order among those that agree in `by`: all that an answer of that many rows can hold of them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__r", rank).filter(F.col("__r") <= limit).drop("__r")


def first_hits(queries: DataFrame, features: DataFrame, cell: float, radius: float, limit: int) -> DataFrame:
    """Hits of a feature info request: query_id, fid, kind_order, dist, ord, rank; boxes around the point by fid, then corners within a radius.

    Queries at one place have one answer, so it is found once a place and joined back; of equal boxes, and of corners at one
    place, only the first `limit` by fid can be in an answer. Pairs grow with distinct places and boxes, not with their copies.
    """
    from .aggregates import hit_ranks

    box = ["minx", "miny", "maxx", "maxy"]
    places = queries.select("px", "py").distinct().withColumn("query_id", F.struct("px", "py"))
    held = points_in_boxes(places, least_of(features.select("fid", *box), box, "fid", limit), cell)
    held = held.select("query_id", "fid", F.lit(0).alias("kind_order"), F.lit(0.0).alias("dist"), F.col("fid").alias("ord"))
    corners = least_of(features.select("fid", F.col("minx").alias("fx"), F.col("miny").alias("fy")), ["fx", "fy"], "fid", limit)
    near = nearest_points(places, corners, radius, limit)
    near = near.select("query_id", "fid", F.lit(1).alias("kind_order"), F.col("d2").alias("dist"), F.col("fid").alias("ord"))
    found = hit_ranks(held.union(near), limit).select(F.col("query_id.px").alias("px"), F.col("query_id.py").alias("py"), "fid", "kind_order", "dist", "ord")
    return hit_ranks(queries.join(found, ["px", "py"]).drop("px", "py"), limit)


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float, x: str = "px", y: str = "py") -> DataFrame:
    """Pairs of points and boxes that hold them (left and lower borders belong to a box), by equi-join on cells."""
    p = _cells(points, cell, x, y, x, y)
    b = _cells(boxes, cell, "minx", "miny", "maxx", "maxy")
    near = p.join(b, ["__cx", "__cy"]).drop("__cx", "__cy")
    return near.filter((F.col(x) >= F.col("minx")) & (F.col(x) < F.col("maxx")) & (F.col(y) >= F.col("miny")) & (F.col(y) < F.col("maxy")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd containment of a point in an array<struct<x,y>> ring, with half-open edges."""
    n = F.size(ring)

    def crossing(a: Column, i: Column) -> Column:
        b = F.get(ring, F.when(i + 1 < n, i + 1).otherwise(F.lit(0)))
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"]
        return spans & (x < at)

    return F.size(F.filter(F.transform(ring, crossing), lambda c: c)) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, x: str = "px", y: str = "py") -> DataFrame:
    """Pairs of points and polygons (geom: the struct of functions.geometry, with its box) that hold them, holes left out."""
    p = _cells(points, cell, x, y, x, y)
    b = _cells(polygons, cell, "minx", "miny", "maxx", "maxy")
    near = p.join(b, ["__cx", "__cy"]).drop("__cx", "__cy")
    px, py = F.col(x), F.col(y)
    near = near.filter((px >= F.col("minx")) & (px <= F.col("maxx")) & (py >= F.col("miny")) & (py <= F.col("maxy")))  # before any ring is walked
    part = lambda rings: in_ring(px, py, F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda h: in_ring(px, py, h))
    return near.filter(F.col("geom.kind").isin("Polygon", "MultiPolygon") & F.exists("geom.parts", part))


def nearest_points(queries: DataFrame, features: DataFrame, radius: float, limit: int, query: str = "query_id", feature: str = "fid") -> DataFrame:
    """The features (fx, fy) within a radius of each query point (px, py), nearest first, at most `limit`.

    Both sides meet on cells of the radius's size: a query looks into its own cell and the eight around it.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    q = queries.withColumn("__cx", F.explode(F.transform(around, lambda d: cell("px") + d))).withColumn("__cy", F.explode(F.transform(around, lambda d: cell("py") + d)))
    f = features.withColumn("__cx", cell("fx")).withColumn("__cy", cell("fy"))
    d2 = (F.col("fx") - F.col("px")) * (F.col("fx") - F.col("px")) + (F.col("fy") - F.col("py")) * (F.col("fy") - F.col("py"))
    near = q.join(f, ["__cx", "__cy"]).drop("__cx", "__cy").withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    rank = F.row_number().over(Window.partitionBy(query).orderBy("d2", feature))
    return near.withColumn("rank", rank).filter(F.col("rank") <= max(1, limit))


def overlay_over_base(base: DataFrame, overlay: DataFrame, key: str = "tile_id") -> DataFrame:
    """All tiles of both tables; where both have one the overlay's wins. A null blob in the overlay hides nothing."""
    b, o = base.select(F.col(key), F.col("blob").alias("__base")), overlay.select(F.col(key), F.col("blob").alias("__over"))
    return b.join(o, key, "full_outer").select(key, F.coalesce("__over", "__base").alias("blob"), F.col("__over").isNotNull().alias("from_overlay"))


def missing_tiles(wanted: DataFrame, archive: DataFrame, key: str = "tile_id") -> DataFrame:
    """Wanted tiles that the archive doesn't have: the ones to compute."""
    return wanted.join(archive.select(key).distinct(), key, "left_anti")


def cancel_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """Directed edges (ax, ay, bx, by_) that are left when each meets its opposite within a group.

    Edges are counted with their sign under an undirected key, so opposite ones meet in the partial aggregation already.
    """
    forward = F.struct("ax", "ay") < F.struct(F.col("bx").alias("ax"), F.col("by_").alias("ay"))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    keyed = edges.select(*by, pick("ax", "bx").alias("ax"), pick("ay", "by_").alias("ay"), pick("bx", "ax").alias("bx"), pick("by_", "ay").alias("by_"), F.when(forward, 1).otherwise(-1).alias("s"))
    net = keyed.groupBy(*by, "ax", "ay", "bx", "by_").agg(F.sum("s").alias("net")).filter("net <> 0")
    on = F.col("net") > 0
    turned = lambda a, b: F.when(on, F.col(a)).otherwise(F.col(b))
    return net.select(*by, turned("ax", "bx").alias("ax"), turned("ay", "by_").alias("ay"), turned("bx", "ax").alias("bx"), turned("by_", "ay").alias("by_"), F.abs("net").alias("n"))
