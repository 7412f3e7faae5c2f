"""The registered geographic queries and their SQL.

Every query runs over whole tables; a limit appears only where it is the operator (scan cap, hit limit, sampling).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bandmath, filters, grids, mvt, style
from ..operators import aggregates, joins, labels, raster, tiles, topology
from ..sources import vector
from ..streaming import overlay
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WEB = grids.preset("WebMercatorQuad")
#: A grid over the boxes' thousand units: 16 x 16 tiles of 64 units at level 4.
LOCAL_CRS = "EPSG:3857"
LOCAL = grids.quad("local", LOCAL_CRS, 0.0, 1024.0, 1024.0, 256, 6)


def query(sql: str | None = None, *with_views: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL of the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(with_views)} " if with_views else "") + sql
        return f

    return add


def event_fields() -> filters.Fields:
    return filters.Fields(numbers={"value": F.col("value"), "user_id": F.col("user_id")}, strings={"event_type": F.col("event_type")})


def box_fields() -> filters.Fields:
    return filters.Fields(numbers={"price": F.col("price"), "area": F.col("area")}, strings={"class_key": F.col("class_key"), "name": F.col("name")})


_MERC = f"{grids.WORLD / (2 * math.pi)!r}"
_LAT = "greatest(least(lat, 85.05112878), -85.05112878)"
_X, _Y = f"radians(lon) * {_MERC}", f"{_MERC} * ln(tan({math.pi / 4!r} + radians({_LAT}) / 2))"


def _hilbert_sql(z: int, source: str) -> str:
    """Nested selects that unroll the curve's bits over columns x and y of source."""
    sql = f"SELECT *, CAST(x AS BIGINT) AS hx, CAST(y AS BIGINT) AS hy, CAST({(4**z - 1) // 3} AS BIGINT) AS d FROM ({source})"
    for bit in range(z - 1, -1, -1):
        half, low = 1 << bit, (1 << bit) - 1
        sql = f"SELECT * EXCLUDE (hx, hy, d, rx, ry), CASE WHEN ry = 1 THEN hx & {low} WHEN rx = 1 THEN {low} - (hy & {low}) ELSE hy & {low} END AS hx, CASE WHEN ry = 1 THEN hy & {low} WHEN rx = 1 THEN {low} - (hx & {low}) ELSE hx & {low} END AS hy, d + {half * half} * xor(rx * 3, ry) AS d FROM (SELECT *, (hx >> {bit}) & 1 AS rx, (hy >> {bit}) & 1 AS ry FROM ({sql}))"
    return f"SELECT * EXCLUDE (hx, hy, d), d AS tile_id FROM ({sql})"


# Scans, projections, predicates.


@query("SELECT fid, class_key, price FROM boxes ORDER BY fid LIMIT 500", views.BOXES)
def s31_scan_cap_ordered(spark, d):
    """The scan cap: at most 500 features of a window, in key order."""
    return vector.capped(views.boxes(spark, d), 500, "fid")[0].select("fid", "class_key", "price")


@query("SELECT col, row, CASE WHEN CAST(b2 AS FLOAT) + CAST(b1 AS FLOAT) = 0 THEN NULL ELSE round(CAST(CAST(CAST(CAST(b2 AS FLOAT) - CAST(b1 AS FLOAT) AS FLOAT) / CAST(CAST(b2 AS FLOAT) + CAST(b1 AS FLOAT) AS FLOAT) AS FLOAT) AS DOUBLE), 5) END AS value FROM pixels", views.PIXELS)
def p02_bandmath_ndvi(spark, d):
    """A normalized difference of two bands in 32-bit floats."""
    rows = raster.band_math(views.pixels(spark, d), "(B2 - B1) / (B2 + B1)")
    return rows.select("col", "row", F.when(F.isnan("value"), None).otherwise(F.round(F.col("value").cast("double"), 5)).alias("value"))


@query("SELECT col, row, round(CAST(least(greatest(CAST(CAST(b1 AS FLOAT) * CAST(2.0 AS FLOAT) AS FLOAT), CAST(10 AS FLOAT)), CAST(80 AS FLOAT)) AS DOUBLE), 4) AS c, round(CAST(greatest(CAST(b3 AS FLOAT), CAST(b4 AS FLOAT)) AS DOUBLE), 5) AS m FROM pixels", views.PIXELS)
def p02_bandmath_clamp_minmax(spark, d):
    """clamp, max and a product."""
    p = raster.band_math(views.pixels(spark, d), "clamp(B1 * 2, 10, 80)", out="c")
    p = raster.band_math(p, "max(B3, B4)", out="m")
    return p.select("col", "row", F.round(F.col("c").cast("double"), 4).alias("c"), F.round(F.col("m").cast("double"), 5).alias("m"))


@query("SELECT col, row, CASE WHEN abs(b1 - 25) < 0.5 OR abs(b4 - 25) < 0.5 THEN NULL ELSE round(CAST(CAST(b1 AS FLOAT) + CAST(b4 AS FLOAT) AS DOUBLE), 4) END AS value FROM pixels", views.PIXELS)
def p04_nodata_mask(spark, d):
    """A pixel with a referenced band within 0.5 of nodata has no value."""
    p = raster.band_math(views.pixels(spark, d), "B1 + B4", nodata=25)
    return p.select("col", "row", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("SELECT event_id FROM events WHERE coalesce(value > 50, false) AND coalesce(event_type <> 'error', false)")
def p06_filter_cmp(spark, d):
    """Numeric and string comparisons."""
    tree = filters.And((filters.Compare("value", ">", "50"), filters.Compare("event_type", "<>", "error")))
    return views.table(spark, d, "events").filter(filters.column(tree, event_fields())).select("event_id")


@query("SELECT event_id FROM events WHERE coalesce(value BETWEEN 10 AND 20, false) OR coalesce(event_type BETWEEN 'p' AND 's', false)")
def p07_between(spark, d):
    """Between on numbers and on strings."""
    tree = filters.Or((filters.Between("value", "10", "20"), filters.Between("event_type", "p", "s")))
    return views.table(spark, d, "events").filter(filters.column(tree, event_fields())).select("event_id")


@query("SELECT fid, name FROM boxes WHERE name LIKE '%-H_GH%' OR name LIKE '5%'", views.BOXES)
def p08_like(spark, d):
    """Like patterns."""
    tree = filters.Or((filters.Like("name", "%-H_GH%"), filters.Like("name", "5%")))
    return views.boxes(spark, d).filter(filters.column(tree, box_fields())).select("fid", "name")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS missing FROM events")
def p09_isnull(spark, d):
    """Absent and null are one."""
    e = views.table(spark, d, "events")
    flags = e.select(filters.column(filters.IsNull("nowhere"), event_fields()).alias("a"), filters.column(filters.IsNull("value"), event_fields()).alias("b"))
    return flags.agg(F.count_if("a").alias("n"), F.count_if("b").alias("missing"))


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT coalesce(value < 30, false) AND (coalesce(event_type = 'click', false) OR coalesce(value >= 90, false)) GROUP BY event_type")
def p10_bool_tree(spark, d):
    """And, Or and Not over two-valued leaves; empty And is true, empty Or false."""
    tree = filters.And((filters.Not(filters.Compare("value", "<", "30")), filters.Or((filters.Compare("event_type", "=", "click"), filters.Compare("value", ">=", "90"), filters.Or(()))), filters.And(())))
    return views.table(spark, d, "events").filter(filters.column(tree, event_fields())).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


RULES = (
    style.Rule("big", filters.Compare("area", ">=", "100")),
    style.Rule("open", filters.Compare("class_key", "=", "O")),
    style.Rule("late", filters.Compare("class_key", "=", "F"), least=1000.0, most=2000.0),
    style.Rule("rest", otherwise=True, most=9000.0),
    style.Rule("last", otherwise=True),
)


@query(
    "SELECT fid, unnest(CASE WHEN len(m) > 0 THEN m ELSE [3] END) AS rule FROM (SELECT fid, list_filter([CASE WHEN area >= 100 THEN 0 END, CASE WHEN class_key = 'O' THEN 1 END, CASE WHEN class_key = 'F' THEN 2 END], lambda x: x IS NOT NULL) AS m FROM boxes)",
    views.BOXES,
)
def p15_rule_select(spark, d):
    """Rules of each feature at a scale: all that match, else the first active else-rule."""
    return views.boxes(spark, d).select("fid", F.explode(style.chosen_column(RULES, box_fields(), 1500.0)).alias("rule"))


@query("SELECT fid FROM boxes WHERE maxx >= 200 AND minx <= 450 AND maxy >= 300 AND miny <= 420", views.BOXES)
def p16_bbox_window(spark, d):
    """A window on stored boxes; touching counts."""
    return joins.window(views.boxes(spark, d), (200.0, 300.0, 450.0, 420.0)).select("fid")


@query("SELECT fid, area FROM boxes WHERE NOT (area > 0 AND area < 40)", views.BOXES)
def p17_size_gate(spark, d):
    """The least feature size."""
    return joins.size_gate(views.boxes(spark, d), 40.0).select("fid", "area")


@query("SELECT z, count(*) AS kept FROM boxes, (VALUES (0), (1), (2), (3), (4), (5)) AS t(z) WHERE area >= 4 * (1024.0 / 256 / (1 << z)) * (1024.0 / 256 / (1 << z)) GROUP BY z", views.BOXES)
def p18_gate_by_zoom(spark, d):
    """Features that pass each zoom's gate of four square pixels: one pass, from the lowest zoom that keeps a feature on."""
    b = views.boxes(spark, d)
    kept = [F.when(F.col("area") >= grids.gate_for_grid(LOCAL, z, LOCAL_CRS, 0.0, 4.0), F.lit(z)) for z in range(6)]
    return b.select(F.explode(F.array_compact(F.array(*kept))).alias("z")).groupBy("z").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT fid, 'Order ' || class_key || ' / ' || CAST(CAST(area AS BIGINT) AS VARCHAR) || '' AS label FROM boxes", views.BOXES)
def p22_label_eval(spark, d):
    """Label templates; absent fields are empty, whole numbers have no fraction."""
    parts = (("text", "Order "), ("field", "class_key"), ("text", " / "), ("field", "area"), ("field", "nowhere"))
    return views.boxes(spark, d).select("fid", style.label_column(parts, box_fields()).alias("label"))


@query("SELECT fid, CASE WHEN price IS NULL THEN 1e300 ELSE -price END AS sort_key FROM boxes", views.BOXES)
def p23_priority(spark, d):
    """Label priority, higher first."""
    key = style.priority_column("price", True, box_fields())
    return views.boxes(spark, d).select("fid", F.when(key == math.inf, 1e300).otherwise(key).alias("sort_key"))


@query("SELECT DISTINCT p_type, array_to_string(list_slice(string_split(replace(p_type, ' ', '.'), '.'), 1, 2), '.') AS rolled FROM part")
def p26_class_rollup(spark, d):
    """The first two levels of a dotted class."""
    rows = views.table(spark, d, "part").select("p_type", F.translate("p_type", " ", ".").alias("dotted")).distinct()
    return rows.select("p_type", style.class_of("dotted", 2).alias("rolled"))


# Grids.


@query("SELECT fid, col, row, CAST(col * 64 AS DOUBLE) AS minx, CAST(1024 - row * 64 - 64 AS DOUBLE) AS miny, CAST(col * 64 + 64 AS DOUBLE) AS maxx, CAST(1024 - row * 64 AS DOUBLE) AS maxy FROM cells WHERE col < 16 AND row < 16", views.CELLS)
def g01_tile_bounds(spark, d):
    """Boxes of tiles; none outside the level."""
    c = views.cells(spark, d)
    return c.select("fid", "col", "row", *grids.tile_bounds(LOCAL, 4, F.col("col"), F.col("row"))).filter("minx IS NOT NULL")


@query("SELECT fid, greatest(0, CAST(floor(minx / 64) AS BIGINT)) AS c0, least(15, CAST(ceil(maxx / 64) AS BIGINT) - 1) AS c1, greatest(0, CAST(floor((1024 - maxy) / 64) AS BIGINT)) AS r0, least(15, CAST(ceil((1024 - miny) / 64) AS BIGINT) - 1) AS r1 FROM boxes", views.BOXES)
def g03_tile_cover(spark, d):
    """Tile ranges of boxes."""
    c = grids.cover(LOCAL, 4, *[F.col(k) for k in ("minx", "miny", "maxx", "maxy")])
    return views.boxes(spark, d).select("fid", c.alias("c")).filter("c IS NOT NULL").select("fid", "c.c0", "c.c1", "c.r0", "c.r1")


@query(f"SELECT z, round({grids.WORLD!r} / 256 / (1 << z) / 0.00028, 4) AS denominator FROM (SELECT DISTINCT r_regionkey AS z FROM region)")
def g04_scale_denominator(spark, d):
    """Scale denominators of the mercator grid's levels."""
    levels = WEB.table(spark).select(F.col("z").cast("long").alias("z"), (F.col("resolution") * grids.metres_per_unit(WEB.crs) / grids.STANDARD_PIXEL).alias("s"))
    zs = views.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("z")).distinct()
    return zs.join(F.broadcast(levels), "z").select(F.col("z").cast("int").alias("z"), F.round("s", 4).alias("denominator"))


@query("SELECT fid, 15 - row AS tms_row FROM cells WHERE row < 16", views.CELLS)
def g07_tms_flip(spark, d):
    """Rows counted from the bottom."""
    return views.cells(spark, d).filter("row < 16").select("fid", grids.flipped_row(LOCAL, 4, F.col("row")).alias("tms_row"))


@query("SELECT fid, tile_id FROM (" + _hilbert_sql(6, "SELECT fid, fid * 13 % 64 AS x, fid * 29 % 64 AS y FROM boxes") + ")", views.BOXES)
def g08_hilbert_id(spark, d):
    """Archive ids of tiles."""
    b = views.boxes(spark, d).select("fid", F.expr("fid * 13 % 64").alias("x"), F.expr("fid * 29 % 64").alias("y"))
    return b.select("fid", grids.hilbert_id(F.lit(6), F.col("x"), F.col("y")).alias("tile_id"))


@query(f"SELECT fid, round({_X}, 3) AS x, round({_Y}, 3) AS y FROM points", views.POINTS)
def g10_mercator_forward(spark, d):
    """Degrees to web mercator metres."""
    x, y = grids.mercator(F.col("lon"), F.col("lat"))
    return views.points(spark, d).select("fid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _point_tiles(spark: SparkSession, d: str, z: int) -> DataFrame:
    x, y = grids.mercator(F.col("lon"), F.col("lat"))
    p = views.points(spark, d).withColumn("minx", x).withColumn("miny", y).withColumn("maxx", x).withColumn("maxy", y)
    return grids.covered_tiles(p, WEB, z, touching=True)


_TILE = f"floor((px + {grids.WORLD / 2!r}) / {grids.WORLD / 64!r})", f"floor(({grids.WORLD / 2!r} - py) / {grids.WORLD / 64!r})"


@query(
    "SELECT x, y, tile_id, count(*) AS n, round(sum(value), 2) AS total FROM ("
    + _hilbert_sql(6, f"SELECT value, CAST({_TILE[0]} AS BIGINT) AS x, CAST({_TILE[1]} AS BIGINT) AS y FROM (SELECT value, {_X} AS px, {_Y} AS py FROM points WHERE coalesce(event_type <> 'error', false))")
    + ") GROUP BY 1, 2, 3",
    views.POINTS,
)
def tile_heat(spark, d):
    """The flagship: filtered points counted by tile, with archive ids."""
    keep = filters.column(filters.Compare("event_type", "<>", "error"), event_fields())
    t = _point_tiles(spark, d, 6).filter(keep)
    t = t.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return t.select("x", "y", grids.hilbert_id(F.lit(6), F.col("x"), F.col("y")).alias("tile_id"), "n", "total")


# Joins.


@query("SELECT x, y, count(*) AS features, sum(area) AS area FROM (SELECT area, unnest(range(greatest(0, CAST(floor(minx / 64) AS BIGINT)), least(15, CAST(ceil(maxx / 64) AS BIGINT) - 1) + 1)) AS x, r0, r1 FROM (SELECT *, greatest(0, CAST(floor((1024 - maxy) / 64) AS BIGINT)) AS r0, least(15, CAST(ceil((1024 - miny) / 64) AS BIGINT) - 1) AS r1 FROM boxes)) AS a, LATERAL (SELECT unnest(range(r0, r1 + 1)) AS y) GROUP BY x, y", views.BOXES)
def j02_tile_feature_join(spark, d):
    """Features of every tile of a level."""
    t = joins.tile_features(views.boxes(spark, d), LOCAL, 4)
    return t.groupBy("x", "y").agg(F.count(F.lit(1)).alias("features"), F.sum("area").alias("area"))


_QUERIES = "queries AS (SELECT c_custkey AS query_id, CAST(c_custkey * 53 % 4000 AS DOUBLE) / 4 AS px, CAST(c_custkey * 71 % 4000 AS DOUBLE) / 4 AS py FROM customer)"


def _query_points(spark: SparkSession, d: str) -> DataFrame:
    q = views.table(spark, d, "customer")
    return q.select(F.col("c_custkey").alias("query_id"), F.expr("CAST(c_custkey * 53 % 4000 AS DOUBLE) / 4D").alias("px"), F.expr("CAST(c_custkey * 71 % 4000 AS DOUBLE) / 4D").alias("py"))


@query("SELECT query_id, fid FROM queries, boxes WHERE px >= minx AND px < maxx AND py >= miny AND py < maxy", _QUERIES, views.BOXES)
def j03_point_in_polygon(spark, d):
    """Query points in polygons, by cells and the even-odd rule on rings."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(at("minx", "miny"), at("maxx", "miny"), at("maxx", "maxy"), at("minx", "maxy"))
    polys = views.boxes(spark, d).withColumn("geom", F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("parts")))
    return joins.points_in_polygons(_query_points(spark, d), polys, 32.0).select("query_id", "fid")


_HITS = "SELECT query_id, fid, (minx - px) * (minx - px) + (miny - py) * (miny - py) AS d2 FROM queries, boxes WHERE (minx - px) * (minx - px) + (miny - py) * (miny - py) <= 36"


@query(f"SELECT query_id, fid, d2, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, fid) AS INTEGER) AS rank FROM ({_HITS})) WHERE rank <= 3", _QUERIES, views.BOXES)
def j04_nearest_points(spark, d):
    """The three nearest point features within six units."""
    f = views.boxes(spark, d).select("fid", F.col("minx").alias("fx"), F.col("miny").alias("fy"))
    return joins.nearest_points(_query_points(spark, d), f, 6.0, 3).select("query_id", "fid", "d2", F.col("rank").cast("int").alias("rank"))


@query("SELECT grid_col, grid_row, count(*) AS pixels, max(b1) AS b1 FROM (SELECT b1, col // 64 AS grid_col, row // 64 AS grid_row FROM pixels) GROUP BY 1, 2", views.PIXELS)
def j05_pixel_chunk_join(spark, d):
    """Pixels by the chunk that holds them."""
    p = views.pixels(spark, d)
    return p.select("b1", *raster.chunk_of(F.col("col"), F.col("row"), 64, 64)).groupBy("grid_col", "grid_row").agg(F.count(F.lit(1)).alias("pixels"), F.max("b1").alias("b1"))


_TILES = "base AS (SELECT o_custkey AS tile_id, min(o_orderpriority) AS blob FROM orders GROUP BY 1)", "over AS (SELECT c_custkey AS tile_id, c_mktsegment AS blob FROM customer WHERE c_custkey % 3 = 0)"


def _base(spark, d):
    return views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("tile_id")).agg(F.min("o_orderpriority").alias("blob"))


def _overlay(spark, d):
    return views.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("tile_id"), F.col("c_mktsegment").alias("blob"))


@query("SELECT coalesce(b.tile_id, o.tile_id) AS tile_id, coalesce(o.blob, b.blob) AS blob, o.blob IS NOT NULL AS from_overlay FROM base b FULL JOIN over o ON b.tile_id = o.tile_id", *_TILES)
def j06_overlay_over_base(spark, d):
    """Overlay tiles win over archived ones."""
    return joins.overlay_over_base(_base(spark, d), _overlay(spark, d))


@query("SELECT p_partkey AS tile_id FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)")
def j07_missing_tiles(spark, d):
    """Tiles that the archive lacks."""
    return joins.missing_tiles(views.table(spark, d, "part").select(F.col("p_partkey").alias("tile_id")), _base(spark, d))


_NET = "net AS (SELECT class_key, CASE WHEN f THEN ax ELSE bx END AS ax, CASE WHEN f THEN ay ELSE by_ END AS ay, CASE WHEN f THEN bx ELSE ax END AS bx, CASE WHEN f THEN by_ ELSE ay END AS by_, sum(CASE WHEN f THEN 1 ELSE -1 END) AS s FROM (SELECT *, ax < bx OR (ax = bx AND ay < by_) AS f FROM edges) GROUP BY 1, 2, 3, 4, 5)"


@query("SELECT class_key, CASE WHEN s > 0 THEN ax ELSE bx END AS ax, CASE WHEN s > 0 THEN ay ELSE by_ END AS ay, CASE WHEN s > 0 THEN bx ELSE ax END AS bx, CASE WHEN s > 0 THEN by_ ELSE ay END AS by_, CAST(abs(s) AS BIGINT) AS n FROM net WHERE s <> 0", views.CELLS, views.CORNERS, views.EDGES, _NET)
def j08_edge_cancel(spark, d):
    """Edges of each class that are left when each meets its opposite."""
    return joins.cancel_edges(aggregates.ring_edges(views.coverage(spark, d), "ring", "class_key"), ["class_key"])


# Aggregations and ordered operators.


@query("SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM boxes", views.BOXES)
def a01_layer_extent(spark, d):
    """The layer's box."""
    return aggregates.extent(views.boxes(spark, d))


@query("SELECT fid, round((maxx - minx) * (maxy - miny), 6) AS ring_area FROM boxes", views.BOXES)
def a02_ring_area(spark, d):
    """Shoelace area of rings, by a fold."""
    b = views.boxes(spark, d)
    xs, ys = F.array("minx", "maxx", "maxx", "minx"), F.array("miny", "miny", "maxy", "maxy")
    cross = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, i: s + F.get(xs, i) * F.get(ys, (i + 1) % 4) - F.get(xs, (i + 1) % 4) * F.get(ys, i))
    return b.select("fid", F.round(F.abs(cross) / 2, 6).alias("ring_area"))


_ATTRIBUTES = "attributes AS (SELECT event_id AS ord, 'value' AS field, CASE WHEN value IS NULL THEN NULL ELSE 'Number' END AS kind FROM events UNION ALL SELECT event_id, 'event_type', CASE WHEN event_type IS NULL THEN NULL ELSE 'String' END FROM events UNION ALL SELECT event_id, 'mixed', CASE WHEN event_id % 7 < 3 THEN NULL WHEN event_id % 2 = 0 THEN 'Number' ELSE 'String' END FROM events)"


@query("SELECT field, arg_min(kind, ord) AS type FROM attributes WHERE kind IS NOT NULL GROUP BY field", _ATTRIBUTES)
def a03_schema(spark, d):
    """Field types by first value."""
    e = views.table(spark, d, "events")
    kinds = F.array(
        F.struct(F.lit("value").alias("field"), F.when(F.col("value").isNotNull(), "Number").alias("kind")),
        F.struct(F.lit("event_type").alias("field"), F.when(F.col("event_type").isNotNull(), "String").alias("kind")),
        F.struct(F.lit("mixed").alias("field"), F.when(F.col("event_id") % 7 >= 3, F.when(F.col("event_id") % 2 == 0, "Number").otherwise("String")).alias("kind")),
    )
    return aggregates.field_schema(e.select(F.col("event_id").alias("ord"), F.inline(kinds)))


@query("SELECT class_key, first_ord, CAST(row_number() OVER (ORDER BY first_ord, class_key) AS INTEGER) AS class_index FROM (SELECT class_key, min(fid) AS first_ord FROM cells GROUP BY 1)", views.CELLS)
def a04_palette(spark, d):
    """Classes by first appearance."""
    return aggregates.palette(views.cells(spark, d).select("class_key", F.col("fid").alias("ord"))).select("class_key", "first_ord", F.col("class_index").cast("int").alias("class_index"))


_COVERED = "covered AS (SELECT fid, class_key, x AS col, y AS row FROM boxes, LATERAL (SELECT unnest(range(CAST(ceil(minx / 8 - 0.5) AS BIGINT), CAST(ceil(maxx / 8 - 0.5) AS BIGINT))) AS x), LATERAL (SELECT unnest(range(CAST(ceil(miny / 8 - 0.5) AS BIGINT), CAST(ceil(maxy / 8 - 0.5) AS BIGINT))) AS y))"


def _covered(spark, d):
    """Cells of eight units whose centres are in a box."""
    at = lambda c: F.ceil(F.col(c) / 8.0 - 0.5).cast("long")
    b = views.boxes(spark, d).withColumn("c1", at("maxx") - 1).withColumn("r1", at("maxy") - 1).filter((at("minx") <= F.col("c1")) & (at("miny") <= F.col("r1")))
    b = b.withColumn("col", F.explode(F.sequence(at("minx"), F.col("c1")))).withColumn("row", F.explode(F.sequence(at("miny"), F.col("r1"))))
    return b.select("class_key", "col", "row", F.col("fid").alias("ord"))


@query("SELECT col, row, arg_max(class_key, fid) AS class_key FROM covered GROUP BY 1, 2", views.BOXES, _COVERED)
def a07_cell_mosaic(spark, d):
    """The last feature's class in each cell."""
    return aggregates.cell_mosaic(_covered(spark, d), [])


@query("SELECT ax, ay, bx, by_, count(*) AS degree FROM (SELECT CASE WHEN f THEN ax ELSE bx END AS ax, CASE WHEN f THEN ay ELSE by_ END AS ay, CASE WHEN f THEN bx ELSE ax END AS bx, CASE WHEN f THEN by_ ELSE ay END AS by_ FROM (SELECT *, ax < bx OR (ax = bx AND ay < by_) AS f FROM edges)) GROUP BY 1, 2, 3, 4", views.CELLS, views.CORNERS, views.EDGES)
def a08_arc_degree(spark, d):
    """How many squares share each edge."""
    return aggregates.edge_degrees(aggregates.ring_edges(views.coverage(spark, d), "ring"))


_TRIOS = "trios AS (SELECT x0 AS x, y0 AS y, [x0, y1] AS a, [x1, y0] AS b FROM corners UNION ALL SELECT x1, y0, [x0, y0], [x1, y1] FROM corners UNION ALL SELECT x1, y1, [x1, y0], [x0, y1] FROM corners UNION ALL SELECT x0, y1, [x1, y1], [x0, y0] FROM corners)"


@query("SELECT x, y, count(*) AS pairs FROM (SELECT DISTINCT x, y, least(a, b) AS l, greatest(a, b) AS r FROM trios) GROUP BY 1, 2 HAVING count(*) > 1", views.CELLS, views.CORNERS, _TRIOS)
def a09_junctions(spark, d):
    """Vertices where more than two ways meet."""
    return aggregates.junctions(views.coverage(spark, d), "ring")


_BLOBS = "tiles AS (SELECT p_partkey AS tile_id, p_type AS blob FROM part)"


@query("SELECT sha256(blob) AS content, min(tile_id) AS first_tile, count(*) AS tiles FROM tiles GROUP BY 1", _BLOBS)
def a10_tile_dedup(spark, d):
    """Distinct tile contents."""
    return aggregates.content_ids(views.table(spark, d, "part").select(F.col("p_partkey").alias("tile_id"), F.col("p_type").alias("blob")))


_RUN_TILES = "t AS (SELECT p_partkey AS tile_id, CASE WHEN p_partkey % 100 < 60 THEN 'sea' ELSE p_brand END AS content FROM part WHERE p_partkey % 17 <> 0)"
_RUNS = "SELECT min(tile_id) AS tile_id, count(*) AS run_length, content FROM (SELECT *, tile_id - row_number() OVER (PARTITION BY content ORDER BY tile_id) AS i FROM t) GROUP BY content, i"


def _run_tiles(spark, d):
    return views.table(spark, d, "part").filter("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("tile_id"), F.expr("CASE WHEN p_partkey % 100 < 60 THEN 'sea' ELSE p_brand END").alias("content"))


@query(_RUNS, _RUN_TILES)
def w02_archive_rle(spark, d):
    """Runs of consecutive tiles with one content."""
    return aggregates.archive_runs(_run_tiles(spark, d), chunk=64)


@query(f"SELECT CAST(sum(run_length) AS BIGINT) AS addressed, count(*) AS entries, count(DISTINCT content) AS contents FROM ({_RUNS})", _RUN_TILES)
def a16_archive_counts(spark, d):
    """What a directory addresses."""
    return aggregates.archive_counts(aggregates.archive_runs(_run_tiles(spark, d)))


@query("SELECT tile_id + unnest(range(run_length)) AS tile_id, content FROM (" + _RUNS + ")", _RUN_TILES)
def s26_archive_ids(spark, d):
    """All ids of a directory, its runs expanded."""
    runs = aggregates.archive_runs(_run_tiles(spark, d))
    return runs.select(F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)).alias("tile_id"), "content")


@query("SELECT row, class_key, min(col) AS col0, max(col) + 1 AS col1 FROM (SELECT *, col - row_number() OVER (PARTITION BY row, class_key ORDER BY col) AS i FROM (SELECT col, row, arg_max(class_key, fid) AS class_key FROM covered GROUP BY 1, 2)) GROUP BY row, class_key, i", views.BOXES, _COVERED)
def w01_run_rects(spark, d):
    """Runs of equal mosaic cells."""
    return aggregates.row_runs(aggregates.cell_mosaic(_covered(spark, d), []), [])


@query("SELECT query_id, fid, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind_order, dist, ord) AS rank FROM (SELECT query_id, fid, 0 AS kind_order, CAST(0 AS DOUBLE) AS dist, fid AS ord FROM queries, boxes WHERE px >= minx AND px < maxx AND py >= miny AND py < maxy UNION ALL SELECT query_id, fid, 1, d2, fid FROM (" + _HITS + "))) WHERE rank <= 5", _QUERIES, views.BOXES)
def w07_gfi_rank(spark, d):
    """Hits of a feature info request in their order."""
    hits = joins.first_hits(_query_points(spark, d), views.boxes(spark, d), 32.0, 6.0, 5)
    return hits.select("query_id", "fid", F.col("rank").cast("int").alias("rank"))


@query("SELECT tile_id, seq, blob FROM (SELECT o_custkey AS tile_id, o_orderkey AS seq, o_orderpriority AS blob, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def w09_latest_wins(spark, d):
    """The last record of each tile."""
    return aggregates.latest(views.table(spark, d, "orders").select(F.col("o_custkey").alias("tile_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("blob")))


_STEPS = "ranked AS (SELECT class_key, fid, row_number() OVER (PARTITION BY class_key ORDER BY fid) - 1 AS k, count(*) OVER (PARTITION BY class_key) AS n FROM boxes), steps AS (SELECT DISTINCT class_key, n, CAST(0 AS DOUBLE) AS nxt FROM ranked UNION ALL SELECT class_key, n, nxt + CAST(n AS DOUBLE) / 100 FROM steps WHERE nxt + CAST(n AS DOUBLE) / 100 < n)"


@query("SELECT r.class_key, r.fid FROM ranked r WHERE r.n <= 100 UNION ALL SELECT r.class_key, r.fid FROM ranked r JOIN steps s ON r.class_key = s.class_key AND r.k = ceil(s.nxt) WHERE r.n > 100", "RECURSIVE " + views.BOXES, _STEPS)
def w03_uniform_sample(spark, d):
    """An even sample of a hundred features a class, by id (sampling is the feature)."""
    return aggregates.sampled(views.boxes(spark, d), ["class_key"], "fid", 100).select("class_key", "fid")


@query("SELECT fid, CAST(row_number() OVER (ORDER BY passthrough, class_key, fid) - 1 AS BIGINT) AS new_fid FROM (SELECT CAST(p_size AS BIGINT) AS fid, 0 AS passthrough, min(p_brand) AS class_key FROM part GROUP BY 1)")
def w10_renumber(spark, d):
    """New feature ids: classes first, in the order of their keys."""
    from pyspark.sql.window import Window

    rows = views.table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("fid")).agg(F.lit(0).alias("passthrough"), F.min("p_brand").alias("class_key"))
    return rows.select("fid", (F.row_number().over(Window.orderBy("passthrough", "class_key", "fid")) - 1).cast("long").alias("new_fid"))


@query("SELECT tile_id, blob FROM (SELECT b.tile_id, b.blob FROM base b ANTI JOIN over o ON b.tile_id = o.tile_id UNION ALL SELECT tile_id, blob FROM over)", *_TILES)
def u01_compact(spark, d):
    """Base and overlay compacted into one archive."""
    return overlay.compacted(_base(spark, d), _overlay(spark, d).withColumn("seq", F.lit(0).cast("long")))


# Raster.

RAMP = style.Ramp(((0.0, (0, 0, 128, 255)), (20.0, (0, 200, 0, 255)), (50.0, (250, 250, 250, 128))))
_LEVELS = "targets AS (SELECT i, j, (i + 0.5) * 1.6 AS u, (j + 0.5) * 1.6 AS v FROM (SELECT unnest(range(160)) AS i), (SELECT unnest(range(160)) AS j))"


def _targets(spark):
    """A request of 160 x 160 pixels over the raster of 256 x 256."""
    return raster.source_pixels(raster.request_pixels(spark, (0.0, 0.0, 256.0, 256.0), 160, 160), (0.0, 256.0), (1.0, 1.0))


@query("SELECT i, j, b1, b2 FROM targets LEFT JOIN pixels ON floor(u) = col AND floor(v) = row", _LEVELS, views.PIXELS)
def r03_warp_nearest(spark, d):
    """Nearest resampling."""
    return raster.warp_nearest(_targets(spark), views.pixels(spark, d), ["b1", "b2"])


@query(
    "SELECT i, j, round(sum(w * b1) / sum(w), 6) AS b1 FROM (SELECT t.i, t.j, greatest(0, 1 - abs(t.col + 0.5 - t.u) / 1.6) * greatest(0, 1 - abs(t.row + 0.5 - t.v) / 1.6) AS w, p.b1 FROM (SELECT i, j, u, v, col, unnest(range(CAST(ceil(v - 2.1) AS BIGINT), CAST(floor(v + 1.1) AS BIGINT) + 1)) AS row FROM (SELECT i, j, u, v, unnest(range(CAST(ceil(u - 2.1) AS BIGINT), CAST(floor(u + 1.1) AS BIGINT) + 1)) AS col FROM targets)) t JOIN pixels p ON p.col = t.col AND p.row = t.row) WHERE w > 1e-12 GROUP BY i, j",
    _LEVELS, views.PIXELS,
)
def r04_warp_bilinear(spark, d):
    """Tent resampling with a radius of 1.6 source pixels."""
    t = raster.warp_bilinear(_targets(spark), views.pixels(spark, d), "b1", scale=1.6)
    return t.select("i", "j", F.round("b1", 6).alias("b1"))


_CHANNEL = lambda k: f"CAST(CASE WHEN b1 <= 0 THEN {RAMP.stops[0][1][k]} WHEN b1 <= 20 THEN round({float(RAMP.stops[0][1][k])} + {float(RAMP.stops[1][1][k] - RAMP.stops[0][1][k])} * (b1 / 20)) WHEN b1 <= 50 THEN round({float(RAMP.stops[1][1][k])} + {float(RAMP.stops[2][1][k] - RAMP.stops[1][1][k])} * ((b1 - 20) / 30)) ELSE {RAMP.stops[2][1][k]} END AS INTEGER)"


@query(f"SELECT col, row, {_CHANNEL(0)} AS r, {_CHANNEL(1)} AS g, {_CHANNEL(2)} AS b, {_CHANNEL(3)} AS a FROM pixels", views.PIXELS)
def r06_colorize(spark, d):
    """Pseudocolour of a band."""
    return raster.colourized(views.pixels(spark, d).select("col", "row", F.col("b1").alias("value")), RAMP).drop("value")


@query("SELECT col, row, CAST(floor(b1) AS INTEGER) AS r, CAST(floor(b3 * 1000) AS INTEGER) AS g, CAST(floor(b4 * 1000) AS INTEGER) AS b, 255 AS a FROM pixels", views.PIXELS)
def r07_rgb(spark, d):
    """Bands as red, green and blue."""
    p = views.pixels(spark, d).select("col", "row", F.floor("b1").alias("b1"), F.floor(F.col("b4") * 1000).alias("b2"), F.floor(F.col("b3") * 1000).alias("b3"))
    return raster.rgb(p, style.Bands(1, 3, 2))


@query("SELECT query_id, in_image, b1, b2, CASE WHEN b1 IS NULL THEN NULL ELSE round(CAST(CAST(b2 AS FLOAT) - CAST(b1 AS FLOAT) AS DOUBLE), 2) END AS derived FROM (SELECT query_id, px / 3 AS u, py / 3 AS v, px / 3 < 256 AND py / 3 < 256 AS in_image FROM queries) LEFT JOIN pixels ON floor(u) = col AND floor(v) = row", _QUERIES, views.PIXELS)
def r09_point_sample(spark, d):
    """Band values at points."""
    q = _query_points(spark, d).select("query_id", (F.col("px") / 3).alias("u"), (F.col("py") / 3).alias("v"))
    out = raster.point_sample(q, views.pixels(spark, d), ["b1", "b2"], (256, 256), expression="B2 - B1")
    return out.select("query_id", "in_image", "b1", "b2", F.round(F.col("derived").cast("double"), 2).alias("derived"))


@query(f"SELECT col, row, (r * a + 255 * (255 - a)) // 255 AS r, (g * a + 200 * (255 - a)) // 255 AS g, (b * a + 100 * (255 - a)) // 255 AS b, 255 AS a FROM (SELECT col, row, {_CHANNEL(0)} AS r, {_CHANNEL(1)} AS g, {_CHANNEL(2)} AS b, {_CHANNEL(3)} AS a FROM pixels)", views.PIXELS)
def r11_flatten(spark, d):
    """Pseudocolour on a background."""
    return raster.flattened(r06_colorize(spark, d), (255, 200, 100))


@query("SELECT col, row, b1 FROM pixels WHERE col < 200 AND row < 180", views.PIXELS)
def r13_image_extent(spark, d):
    """Padding beyond the image's size is left out."""
    return views.pixels(spark, d).filter("col < 200 AND row < 180").select("col", "row", "b1")


# Vector tiles, topology, archives, labels.


def _counted(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("long")
    def n(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: mvt.count_features(bytes(b)))

    return rows.select("z", "x", "y", "tile_id", n("blob").alias("features"))


def _tile_sql(z: int) -> str:
    span = 1024 >> z
    return f"SELECT CAST({z} AS INTEGER) AS z, x, y, count(*) AS features FROM boxes, (SELECT unnest(range({1 << z})) AS x), (SELECT unnest(range({1 << z})) AS y) WHERE maxx > x * {span} - {span} / 16.0 AND minx < x * {span} + {span} * 17 / 16.0 AND maxy > 1024 - (y + 1) * {span} - {span} / 16.0 AND miny < 1024 - y * {span} + {span} / 16.0 GROUP BY x, y"


@query(_tile_sql(3), views.BOXES)
def m01_mvt_tiles(spark, d):
    """Features that each vector tile of a level encodes, buffer included."""
    return _counted(tiles.encoded(views.box_features(spark, d), LOCAL, 3, LOCAL_CRS, "boxes")).drop("tile_id")


@query("SELECT * FROM (" + " UNION ALL ".join(_tile_sql(z) for z in range(3)) + ")", views.BOXES)
def k01_pyramid(spark, d):
    """A pyramid of three levels; every tile is made whole and its features are counted where it was made."""
    made = tiles.pyramid(views.box_features(spark, d), LOCAL, range(3), LOCAL_CRS, "boxes", read=mvt.count_features)
    return made.select("z", "x", "y", F.col("read").alias("features"))


@query("SELECT class_key, CAST(100 * count(*) AS BIGINT) AS area FROM cells GROUP BY 1", views.CELLS)
def a06_coverage_dissolve(spark, d):
    """Areas of classes after neighbours of one class are merged (exteriors less holes)."""
    rings = views.coverage(spark, d).select("class_key", F.col("ring").alias("pts"))
    out = topology.dissolved(rings, "class_key")
    return out.groupBy("class_key").agg((F.sum(topology.ring_area2("pts")) / 2).cast("long").alias("area"))


@query("SELECT CAST(sum(degree) AS BIGINT) AS piece_edges, count(*) AS arc_edges, count(*) FILTER (WHERE degree > 1) AS shared_edges FROM (SELECT count(*) AS degree FROM (SELECT CASE WHEN f THEN ax ELSE bx END AS ax, CASE WHEN f THEN ay ELSE by_ END AS ay, CASE WHEN f THEN bx ELSE ax END AS bx, CASE WHEN f THEN by_ ELSE ay END AS by_ FROM (SELECT *, ax < bx OR (ax = bx AND ay < by_) AS f FROM edges)) GROUP BY ax, ay, bx, by_)", views.CELLS, views.CORNERS, views.EDGES)
def t05_topology(spark, d):
    """Edges in ring pieces and in shared arcs: every edge of the coverage is in one arc."""
    refs = topology.ring_refs(topology.snapped_rings(views.cell_features(spark, d), 1.0))
    r = topology.report(refs, topology.arcs(refs))
    return r.select((F.col("piece_points") - F.col("pieces")).alias("piece_edges"), (F.col("arc_points") - F.col("arcs")).alias("arc_edges"), (F.col("shared_points") - F.col("shared")).alias("shared_edges"))


@query("SELECT fid, CAST(100 AS BIGINT) AS area FROM cells", views.CELLS)
def t06_round_trip(spark, d):
    """Areas of the rings that are put together from arcs again."""
    refs = topology.ring_refs(topology.snapped_rings(views.cell_features(spark, d), 1.0))
    again = topology.rebuilt(refs, topology.arcs(refs))
    return again.select("fid", F.floor(F.abs(topology.ring_area2("pts")) / 2).cast("long").alias("area"))


@query("SELECT z, count(*) AS rings, CAST(sum(100) AS BIGINT) AS area FROM cells, (VALUES (0), (1), (2)) AS t(z) GROUP BY z", views.CELLS)
def t10_levels_of_detail(spark, d):
    """Rings and areas of three levels of detail with a gate below every square's size."""
    refs = topology.ring_refs(topology.snapped_rings(views.cell_features(spark, d), 1.0))
    scale = grids.metres_per_pixel(0) ** 2
    lod = topology.levels_of_detail(refs, 1.0, scale, range(3), 0.5)
    return lod.groupBy("z").agg(F.count(F.lit(1)).alias("rings"), F.sum(F.floor(F.abs(topology.ring_area2("pts")) / 2).cast("long")).alias("area"))


_NEAR = "near AS (SELECT t.x, t.y, c.* FROM cells c, (SELECT unnest(range(4)) AS x) a, (SELECT unnest(range(4)) AS y) b, LATERAL (SELECT a.x, b.y) t WHERE c.col * 10 + 10 > t.x * 256 - 16 AND c.col * 10 < t.x * 256 + 272 AND c.row * 10 + 10 > 1024 - (t.y + 1) * 256 - 16 AND c.row * 10 < 1024 - t.y * 256 + 16)"


@query("SELECT CAST(2 AS INTEGER) AS z, x, y, count(DISTINCT class_key) AS features FROM near GROUP BY x, y", views.CELLS, _NEAR)
def a05_tile_dissolve(spark, d):
    """Merged classes in the tiles of a level; seams and areas are tested on small fixtures."""
    options = mvt.Options(dissolve_field="class", dissolve_zoom=3)
    return _counted(tiles.encoded(views.cell_features(spark, d).drop("class_key"), LOCAL, 2, LOCAL_CRS, "cells", options)).drop("tile_id")


@query("SELECT x, y, class_key, count(*) AS cells FROM (SELECT unnest(range(4)) AS x), (SELECT unnest(range(4)) AS y), (SELECT unnest(range(-2, 34)) AS k), (SELECT unnest(range(-2, 34)) AS r), cells WHERE col = floor((x * 256 + 8 * k + 4) / 10.0) AND row = ceil((1020 - y * 256 - 8 * r) / 10.0) - 1 GROUP BY 1, 2, 3", views.CELLS)
def m05_tile_mosaic(spark, d):
    """Cells of the dominant-class mosaic by tile and class."""
    cells = tiles.class_cells(views.cell_features(spark, d).drop("class_key"), LOCAL, 2, LOCAL_CRS, "class", 128)
    return cells.groupBy("x", "y", "class_key").agg(F.count(F.lit(1)).alias("cells"))


@query()
def w08_labels(spark, d):
    """Labels that find room, frame by frame."""
    b = views.boxes(spark, d)
    frame = (F.floor(F.col("minx") / 250) * 4 + F.floor(F.col("miny") / 250)).cast("long")
    items = b.select(frame.alias("frame"), "fid", F.coalesce(-F.col("price"), F.lit(0.0)).alias("priority"), (F.col("minx") % 250 * 4).alias("x"), (F.col("miny") % 250 * 4).alias("y"), F.lit(3.0).alias("radius"), F.lit(2.0).alias("offset"), (F.length("name") * 6.0).alias("width"), F.lit(12.0).alias("height"))
    return labels.place(items)


from . import kernels  # noqa: E402, F401  (registers its queries)
