"""Registered queries that hold the library's kernels and codecs, row by row, against closed forms in SQL.

A kernel runs in Arrow batches over rows of the driver's tables; its SQL says what the result must be, not how.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import crs, geometry, grids, mvt, pmtiles, style, wkb
from ..operators import raster, tiles, topology
from ..sources import raster as raster_files
from ..sources import vector
from . import service, views
from .registry import _LEVELS, _MERC, _TRIOS, LOCAL, LOCAL_CRS, RULES, SQL, WEB, _targets, query


def by_rows(df: DataFrame, schema: str, kernel: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """The rows that a kernel makes of each row, in Arrow batches."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([x for r in b.to_pylist() for x in kernel(r)], schema=arrow)

    return df.mapInArrow(run, schema)


def _ring(r: dict) -> list:
    return [(r["minx"], r["miny"]), (r["maxx"], r["miny"]), (r["maxx"], r["maxy"]), (r["minx"], r["maxy"])]


def _box(geom: tuple, **more) -> dict:
    return dict(zip(("minx", "miny", "maxx", "maxy"), geometry.bbox(geom), strict=True)) | more


# Codecs.


@query("SELECT fid, minx, miny, maxx, maxy, area FROM boxes", views.BOXES)
def c13_wkb_decode(spark, d):
    """Boxes and areas of decoded geometries."""
    return by_rows(views.box_features(spark, d).select("fid", "wkb"), "fid long, minx double, miny double, maxx double, maxy double, area double", lambda r: [_box(g := wkb.decode(r["wkb"]), fid=r["fid"], area=geometry.area(g))])


@query("SELECT fid, minx, maxy FROM boxes WHERE fid % 7 <> 0", views.BOXES)
def c14_geopackage_blob(spark, d):
    """Geometries of GeoPackage blobs; those marked as empty have none."""

    def kernel(r):
        blob = bytearray(wkb.encode_blob(wkb.decode(r["wkb"]), 3857))
        if r["fid"] % 7 == 0:
            blob[3] |= 16
        found = wkb.decode_blob(bytes(blob))
        return [{"fid": r["fid"], "minx": geometry.bbox(found)[0], "maxy": geometry.bbox(found)[3]}] if found else []

    return by_rows(views.box_features(spark, d).select("fid", "wkb"), "fid long, minx double, maxy double", kernel)


@query("SELECT p_partkey AS tile_id, CAST(1 + p_size % 3 AS BIGINT) AS run_length, CAST(p_size AS BIGINT) AS length, CAST(sum(p_size) OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - p_size + CASE WHEN p_partkey % 500 > 250 THEN 9 ELSE 0 END AS BIGINT) AS byte_offset FROM part")
def c17_directory(spark, d):
    """Directories of five hundred ids each, packed and read again: contiguous offsets, a gap, runs."""

    def run(key, table):
        rows = sorted(zip(table.column("id").to_pylist(), table.column("n").to_pylist(), strict=True))
        entries, at = [], 0
        for i, n in rows:
            entries.append((i, 1 + n % 3, at + (9 if i % 500 > 250 else 0), n))
            at += n
        found = pmtiles.unpack_directory(pmtiles.pack_directory(entries))
        return pa.table({c: pa.array([e[k] for e in found], pa.int64()) for c, k in (("tile_id", 0), ("run_length", 1), ("byte_offset", 2), ("length", 3))})

    rows = views.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("n"), F.expr("p_partkey div 500").alias("chunk"))
    return rows.groupBy("chunk").applyInArrow(run, "tile_id long, run_length long, byte_offset long, length long")


@query("SELECT p_partkey AS id, md5(p_type) AS plain, md5(p_type) AS deflated, md5(p_type) AS raw FROM part")
def c05_unpacked(spark, d):
    """Tiles stored as they are, deflated, and deflated without a header."""

    def kernel(r):
        import hashlib

        data, size = r["t"].encode(), len(r["t"].encode())
        bare = zlib.compressobj(wbits=-15)
        made = {"plain": (data, 1), "deflated": (zlib.compress(data), 8), "raw": (bare.compress(data) + bare.flush(), 32946)}
        return [{"id": r["id"]} | {k: hashlib.md5(raster_files.unpacked(v, c, size)).hexdigest() for k, (v, c) in made.items()}]

    return by_rows(views.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_type").alias("t")), "id long, plain string, deflated string, raw string", kernel)


@query("SELECT fid, CASE WHEN area % 2 = 0 THEN 'x ' || name || ' & <' || class_key || '>' ELSE name END AS shown FROM boxes", views.BOXES)
def g30_escaping(spark, d):
    """Escaped texts, read back by a parser of XML."""

    def kernel(r):
        from xml.etree import ElementTree

        text = f"x {r['name']} & <{r['class_key']}>" if r["area"] % 2 == 0 else r["name"]
        return [{"fid": r["fid"], "shown": ElementTree.fromstring(f"<a>{service.escape(text)}</a>").text}]

    return by_rows(views.boxes(spark, d).select("fid", "name", "class_key", "area"), "fid long, shown string", kernel)


# Geometry.


@query("SELECT fid, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y FROM boxes", views.BOXES)
def a13_centroid(spark, d):
    """Area centroids of polygons, label points."""

    def kernel(r):
        x, y = geometry.centroid(wkb.decode(r["wkb"]))
        return [{"fid": r["fid"], "x": round(x, 6), "y": round(y, 6)}]

    return by_rows(views.box_features(spark, d).select("fid", "wkb"), "fid long, x double, y double", kernel)


@query("SELECT fid, minx + fid % 30 - 5 < maxx AND fid % 30 >= 5 AND miny + fid % 25 - 5 < maxy AND fid % 25 >= 5 AS inside FROM boxes", views.BOXES)
def g17_point_in_ring(spark, d):
    """Half-open containment, points on edges and corners included."""
    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, inside boolean", lambda r: [{"fid": r["fid"], "inside": geometry.in_ring(r["minx"] + r["fid"] % 30 - 5, r["miny"] + r["fid"] % 25 - 5, _ring(r))}])


@query("SELECT fid, (minx + maxx) / 2 AS x, miny + 0.5 AS y FROM boxes", views.BOXES)
def g18_inner_point(spark, d):
    """A point inside a ring of whole numbers."""

    def kernel(r):
        x, y = geometry.inner_point(_ring(r))
        return [{"fid": r["fid"], "x": x, "y": y}]

    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, x double, y double", kernel)


@query("SELECT fid, CASE WHEN fid % 2 = 0 THEN 2 * area ELSE -2 * area END AS twice, 2 * area AS outer_twice FROM boxes", views.BOXES)
def g19_signed_area(spark, d):
    """Signed areas of rings both ways round, and of the same rings oriented as exteriors."""

    def kernel(r):
        ring = _ring(r)[:: 1 if r["fid"] % 2 == 0 else -1]
        return [{"fid": r["fid"], "twice": geometry.ring_area2(ring), "outer_twice": geometry.ring_area2(geometry.oriented([ring])[0])}]

    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, twice double, outer_twice double", kernel)


@query("SELECT fid, greatest(minx, 200) AS minx, greatest(miny, 200) AS miny, least(maxx, 700) AS maxx, least(maxy, 700) AS maxy, (least(maxx, 700) - greatest(minx, 200)) * (least(maxy, 700) - greatest(miny, 200)) AS area FROM boxes WHERE least(maxx, 700) > greatest(minx, 200) AND least(maxy, 700) > greatest(miny, 200)", views.BOXES)
def g21_polygon_clip(spark, d):
    """Polygons cut by a box."""

    def kernel(r):
        rings = geometry.clip_polygon([_ring(r)], (200.0, 200.0, 700.0, 700.0))
        geom = ("Polygon", [rings])
        return [_box(geom, fid=r["fid"], area=geometry.area(geom))] if rings and geometry.area(geom) else []

    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, minx double, miny double, maxx double, maxy double, area double", kernel)


@query("SELECT fid, round(minx + lo * (maxx - minx), 6) AS x0, round(miny + lo * (maxy - miny), 6) AS y0, round(minx + hi * (maxx - minx), 6) AS x1, round(miny + hi * (maxy - miny), 6) AS y1 FROM (SELECT *, greatest(0, (200 - minx) / (maxx - minx), (200 - miny) / (maxy - miny)) AS lo, least(1, (700 - minx) / (maxx - minx), (700 - miny) / (maxy - miny)) AS hi FROM boxes) WHERE lo < hi", views.BOXES)
def g22_line_clip(spark, d):
    """Diagonals cut by a box."""

    def kernel(r):
        for piece in geometry.clip_line([(r["minx"], r["miny"]), (r["maxx"], r["maxy"])], (200.0, 200.0, 700.0, 700.0)):
            (x0, y0), (x1, y1) = piece
            yield {"fid": r["fid"], "x0": round(x0, 6), "y0": round(y0, 6), "x1": round(x1, 6), "y1": round(y1, 6)}

    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, x0 double, y0 double, x1 double, y1 double", kernel)


@query("SELECT fid, CAST(2 * (round(maxx / 8) - round(minx / 8)) * (round(maxy / 8) - round(miny / 8)) AS BIGINT) AS twice, CAST(4 AS BIGINT) AS points, CAST(round(CAST(price AS DOUBLE) / 250) AS BIGINT) AS price FROM boxes WHERE round(maxx / 8) > round(minx / 8) AND round(maxy / 8) > round(miny / 8)", views.BOXES)
def g23_snap(spark, d):
    """Rings on a grid of eight units, those that vanish left out; prices on one of 250."""

    def kernel(r):
        ring = geometry.snap_ring(_ring(r), 8.0)
        return [{"fid": r["fid"], "twice": geometry.ring_area2(ring), "points": len(ring), "price": geometry.snap(r["price"], 250.0)}] if ring else []

    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy", F.col("price").cast("double").alias("price")), "fid long, twice long, points long, price long", kernel)


@query("SELECT fid, fid % 3 = 0 AS crosses FROM boxes", views.BOXES)
def g24_crossing(spark, d):
    """Lines whose segments cross, and zigzags of the same points whose segments don't."""

    def kernel(r):
        a, b, c, e = _ring(r)
        return [{"fid": r["fid"], "crosses": geometry.crosses_itself([a, c, b, e] if r["fid"] % 3 == 0 else [a, b, e, c])}]

    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, crosses boolean", kernel)


@query("SELECT fid, (maxx - minx + 10) * (maxy - miny + 10) AS big, area - (maxx - minx - 2) * (maxy - miny - 2) AS small FROM boxes WHERE maxx - minx > 2 AND maxy - miny > 2", views.BOXES)
def j10_nested_holes(spark, d):
    """A hole goes to the smaller of the exteriors around it."""

    def kernel(r):
        grown = lambda n: [(int(r["minx"] - n), int(r["miny"] - n)), (int(r["maxx"] + n), int(r["miny"] - n)), (int(r["maxx"] + n), int(r["maxy"] + n)), (int(r["minx"] - n), int(r["maxy"] + n))]
        polys = geometry.nested([grown(-1)[::-1], grown(5), grown(0)])
        areas = sorted((float(geometry.area(("Polygon", [p]))) for p in polys), reverse=True)
        return [{"fid": r["fid"], "big": areas[0], "small": areas[1]}]

    return by_rows(views.boxes(spark, d).filter("maxx - minx > 2 AND maxy - miny > 2").select("fid", "minx", "miny", "maxx", "maxy"), "fid long, big double, small double", kernel)


@query("SELECT fid, CAST(1 + CAST(round(maxx / 7) <> round(minx / 7) OR round(miny / 7) <> round(maxy / 7) AS INTEGER) + CAST(round(maxx / 7 + 0.4) <> round(maxx / 7) AS INTEGER) AS BIGINT) AS points FROM boxes", views.BOXES)
def w04_vertex_dedup(spark, d):
    """Points of a line that are left when repeats after rounding go."""
    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, points long", lambda r: [{"fid": r["fid"], "points": len(mvt.rounded([(r["minx"] / 7, r["miny"] / 7), (r["maxx"] / 7, r["maxy"] / 7), (r["maxx"] / 7 + 0.4, r["maxy"] / 7)]))}])


# Grids and systems.


@query("SELECT CAST(z AS INTEGER) AS z, round(" + repr(grids.WORLD) + " / 256 / (1 << z), 9) AS resolution, CAST(1 << z AS BIGINT) AS width, CAST(1 << z AS BIGINT) AS height FROM (SELECT unnest(range(25)) AS z)")
def g05_preset_levels(spark, d):
    """The levels of a well-known grid, through its JSON document and back."""
    return grids.from_json(grids.to_json(WEB)).table(spark).select("z", F.round("resolution", 9).alias("resolution"), "width", "height")


@query("SELECT CAST(z AS INTEGER) AS z, r AS resolution, CAST(ceil(1000 / (256 * r)) AS BIGINT) AS width, CAST(ceil(700 / (256 * r)) AS BIGINT) AS height FROM (VALUES (0, 50.0::DOUBLE), (1, 10.0), (2, 4.0), (3, 1.5), (4, 0.25)) t(z, r)")
def g06_configured_grid(spark, d):
    """Levels of a grid from an extent and resolutions."""
    return grids.from_extent("own", LOCAL_CRS, (0.0, 0.0, 1000.0, 700.0), [50.0, 10.0, 4.0, 1.5, 0.25]).table(spark).select("z", "resolution", "width", "height")


@query("SELECT c_custkey AS id, CAST(ceil((1 + c_custkey % 5000) / (256.0 * (1 << c_custkey % 4))) * (1 << c_custkey % 4) AS BIGINT) AS width, CAST(ceil((1 + c_custkey * 7 % 3000) / (256.0 * (1 << c_custkey % 4))) * (1 << c_custkey % 4) AS BIGINT) AS height FROM customer")
def g16_raster_grid(spark, d):
    """The finest level of a raster's own grid."""

    def kernel(r):
        k = r["id"]
        last = grids.for_raster(LOCAL_CRS, 0.0, 0.0, 0.5, 0.5, 1 + k % 5000, 1 + k * 7 % 3000, 1 + k % 4).levels[-1]
        return [{"id": k, "width": last.width, "height": last.height}]

    return by_rows(views.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id")), "id long, width long, height long", kernel)


@query("SELECT fid, CASE WHEN fid % 12 - 2 BETWEEN 0 AND 7 AND fid % 11 - 2 BETWEEN 0 AND 7 THEN CAST((fid % 12 - 2) * 128 AS DOUBLE) END AS minx, CASE WHEN fid % 12 - 2 BETWEEN 0 AND 7 AND fid % 11 - 2 BETWEEN 0 AND 7 THEN CAST(1024 - (fid % 11 - 1) * 128 AS DOUBLE) END AS miny FROM boxes", views.BOXES)
def p27_tile_membership(spark, d):
    """Bounds of tiles; null outside the level."""
    bounds = grids.tile_bounds(LOCAL, 3, F.expr("fid % 12 - 2"), F.expr("fid % 11 - 2"))
    return views.boxes(spark, d).select("fid", *bounds).select("fid", "minx", "miny")


@query(f"SELECT CAST(z AS INTEGER) AS z, round({grids.WORLD!r} / 256 / (1 << z), 9) AS metres, round(pow({grids.WORLD!r} / 256 / (1 << z), 2) / 3, 6) AS gate FROM (SELECT unnest(range(23)) AS z)")
def g28_gates_by_zoom(spark, d):
    """Metres a pixel, and the least area that a zoom shows."""
    return by_rows(spark.range(23), "z int, metres double, gate double", lambda r: [{"z": r["id"], "metres": round(grids.metres_per_pixel(r["id"]), 9), "gate": round(grids.gate_for_zoom(r["id"], 3.0, 1.0), 6)}])


@query(f"SELECT fid, round({_MERC} * radians(minx / 10 - 50), 3) AS minx, round({_MERC} * ln(tan(pi() / 4 + radians(miny / 20) / 2)), 3) + 0.0 AS miny, round({_MERC} * radians(maxx / 10 - 50), 3) AS maxx, round({_MERC} * ln(tan(pi() / 4 + radians(maxy / 20) / 2)), 3) AS maxy FROM boxes", views.BOXES)
def g11_system_bounds(spark, d):
    """Boxes in degrees, in web mercator metres."""

    def kernel(r):
        b = crs.bounds("EPSG:4326", "EPSG:3857", (r["minx"] / 10 - 50, r["miny"] / 20, r["maxx"] / 10 - 50, r["maxy"] / 20))
        return [{"fid": r["fid"]} | {k: round(v, 3) + 0.0 for k, v in zip(("minx", "miny", "maxx", "maxy"), b, strict=True)}]

    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, minx double, miny double, maxx double, maxy double", kernel)


@query(f"SELECT fid, round({_MERC} * {_MERC} * radians(maxx / 10 - minx / 10) * (ln(tan(pi() / 4 + radians(maxy / 20) / 2)) - ln(tan(pi() / 4 + radians(miny / 20) / 2))) / area / 1000000, 4) AS scale FROM boxes", views.BOXES)
def a15_area_scale(spark, d):
    """Mercator square kilometres for each square unit of a layer."""

    def kernel(r):
        scale = grids.area_scale((r["minx"] / 10, r["miny"] / 20, r["maxx"] / 10, r["maxy"] / 20), (r["minx"], r["miny"], r["maxx"], r["maxy"]))
        return [{"fid": r["fid"], "scale": round(scale / 1e6, 4)}]

    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, scale double", kernel)


@query("SELECT fid, CAST(CAST(minx * 0.68359375 AS FLOAT) AS DOUBLE) AS u, CAST(CAST((1024 - maxy) * 0.68359375 AS FLOAT) AS DOUBLE) AS v FROM boxes", views.BOXES)
def g14_to_pixels(spark, d):
    """Corners in 32-bit pixels of a frame."""

    def kernel(r):
        (u, v), = crs.ToPixels(LOCAL_CRS, LOCAL_CRS, (0.0, 0.0, 1024.0, 1024.0), 700, 700)([(r["minx"], r["maxy"])])
        return [{"fid": r["fid"], "u": u, "v": v}]

    return by_rows(views.boxes(spark, d).select("fid", "minx", "maxy"), "fid long, u double, v double", kernel)


@query("SELECT fid, (lon + 180) / 0.25 AS u, (90 - lat) / 0.5 AS v, CAST(floor((lon + 180) / 0.25 / 64) AS BIGINT) AS grid_col, CAST(floor((90 - lat) / 0.5 / 64) AS BIGINT) AS grid_row FROM points", views.POINTS)
def g15_source_pixels(spark, d):
    """Places as fractional pixels of a raster, and their chunks."""
    p = raster.source_pixels(views.points(spark, d).select("fid", F.col("lon").alias("x"), F.col("lat").alias("y")), (-180.0, 90.0), (0.25, 0.5))
    return p.select("fid", "u", "v", *raster.chunk_of(F.col("u"), F.col("v"), 64, 64))


@query("SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, 100 + (i + 0.5) * 10.0 AS x, 530 - (j + 0.5) * 10.0 AS y FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(48)) AS j)")
def g26_pixel_centres(spark, d):
    """Centres of the pixels of a map frame."""
    return raster.request_pixels(spark, (100.0, 50.0, 740.0, 530.0), 64, 48)


@query("SELECT DISTINCT CAST(p_size * 7 AS BIGINT) AS pixels, CAST(16 * CASE WHEN n - low < 2 * low - n THEN low ELSE 2 * low END AS BIGINT) AS units FROM (SELECT p_size, n, CASE WHEN n < 8 THEN 4 WHEN n < 16 THEN 8 WHEN n < 32 THEN 16 WHEN n < 64 THEN 32 WHEN n < 128 THEN 64 WHEN n < 256 THEN 128 ELSE 256 END AS low FROM (SELECT p_size, least(256, greatest(4, p_size * 7)) AS n FROM part))")
def g27_cell_units(spark, d):
    """Tile units of mosaic cells of so many pixels."""
    sizes = views.table(spark, d, "part").select((F.col("p_size") * 7).cast("long").alias("pixels")).distinct()
    return by_rows(sizes, "pixels long, units long", lambda r: [{"pixels": r["pixels"], "units": mvt.Options(cell_pixels=r["pixels"]).cell}])


# Styles.


@query("SELECT c_custkey AS id, c // 65536 AS r, c // 256 % 256 AS g, c % 256 AS b, CAST(round(255 * (c_custkey % 11 / 10.0)) AS BIGINT) AS a FROM (SELECT c_custkey, c_custkey * 7919 % 16777216 AS c FROM customer)")
def g31_hex_colour(spark, d):
    """Colours of hexadecimal texts with opacities."""
    rows = views.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.format_string("#%06x", F.expr("c_custkey * 7919 % 16777216")).alias("t"))
    return by_rows(rows, "id long, r long, g long, b long, a long", lambda x: [{"id": x["id"]} | dict(zip("rgba", style.hex_colour(x["t"], x["id"] % 11 / 10), strict=True))])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey // 4 AS VARCHAR) ELSE CAST(c_custkey // 4 AS VARCHAR) || CASE c_custkey % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END END AS shown FROM customer")
def g32_number_text(spark, d):
    """Numbers as labels show them."""
    return by_rows(views.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id")), "id long, shown string", lambda r: [{"id": r["id"], "shown": style.number_text(r["id"] / 4)}])


@query("SELECT c_custkey AS id, c_custkey * 3 % 10000 >= 1000 AND c_custkey * 3 % 10000 < 2000 AS late, c_custkey * 3 % 10000 < 9000 AS rest FROM customer")
def p14_scale_gate(spark, d):
    """Rules that are active at a scale: from the least on, below the most."""
    late, rest = next(r for r in RULES if r.name == "late"), next(r for r in RULES if r.name == "rest")
    return by_rows(views.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id")), "id long, late boolean, rest boolean", lambda r: [{"id": r["id"], "late": late.active(r["id"] * 3 % 10000), "rest": rest.active(r["id"] * 3 % 10000)}])


@query(SQL["p15_rule_select"])
def u03_rules_of_a_feature(spark, d):
    """The rules whose symbols a feature is drawn with, by the renderer's own selection."""

    def kernel(r):
        return [{"fid": r["fid"], "rule": k} for k in style.chosen(RULES, r, 1500.0)]

    return by_rows(views.boxes(spark, d).select("fid", "area", "class_key", "name", F.col("price").cast("double").alias("price")), "fid long, rule int", kernel)


@query("SELECT event_id FROM events WHERE user_id % 20 <= round(log2(156543.03 / 100) + 1)")
def p24_declutter(spark, d):
    """Features that a plain style shows at a resolution of a hundred metres: priorities up to the zoom, rounded."""
    return views.table(spark, d, "events").filter(style.decluttered(F.col("user_id") % 20, 100.0)).select("event_id")


@query("SELECT c_custkey AS id, CAST(CASE WHEN w >= 8 THEN 3 WHEN w >= 4 THEN 2 WHEN w >= 2 THEN 1 ELSE 0 END AS BIGINT) AS level FROM (SELECT c_custkey, (c_custkey % 40 / 4.0 + 0.5) * 1.001 AS w FROM customer)")
def l07_overview(spark, d):
    """The coarsest level that is fine enough."""
    return by_rows(views.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id")), "id long, level long", lambda r: [{"id": r["id"], "level": raster.overview([(0, 1.0), (1, 2.0), (2, 4.0), (3, 8.0)], r["id"] % 40 / 4 + 0.5)}])


@query("SELECT fid, CAST(1 AS INTEGER) AS n, class_key AS class FROM boxes", views.BOXES)
def p19_pruned_attributes(spark, d):
    """Features with one of their attributes only."""
    rows = vector.pruned(views.box_features(spark, d), ["class"])
    return rows.select("fid", F.size("props").alias("n"), F.col("props")["class"]["s"].alias("class"))


# Rasters, tiles, topology.


@query("SELECT i, j, round(CAST(CAST(CAST(b1 AS FLOAT) / CAST(4 AS FLOAT) AS FLOAT) AS DOUBLE), 6) AS value FROM targets LEFT JOIN pixels ON floor(u) = col AND floor(v) = row", _LEVELS, views.PIXELS)
def r08_bandmath_render(spark, d):
    """An expression at the source's resolution, then the nearest pixel of a request."""
    made = raster.warp_nearest(_targets(spark), raster.band_math(views.pixels(spark, d), "B1 / 4"), ["value"])
    return made.select("i", "j", F.round(F.col("value").cast("double"), 6).alias("value"))


_HOLD = lambda e: f"CAST(greatest(-256, least(4352, {e})) AS BIGINT)"


@query(
    "SELECT x, y, fid, class_key AS class, CAST(price AS DOUBLE) AS price, "
    + ", ".join(f"{_HOLD(e)} AS {n}" for n, e in (("u0", "(minx - x * 128) * 32"), ("v0", "(1024 - y * 128 - maxy) * 32"), ("u1", "(maxx - x * 128) * 32"), ("v1", "(1024 - y * 128 - miny) * 32")))
    + " FROM boxes, (SELECT unnest(range(8)) AS x), (SELECT unnest(range(8)) AS y) WHERE maxx > x * 128 - 8 AND minx < x * 128 + 136 AND maxy > 1024 - (y + 1) * 128 - 8 AND miny < 1024 - y * 128 + 8",
    views.BOXES,
)
def m03_tile_geometry(spark, d):
    """What the tiles of a level say of each feature: attributes and clipped corners in tile units, read back from the encoded bytes."""

    def kernel(r):
        for fid, attributes, kind, commands in mvt.read_layer(r["blob"])[1]:
            (ring,) = mvt.read_rings(commands)
            xs, ys = [p[0] for p in ring], [p[1] for p in ring]
            if kind == mvt.POLYGON and geometry.ring_area2(ring) > 0:
                yield {"x": r["x"], "y": r["y"], "fid": fid, **attributes, "u0": min(xs), "v0": min(ys), "u1": max(xs), "v1": max(ys)}

    made = tiles.encoded(views.box_features(spark, d), LOCAL, 3, LOCAL_CRS, "boxes")
    return by_rows(made.select("x", "y", "blob"), "x long, y long, fid long, class string, price double, u0 long, v0 long, u1 long, v1 long", kernel)


@query("SELECT fid, col AS x, row AS y, CAST(2 AS BIGINT) AS twice, CAST(4 AS INTEGER) AS points FROM cells", views.CELLS)
def t01_snapped_coverage(spark, d):
    """A coverage on the grid of its tolerance."""
    rings = topology.snapped_rings(views.cell_features(spark, d), 10.0)
    least = lambda c: F.array_min(F.transform("pts", lambda p: p[c])).alias(c)
    return rings.select("fid", least("x"), least("y"), topology.ring_area2("pts").cast("long").alias("twice"), F.size("pts").alias("points"))


@query("SELECT c.fid, greatest(1, count(j.x)) AS pieces FROM (SELECT fid, x0 AS x, y0 AS y FROM corners UNION ALL SELECT fid, x1, y0 FROM corners UNION ALL SELECT fid, x1, y1 FROM corners UNION ALL SELECT fid, x0, y1 FROM corners) c LEFT JOIN (SELECT x, y FROM (SELECT DISTINCT x, y, least(a, b) AS l, greatest(a, b) AS r FROM trios) GROUP BY 1, 2 HAVING count(*) > 1) j ON c.x = j.x AND c.y = j.y GROUP BY 1", views.CELLS, views.CORNERS, _TRIOS)
def t03_cut_rings(spark, d):
    """Pieces that each ring is cut into at the junctions."""
    refs = topology.ring_refs(topology.snapped_rings(views.cell_features(spark, d), 1.0))
    return refs.groupBy("fid").agg(F.count(F.lit(1)).alias("pieces"))


@query("SELECT fid, CAST(CASE WHEN abs(ux * (uy + vy) - uy * (ux + vx)) / 2 * (1 - 0.7 * (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy))) < 30 THEN 2 ELSE 3 END AS BIGINT) AS points FROM (SELECT fid, maxx - minx AS ux, CAST(fid % 5 AS DOUBLE) AS uy, CAST(10 AS DOUBLE) AS vx, maxy - miny + 20 - fid % 5 AS vy FROM boxes)", views.BOXES)
def t07_simplified_lines(spark, d):
    """Lines of three points, whose middle one goes if its weighted triangle is small."""
    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, points long", lambda r: [{"fid": r["fid"], "points": len(geometry.simplify([(r["minx"], r["miny"]), (r["maxx"], r["miny"] + r["fid"] % 5), (r["maxx"] + 10, r["maxy"] + 20)], 30.0))}])


@query("SELECT fid, CAST(area AS BIGINT) AS area FROM boxes WHERE area >= 50", views.BOXES)
def t09_culled_parts(spark, d):
    """Rings of the parts that are large enough for a level."""
    rings = topology.culled(topology.snapped_rings(views.box_features(spark, d), 1.0), 50.0)
    return rings.select("fid", (F.abs(topology.ring_area2("pts")) / 2).cast("long").alias("area"))


@query("SELECT fid, CAST(4 AS BIGINT) AS points, area + 5 * (maxy - miny) AS area FROM boxes", views.BOXES)
def m06_walked_rings(spark, d):
    """Two neighbours of one class become one ring without the shared edge or points on straight runs."""

    def kernel(r):
        x0, y0, x1, y1 = (int(r[c]) for c in ("minx", "miny", "maxx", "maxy"))
        (polygon,) = geometry.dissolved([[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]], [[(x1, y0), (x1 + 5, y0), (x1 + 5, y1), (x1, y1)]]])
        return [{"fid": r["fid"], "points": len(polygon[0]), "area": geometry.area(("Polygon", [polygon]))}]

    return by_rows(views.boxes(spark, d).select("fid", "minx", "miny", "maxx", "maxy"), "fid long, points long, area double", kernel)


def _level(bits: int, order: str = "<", **more) -> raster_files.Level:
    return raster_files.Level(**({"width": 4, "height": 4, "tile_w": 4, "tile_h": 4, "samples": 1, "bits": bits, "sample_format": 1, "compression": 1, "predictor": 1, "offsets": (0,), "counts": (0,), "order": order} | more))


@query("SELECT p_partkey AS id, CAST(list_sum([p_partkey * (i + 3) % 60000 FOR i IN range(16)]) AS BIGINT) AS wide, CAST(list_sum([p_partkey * (i + 3) % 256 FOR i IN range(16)]) AS BIGINT) AS narrow FROM part")
def c10_predicted_samples(spark, d):
    """Tiles of big-endian 16-bit samples, and of bytes as differences along the rows."""
    import numpy as np

    def kernel(r):
        wide = np.array([r["id"] * (i + 3) % 60000 for i in range(16)], ">u2")
        narrow = np.array([r["id"] * (i + 3) % 256 for i in range(16)], np.int64).reshape(4, 4)
        apart = np.diff(narrow, axis=1, prepend=0).astype(np.uint8)
        found = raster_files.samples(wide.tobytes(), _level(16, ">")), raster_files.samples(zlib.compress(apart.tobytes()), _level(8, predictor=2, compression=8))
        return [{"id": r["id"], "wide": int(found[0].astype(np.int64).sum()), "narrow": int(found[1].astype(np.int64).sum())}]

    return by_rows(views.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id")), "id long, wide long, narrow long", kernel)


@query("SELECT p_partkey AS id, md5(p_type) AS text FROM part")
def c06_lzw(spark, d):
    """Streams of nine-bit codes, cleared before the table can widen them."""
    import hashlib

    def kernel(r):
        codes = [x for i in range(0, len(r["t"]), 200) for x in (256, *r["t"][i : i + 200].encode())] + [257]
        bits = "".join(f"{c:09b}" for c in codes)
        bits += "0" * (-len(bits) % 8)
        return [{"id": r["id"], "text": hashlib.md5(raster_files.lzw(int(bits, 2).to_bytes(len(bits) // 8, "big"))).hexdigest()}]

    return by_rows(views.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_type").alias("t")), "id long, text string", kernel)


@query("SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(sum(w * b1) / sum(w), 6) AS b1 FROM (SELECT t.i, t.j, greatest(0, 1 - abs(t.col + 0.5 - t.u) / 2.56) * greatest(0, 1 - abs(t.row + 0.5 - t.v) / 2.56) AS w, p.b1 FROM (SELECT *, unnest(range(CAST(floor(v) AS BIGINT) - 4, CAST(floor(v) AS BIGINT) + 5)) AS row FROM (SELECT *, unnest(range(CAST(floor(u) AS BIGINT) - 4, CAST(floor(u) AS BIGINT) + 5)) AS col FROM (SELECT i, j, (i + 0.5) * 2.56 AS u, (j + 0.5) * 2.56 AS v FROM (SELECT unnest(range(100)) AS i), (SELECT unnest(range(100)) AS j)))) t JOIN pixels p ON p.col = t.col AND p.row = t.row) WHERE w > 1e-12 GROUP BY i, j", views.PIXELS)
def a12_tent_downsample(spark, d):
    """A raster at a fraction of its size: means weighted by a tent as wide as the pixels that fall into one."""
    targets = raster.source_pixels(raster.request_pixels(spark, (0.0, 0.0, 256.0, 256.0), 100, 100), (0.0, 256.0), (1.0, 1.0))
    return raster.warp_bilinear(targets, views.pixels(spark, d), "b1", scale=2.56).select("i", "j", F.round("b1", 6).alias("b1"))


@query("SELECT * FROM (VALUES ('EPSG:4326', true, true), ('EPSG:4258', true, true), ('EPSG:3035', true, true), ('EPSG:3857', false, true), ('EPSG:3763', false, true), ('EPSG:2056', false, true), ('EPSG:32629', false, true), ('CRS:84', false, true), ('EPSG:99999', false, false)) t(code, northing_first, supported)")
def g12_axis_order(spark, d):
    """Systems that are known, and those whose published order begins with the northing."""
    codes = spark.createDataFrame([(c,) for c in ("EPSG:4326", "EPSG:4258", "EPSG:3035", "EPSG:3857", "EPSG:3763", "EPSG:2056", "EPSG:32629", "CRS:84", "EPSG:99999")], "code string")
    return by_rows(codes, "code string, northing_first boolean, supported boolean", lambda r: [{"code": r["code"], "northing_first": crs.northing_first(r["code"]), "supported": crs.supported(r["code"])}])
