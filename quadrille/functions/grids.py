"""Tile grids as data, and tile arithmetic as Column expressions."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mercator world's width, metres of a degree, the standard pixel, and the degree-based systems.
WORLD = 40075016.68557849
DEGREE_METRES = 111319.4907932736
STANDARD_PIXEL = 0.00028
DEGREE_CRS = ("EPSG:4326", "CRS:84", "OGC:CRS84", "urn:ogc:def:crs:OGC:1.3:CRS84")


def metres_per_unit(crs: str) -> float:
    """Metres of one unit of a system (projected ones are in metres)."""
    return DEGREE_METRES if crs in DEGREE_CRS else 1.0


@dataclass(frozen=True)
class Level:
    """One zoom level: number, units a pixel, columns and rows."""

    z: int
    resolution: float
    width: int
    height: int


@dataclass(frozen=True)
class Grid:
    """A tile matrix set with its origin at the top left and rows that grow southwards."""

    id: str
    crs: str
    origin_x: float
    origin_y: float
    tile_w: int
    tile_h: int
    levels: tuple[Level, ...]

    def level(self, z: int) -> Level | None:
        return next((x for x in self.levels if x.z == z), None)

    def spans(self, z: int) -> tuple[float, float]:
        """Width and height of a tile of a level, in units."""
        r = self.level(z).resolution
        return self.tile_w * r, self.tile_h * r

    def extent(self) -> tuple[float, float, float, float] | None:
        """What the first level covers."""
        if not self.levels:
            return None
        a = self.levels[0]
        w, h = a.width * self.tile_w * a.resolution, a.height * self.tile_h * a.resolution
        return self.origin_x, self.origin_y - h, self.origin_x + w, self.origin_y

    def invariant(self) -> bool:
        """Whether all levels cover the same extent, within a millionth."""
        size = [(x.width * self.tile_w * x.resolution, x.height * self.tile_h * x.resolution) for x in self.levels]
        return all(abs(s[i] - size[0][i]) <= 1e-6 * abs(size[0][i]) + 1e-6 for s in size for i in (0, 1))

    def bounds(self, z: int, col: int, row: int) -> tuple[float, float, float, float] | None:
        """Box of one tile; None outside the level."""
        a = self.level(z)
        if a is None or not (0 <= col < a.width and 0 <= row < a.height):
            return None
        w, h = self.spans(z)
        x, y = self.origin_x + col * w, self.origin_y - row * h
        return x, y - h, x + w, y

    def cover(self, box: tuple[float, float, float, float], z: int) -> tuple[int, int, int, int] | None:
        """First and last column, first and last row of the tiles that a box reaches into; None if there are none."""
        a = self.level(z)
        if a is None:
            return None
        w, h = self.spans(z)
        c0, c1 = max(0, math.floor((box[0] - self.origin_x) / w)), min(a.width - 1, math.ceil((box[2] - self.origin_x) / w) - 1)
        r0, r1 = max(0, math.floor((self.origin_y - box[3]) / h)), min(a.height - 1, math.ceil((self.origin_y - box[1]) / h) - 1)
        return (c0, c1, r0, r1) if c0 <= c1 and r0 <= r1 else None

    def scale_denominator(self, z: int) -> float:
        a = self.level(z)
        return a.resolution * metres_per_unit(self.crs) / STANDARD_PIXEL if a else math.nan

    def table(self, spark: SparkSession) -> DataFrame:
        """The levels as a small table, for broadcast joins."""
        rows = [(self.id, self.crs, self.origin_x, self.origin_y, self.tile_w, self.tile_h, x.z, x.resolution, x.width, x.height) for x in self.levels]
        return spark.createDataFrame(rows, "grid string, crs string, origin_x double, origin_y double, tile_w int, tile_h int, z int, resolution double, width long, height long")


def quad(id: str, crs: str, x: float, y: float, span: float, tile: int, n: int, wide: int = 1) -> Grid:
    """A grid whose every level halves the pixel; wide: columns for each row at level 0."""
    return Grid(id, crs, x, y, tile, tile, tuple(Level(z, span / tile / 2**z, wide * 2**z, 2**z) for z in range(n)))


def preset(name: str) -> Grid:
    """A well-known grid by name; a suffix such as _512px sets the tile size."""
    base, size = split_size(name)
    tile, suffix = size or 256, f"_{size}px" if size else ""
    half = WORLD / 2
    made = {
        "WebMercatorQuad": lambda: quad("WebMercatorQuad" + suffix, "EPSG:3857", -half, half, WORLD, tile, 25),
        "WorldCRS84Quad": lambda: quad("WorldCRS84Quad" + suffix, "CRS:84", -180.0, 90.0, 180.0, tile, 24, 2),
        "UPSArcticWGS84Quad": lambda: quad("UPSArcticWGS84Quad" + suffix, "EPSG:5041", -14440759.350252, 18440759.350252, 32881518.700504, tile, 25),
        "UPSAntarcticWGS84Quad": lambda: quad("UPSAntarcticWGS84Quad" + suffix, "EPSG:5042", -14440759.350252, 18440759.350252, 32881518.700504, tile, 25),
    }
    if base not in made:
        raise ValueError(f"unknown grid {name!r}")
    return made[base]()


def split_size(name: str) -> tuple[str, int | None]:
    """Name and tile size of a grid name such as WebMercatorQuad_512px."""
    m = re.fullmatch(r"(.+)_(\d+)px", name)
    return (m[1], int(m[2])) if m else (name, None)


def pick(names: list[str], wanted: str) -> str | None:
    """A layer's grid by exact name, else the one whose name without its size suffix is wanted."""
    return wanted if wanted in names else next((n for n in names if split_size(n)[0] == wanted), None)


def for_raster(crs: str, x: float, y: float, px: float, py: float, width: int, height: int, levels: int, tile: int = 256) -> Grid:
    """A raster's own grid: the finest level has its pixels, all levels cover one extent."""
    n = max(levels, 1)
    coarse = px * 2 ** (n - 1)
    w = max(1, math.ceil(width * px / (tile * coarse)))
    h = max(1, math.ceil(height * py / (tile * coarse)))
    return Grid("from_cog", crs, x, y, tile, tile, tuple(Level(z, coarse / 2**z, w * 2**z, h * 2**z) for z in range(n)))


def from_extent(id: str, crs: str, extent: tuple[float, float, float, float], resolutions: list[float], tile: int = 256) -> Grid:
    """A configured grid: as many tiles as cover the extent at each resolution."""
    minx, miny, maxx, maxy = extent
    levels = tuple(Level(z, r, max(1, math.ceil((maxx - minx) / (tile * r) - 1e-9)), max(1, math.ceil((maxy - miny) / (tile * r) - 1e-9))) for z, r in enumerate(resolutions))
    return Grid(id, crs, minx, maxy, tile, tile, levels)


def crs_name(text: str) -> str:
    """EPSG:n or CRS:84 of a system given as name, URN or URL."""
    m = re.search(r"(?:EPSG|epsg)(?:[:/]+[\d.]*)?[:/]+(\d+)$", text)
    if m:
        return f"EPSG:{m[1]}"
    return "CRS:84" if text.endswith(("CRS84", "CRS:84")) else text


def from_json(text: str, northing_first: bool | None = None) -> Grid:
    """A grid from an OGC TileMatrixSet 2.0 document; the corner's axis order follows orderedAxes, else the system."""
    doc = json.loads(text)
    crs = crs_name(doc["crs"] if isinstance(doc["crs"], str) else doc["crs"].get("uri", ""))
    axes = [a.lower() for a in doc.get("orderedAxes", [])]
    if northing_first is None:
        northing_first = axes[0][:1] in ("n", "y") or axes[0].startswith("lat") if axes else crs == "EPSG:4326"
    levels, origin, tile = [], None, None
    for i, m in enumerate(doc["tileMatrices"]):
        corner = m["pointOfOrigin"][::-1] if northing_first else m["pointOfOrigin"]
        origin, tile = origin or corner, tile or (m["tileWidth"], m["tileHeight"])
        levels.append(Level(int(m["id"]) if str(m["id"]).isdigit() else i, float(m["cellSize"]), int(m["matrixWidth"]), int(m["matrixHeight"])))
    return Grid(doc.get("id", ""), crs, *origin, *tile, tuple(levels))


def to_json(grid: Grid) -> str:
    """The OGC TileMatrixSet 2.0 document of a grid."""
    kind = "http://www.opengis.net/def/crs/OGC/1.3/CRS84" if grid.crs in ("CRS:84", "OGC:CRS84") else f"http://www.opengis.net/def/crs/EPSG/0/{grid.crs.split(':')[-1]}"
    matrices = [
        {"id": str(x.z), "scaleDenominator": grid.scale_denominator(x.z), "cellSize": x.resolution, "cornerOfOrigin": "topLeft", "pointOfOrigin": [grid.origin_x, grid.origin_y], "tileWidth": grid.tile_w, "tileHeight": grid.tile_h, "matrixWidth": x.width, "matrixHeight": x.height}
        for x in grid.levels
    ]
    return json.dumps({"id": grid.id, "crs": kind, "orderedAxes": ["E", "N"], "tileMatrices": matrices})


# Column expressions.


def tile_bounds(grid: Grid, z: int, col: Column, row: Column) -> list[Column]:
    """minx, miny, maxx, maxy of tiles; null outside the level."""
    a = grid.level(z)
    w, h = grid.spans(z)
    there = (col >= 0) & (col < a.width) & (row >= 0) & (row < a.height)
    x, y = F.lit(grid.origin_x) + col * F.lit(w), F.lit(grid.origin_y) - row * F.lit(h)
    named = {"minx": x, "miny": y - F.lit(h), "maxx": x + F.lit(w), "maxy": y}
    return [F.when(there, v).alias(k) for k, v in named.items()]


def cover(grid: Grid, z: int, minx: Column, miny: Column, maxx: Column, maxy: Column, touching: bool = False) -> Column:
    """struct<c0, c1, r0, r1> of the tiles that a box reaches into; null if there are none.

    touching: a box without width or height on a tile's edge still has the tile it begins in, as needed for points.
    """
    a = grid.level(z)
    w, h = grid.spans(z)
    c0, c1 = F.floor((minx - F.lit(grid.origin_x)) / F.lit(w)), F.ceil((maxx - F.lit(grid.origin_x)) / F.lit(w)) - 1
    r0, r1 = F.floor((F.lit(grid.origin_y) - maxy) / F.lit(h)), F.ceil((F.lit(grid.origin_y) - miny) / F.lit(h)) - 1
    if touching:
        c1, r1 = F.greatest(c1, c0), F.greatest(r1, r0)
    c0, r0 = F.greatest(c0, F.lit(0)).cast("long"), F.greatest(r0, F.lit(0)).cast("long")
    c1, r1 = F.least(c1, F.lit(a.width - 1)).cast("long"), F.least(r1, F.lit(a.height - 1)).cast("long")
    return F.when((c0 <= c1) & (r0 <= r1), F.struct(c0.alias("c0"), c1.alias("c1"), r0.alias("r0"), r1.alias("r1")))


def covered_tiles(df: DataFrame, grid: Grid, z: int, box: tuple[str, str, str, str] = ("minx", "miny", "maxx", "maxy"), touching: bool = False) -> DataFrame:
    """A row for each tile that each box reaches into, with the columns z, x, y added.

    The explode follows the box's own cover, so rows grow with covered area and never with the product of two tables.
    """
    out = df.withColumn("__c", cover(grid, z, *[F.col(c) for c in box], touching=touching)).filter(F.col("__c").isNotNull())
    out = out.withColumn("x", F.explode(F.sequence("__c.c0", "__c.c1"))).withColumn("y", F.explode(F.sequence("__c.r0", "__c.r1")))
    return out.withColumn("z", F.lit(z)).drop("__c")


def flipped_row(grid: Grid, z: int, row: Column) -> Column:
    """Row counted from the bottom (TMS) to the top, and back."""
    return F.lit(grid.level(z).height - 1) - row


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """Archive id of a tile: the tiles of all lower levels, then its place on the level's Hilbert curve.

    A fold over the bits, highest first; each step keeps the lower bits, turned as the quadrant asks.
    """
    long = lambda c: c.cast("long")
    shifted = F.call_function

    def step(s: Column, bit: Column) -> Column:
        half = shifted("shiftleft", F.lit(1).cast("long"), bit)
        rx, ry = shifted("shiftright", s["x"], bit).bitwiseAND(1), shifted("shiftright", s["y"], bit).bitwiseAND(1)
        low = half - 1
        lx, ly = s["x"].bitwiseAND(low), s["y"].bitwiseAND(low)
        fx, fy = F.when((ry == 0) & (rx == 1), low - lx).otherwise(lx), F.when((ry == 0) & (rx == 1), low - ly).otherwise(ly)
        d = s["d"] + half * half * (rx * 3).bitwiseXOR(ry)
        return F.struct(long(F.when(ry == 0, fy).otherwise(fx)).alias("x"), long(F.when(ry == 0, fx).otherwise(fy)).alias("y"), long(d).alias("d"))

    start = F.struct(long(x).alias("x"), long(y).alias("y"), F.lit(0).cast("long").alias("d"))
    bits = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    place = F.aggregate(bits, start, step, lambda s: s["d"])
    before = F.floor((shifted("shiftleft", F.lit(1).cast("long"), (z * 2).cast("int")) - 1) / 3).cast("long")
    return before + place


def tile_id(z: int, x: int, y: int) -> int:
    """hilbert_id of one tile."""
    d = 0
    for bit in range(z - 1, -1, -1):
        half, low = 1 << bit, (1 << bit) - 1
        rx, ry = x >> bit & 1, y >> bit & 1
        d += half * half * ((3 * rx) ^ ry)
        x, y = x & low, y & low
        if ry == 0:
            if rx:
                x, y = low - x, low - y
            x, y = y, x
    return (4**z - 1) // 3 + d


def tile_of_id(id: int) -> tuple[int, int, int]:
    """z, x, y of an archive id."""
    z, before = 0, 0
    while id >= before + 4**z:
        before += 4**z
        z += 1
    d, x, y = id - before, 0, 0
    for bit in range(z):
        half = 1 << bit
        q = d >> (2 * bit) & 3
        rx, ry = q >> 1, (q ^ (q >> 1)) & 1
        if ry == 0:
            if rx:
                x, y = half - 1 - x, half - 1 - y
            x, y = y, x
        x, y = x + half * rx, y + half * ry
    return z, x, y


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web mercator metres; latitudes are clamped to the square world."""
    r = WORLD / (2 * math.pi)
    held = F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878))
    return F.radians(lon) * F.lit(r), F.lit(r) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(held) / 2))


def metres_per_pixel(z: int) -> float:
    """Mercator metres of a 256-pixel tile's pixel."""
    return WORLD / (256 * 2**z)


def area_scale(wgs84: tuple[float, float, float, float], extent: tuple[float, float, float, float]) -> float:
    """Mercator square metres for each square unit of a layer's system; 0 where it can't be told."""
    r = WORLD / (2 * math.pi)
    y = lambda lat: r * math.log(math.tan(math.pi / 4 + math.radians(max(-85.05112878, min(85.05112878, lat))) / 2))
    merc = abs(math.radians(wgs84[2] - wgs84[0]) * r * (y(wgs84[3]) - y(wgs84[1])))
    own = abs((extent[2] - extent[0]) * (extent[3] - extent[1]))
    return merc / own if math.isfinite(merc) and math.isfinite(own) and merc > 0 and own > 0 else 0.0


def gate_for_zoom(z: int, scale: float, pixels: float) -> float:
    """Least area, in source units, of `pixels` square pixels at a zoom; 0 turns the gate off."""
    return pixels * metres_per_pixel(z) ** 2 / scale if pixels > 0 and scale > 0 else 0.0


def gate_for_grid(grid: Grid, z: int, crs: str, scale: float, pixels: float) -> float:
    """The same by a grid's own pixel; in the grid's system the scale isn't needed."""
    a = grid.level(z)
    if pixels <= 0 or a is None or not (0 < a.resolution < math.inf):
        return 0.0
    if grid.crs.lower() == crs.lower():
        return pixels * a.resolution**2
    return pixels * (a.resolution * metres_per_unit(grid.crs)) ** 2 / scale if scale > 0 else 0.0


def zoom_of_scale(denominator: float) -> int | None:
    """The mercator zoom whose pixel is nearest to a scale's."""
    metres = denominator * STANDARD_PIXEL
    if not (0 < metres < math.inf):
        return None
    return min(32, max(0, math.floor(math.log2(WORLD / (256 * metres)) + 0.5)))


def gate_for_scale(denominator: float, scale: float, pixels: float) -> float:
    z = zoom_of_scale(denominator)
    return 0.0 if z is None else gate_for_zoom(z, scale, pixels)


def request_scale(box: tuple[float, float, float, float], width: int, crs: str) -> float:
    """Scale denominator of a map request."""
    return abs(box[2] - box[0]) / max(width, 1) * metres_per_unit(crs) / STANDARD_PIXEL
