"""Map services as Python calls: a layer registry with WMS, WMTS, TMS and XYZ front ends.

Each request becomes a plan over the layer's table: a window, a filter, and one image, tile or answer. HTTP itself
and browser viewers are left to others.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from html import escape as html_escape
from urllib.parse import parse_qsl
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs as systems
from ..functions import geometry as g
from ..functions import grids, mvt, png, sld, wkb
from ..functions import style as st
from ..operators import joins, raster, render, tiles
from ..sources.raster import Tiff

#: Pixels around a click, the largest image, and legend rows.
HIT_PIXELS, LARGEST, LEGEND_ROWS = 12, 8192, 60
FORMATS = ("image/png",)
INFO_FORMATS = ("application/json", "text/plain", "text/html", "application/vnd.ogc.gml")


class ServiceError(ValueError):
    """A request that can't be answered: a code and a message."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Layer:
    """A vector layer (features) or a raster one (pixels by level)."""

    name: str
    crs: str
    grids: list[grids.Grid]
    features: DataFrame | None = None
    pixels: dict[int, DataFrame] = field(default_factory=dict)
    tiff: Tiff | None = None
    style: object = None
    expression: str | None = None
    options: mvt.Options = mvt.Options()
    archive: DataFrame | None = None
    title: str = ""

    def bounds(self) -> tuple[float, float, float, float]:
        if self.tiff:
            a, (px, py), (x, y) = self.tiff.levels[0], self.tiff.pixel, self.tiff.origin
            return x, y - a.height * py, x + a.width * px, y
        r = self.features.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
        return tuple(r)


@dataclass
class Frame:
    """A map frame: box in x, y order, system, size."""

    crs: str
    box: tuple[float, float, float, float]
    width: int
    height: int


class Service:
    """A registry of layers and the protocols over it."""

    def __init__(self, spark: SparkSession, title: str = "Maps") -> None:
        self.spark, self.title, self.layers = spark, title, {}

    def add(self, layer: Layer) -> None:
        if (layer.features is None) == (layer.tiff is None):
            raise ValueError("a layer is either vector or raster")
        self.layers[layer.name] = layer

    def layer(self, name: str) -> Layer:
        if name not in self.layers:
            raise ServiceError("LayerNotDefined", f"no layer {name!r}")
        return self.layers[name]

    # WMS.

    def wms(self, query: str) -> tuple[str, bytes]:
        """Content type and body of a WMS request; errors become exception reports."""
        p = parameters(query)
        version = negotiated(p.get("VERSION") or p.get("WMTVER"))
        try:
            request = {"capabilities": "GetCapabilities", "map": "GetMap", "feature_info": "GetFeatureInfo"}.get(p.get("REQUEST", ""), p.get("REQUEST", ""))
            if request == "GetCapabilities":
                return "text/xml", self.wms_capabilities(version).encode()
            if request == "GetMap":
                return "image/png", self.get_map(p, version)
            if request == "GetFeatureInfo":
                return self.get_info(p, version)
            if request == "GetLegendGraphic":
                return "image/png", self.legend(self.layer(p.get("LAYER", "")))
            raise ServiceError("OperationNotSupported", f"no request {request!r}")
        except ServiceError as e:
            return "text/xml", exception_report(e, version).encode()

    def frame(self, p: dict[str, str], version: str) -> Frame:
        crs = p.get("CRS" if version == "1.3.0" else "SRS", "")
        if not systems.supported(crs):
            raise ServiceError("InvalidCRS" if version == "1.3.0" else "InvalidSRS", f"no system {crs!r}")
        try:
            box = [float(v) for v in p.get("BBOX", "").split(",")]
            width, height = int(p["WIDTH"]), int(p["HEIGHT"])
        except (ValueError, KeyError):
            raise ServiceError("InvalidParameterValue", "bad BBOX, WIDTH or HEIGHT") from None
        if len(box) != 4 or not all(map(math.isfinite, box)) or not (1 <= width <= LARGEST and 1 <= height <= LARGEST):
            raise ServiceError("InvalidParameterValue", "bad BBOX, WIDTH or HEIGHT")
        if version == "1.3.0" and systems.northing_first(crs):
            box = [box[1], box[0], box[3], box[2]]
        if box[0] >= box[2] or box[1] >= box[3]:
            raise ServiceError("InvalidParameterValue", "an empty BBOX")
        return Frame(crs, tuple(box), width, height)

    def tokens(self, text: str) -> list[Layer]:
        return [self.layer(t) for t in text.split(",") if t]

    def get_map(self, p: dict[str, str], version: str) -> bytes:
        frame, found = self.frame(p, version), self.tokens(p.get("LAYERS", ""))
        if not found:
            raise ServiceError("LayerNotDefined", "no layer asked for")
        if p.get("FORMAT", "image/png") not in FORMATS:
            raise ServiceError("InvalidFormat", f"no format {p.get('FORMAT')!r}")
        if any(s not in ("", "default") for s in p.get("STYLES", "").split(",")):
            raise ServiceError("StyleNotDefined", "only default styles")
        image = np.zeros((frame.height, frame.width, 4), np.uint8)
        for layer in found:
            top = self.image(layer, frame)
            a = top[..., 3:4] / 255
            under = image[..., 3:4] / 255 * (1 - a)
            alpha = a + under
            image = np.concatenate([np.where(alpha > 0, (top[..., :3] * a + image[..., :3] * under) / np.where(alpha == 0, 1, alpha), 0), alpha * 255], axis=2).round().astype(np.uint8)
        if p.get("TRANSPARENT", "FALSE").upper() != "TRUE":
            colour = background(p.get("BGCOLOR"))
            a = image[..., 3:4].astype(int)
            image = np.concatenate([(image[..., :3].astype(int) * a + np.array(colour) * (255 - a)) // 255, np.full_like(a, 255)], axis=2).astype(np.uint8)
        return png.encode(image)

    def image(self, layer: Layer, frame: Frame, bilinear: bool = False, with_labels: bool = True) -> np.ndarray:
        """RGBA of a layer in a frame."""
        if layer.tiff:
            return self.raster_image(layer, frame, bilinear)
        window = systems.source_window(frame.crs, layer.crs, frame.box)
        out = np.zeros((frame.height, frame.width, 4), np.uint8)
        if window is None:
            return out
        style = layer.style or st.Style(((st.Rule(symbols=(st.Symbol("polygon", (128, 128, 128, 255)), st.Symbol("line", None, (0, 0, 0, 255)), st.Symbol("point", (200, 0, 0, 255)))),),))
        scale = grids.request_scale(frame.box, frame.width, frame.crs)
        rows = joins.window(joins.size_gate(layer.features, grids.gate_for_scale(scale, layer.options.area_scale, layer.options.pixels)), window)
        wanted = st.referenced(style)
        found = rows.orderBy("ord").select("fid", "wkb", F.map_filter("props", lambda k, v: k.isin(*wanted)) if wanted else F.lit(None).alias("props")).toDF("fid", "wkb", "props")
        features = [(r["fid"], wkb.decode(bytes(r["wkb"])), plain(r["props"])) for r in found.toLocalIterator()]
        return render.draw([f for f in features if f[1]], style, systems.ToPixels(layer.crs, frame.crs, frame.box, frame.width, frame.height), frame.width, frame.height, scale, with_labels)

    def raster_image(self, layer: Layer, frame: Frame, bilinear: bool) -> np.ndarray:
        t = layer.tiff
        jj, ii = np.mgrid[0 : frame.height, 0 : frame.width]
        dx, dy = (frame.box[2] - frame.box[0]) / frame.width, (frame.box[3] - frame.box[1]) / frame.height
        x, y = systems.transform(frame.crs, layer.crs, (frame.box[0] + (ii + 0.5) * dx).ravel(), (frame.box[3] - (jj + 0.5) * dy).ravel())
        u, v = (x - t.origin[0]) / t.pixel[0], (t.origin[1] - y) / t.pixel[1]
        gu = np.abs(np.diff(u.reshape(frame.height, frame.width), axis=1))
        wanted = float(np.nanmean(gu)) if gu.size else 1.0
        level = raster.overview([(k, a.factor) for k, a in enumerate(t.levels)], wanted)
        a = t.levels[level]
        ok = np.isfinite(u) & np.isfinite(v) & (u >= 0) & (v >= 0) & (u < t.levels[0].width) & (v < t.levels[0].height)
        import pandas as pd

        targets = self.spark.createDataFrame(pd.DataFrame({"i": ii.ravel()[ok], "j": jj.ravel()[ok], "u": u[ok] / a.factor, "v": v[ok] / a.factor}), "i long, j long, u double, v double")
        pixels = layer.pixels[level]
        names = [c for c in pixels.columns if c not in ("col", "row")]
        if layer.expression:
            pixels, names = raster.band_math(pixels, layer.expression, t.nodata).select("col", "row", "value"), ["value"]
        if bilinear and not layer.expression:
            rows = None
            for n in names:
                one = raster.warp_bilinear(targets, pixels, n, max(1.0, wanted / a.factor), (a.width, a.height))
                rows = one if rows is None else rows.join(one, ["i", "j"])
        else:
            rows = raster.warp_nearest(targets, pixels, names)
        style = layer.style or st.Bands()
        if isinstance(style, st.Ramp):
            rows = raster.colourized(rows.withColumn("value", F.col(names[0])), style)
        else:
            pick = lambda n: F.coalesce(F.col(names[min(n, len(names)) - 1]).cast("int"), F.lit(0))
            rows = rows.select("i", "j", pick(style.red).alias("r"), pick(style.green).alias("g"), pick(style.blue).alias("b"), F.when(F.col(names[0]).isNull(), 0).otherwise(pick(4) if len(names) > 3 else F.lit(255)).alias("a"))
        out = np.zeros((frame.height, frame.width, 4), np.uint8)
        pdf = rows.select("i", "j", "r", "g", "b", "a").toPandas()
        out[pdf.j.to_numpy(int), pdf.i.to_numpy(int)] = pdf[["r", "g", "b", "a"]].to_numpy(float).clip(0, 255).astype(np.uint8)
        return out

    def get_info(self, p: dict[str, str], version: str) -> tuple[str, bytes]:
        frame = self.frame(p, version)
        try:
            i, j = int(p["I" if version == "1.3.0" else "X"]), int(p["J" if version == "1.3.0" else "Y"])
        except (KeyError, ValueError):
            raise ServiceError("InvalidPoint", "no pixel") from None
        if not (0 <= i < frame.width and 0 <= j < frame.height):
            raise ServiceError("InvalidPoint", "the pixel is outside the map")
        kind = p.get("INFO_FORMAT", "application/json")
        if kind not in INFO_FORMATS:
            raise ServiceError("InvalidFormat", f"no format {kind!r}")
        count = max(1, int(p["FEATURE_COUNT"])) if p.get("FEATURE_COUNT", "").isdigit() else 1
        bodies = [self.info(layer, frame, i, j, count, kind) for layer in self.tokens(p.get("QUERY_LAYERS", ""))]
        return kind, ("\n" if kind == "text/plain" else "").join(bodies).encode()

    def info(self, layer: Layer, frame: Frame, i: int, j: int, count: int, kind: str) -> str:
        """Features or band values under a pixel: polygons that hold its corner first, then near points; bands at its centre."""
        dx, dy = (frame.box[2] - frame.box[0]) / frame.width, (frame.box[3] - frame.box[1]) / frame.height
        if layer.tiff:
            x, y = systems.transform(frame.crs, layer.crs, np.array([frame.box[0] + (i + 0.5) * dx]), np.array([frame.box[3] - (j + 0.5) * dy]))
            t = layer.tiff
            u, v = float((x[0] - t.origin[0]) / t.pixel[0]), float((t.origin[1] - y[0]) / t.pixel[1])
            names = [c for c in layer.pixels[0].columns if c not in ("col", "row")]
            point = self.spark.createDataFrame([(u, v)], "u double, v double")
            r = raster.point_sample(point, layer.pixels[0].filter((F.col("col") == math.floor(u)) & (F.col("row") == math.floor(v))), names, (t.levels[0].width, t.levels[0].height), t.nodata, layer.expression).first().asDict()
            return formatted([{"id": layer.name, "properties": {k: v for k, v in r.items() if k not in ("u", "v", "col", "row")}, "geometry": None}], kind)
        x, y = systems.transform(frame.crs, layer.crs, np.array([frame.box[0] + i * dx]), np.array([frame.box[3] - j * dy]))
        near = systems.source_window(frame.crs, layer.crs, (frame.box[0] + (i - HIT_PIXELS) * dx, frame.box[3] - (j + HIT_PIXELS) * dy, frame.box[0] + (i + HIT_PIXELS) * dx, frame.box[3] - (j - HIT_PIXELS) * dy))
        if near is None:
            return formatted([], kind)
        project = systems.ToPixels(layer.crs, frame.crs, frame.box, frame.width, frame.height)
        polys, points = [], []
        for r in joins.window(layer.features, near).orderBy("ord").select("fid", "wkb", "props").toLocalIterator():
            geom = wkb.decode(bytes(r["wkb"]))
            one = {"id": r["fid"], "properties": plain(r["props"]), "geometry": geom}
            if geom and geom[0] == "Point":
                at = project(geom[1][0][0])
                d = math.hypot(at[0][0] - i, at[0][1] - j) if at else math.inf
                if d <= HIT_PIXELS:
                    points.append((d, one))
            elif geom and g.contains(geom, float(x[0]), float(y[0])):
                polys.append(one)
        return formatted([*polys, *(o for _, o in sorted(points, key=lambda q: q[0]))][:count], kind)

    def legend(self, layer: Layer) -> bytes:
        """A ramp, or a row of colour for each rule; there is no font, so names are left to clients."""
        if isinstance(layer.style, st.Ramp):
            lo, hi = layer.style.stops[0][0], layer.style.stops[-1][0]
            column = np.array([st.ramp_colour(layer.style, hi - (hi - lo) * k / 127) for k in range(128)], np.uint8)
            return png.encode(np.repeat(column[:, None, :], 24, axis=1))
        rules = [r for rs in layer.style.layers for r in rs][:LEGEND_ROWS] if isinstance(layer.style, st.Style) else []
        out = np.full((max(1, len(rules)) * 20, 24, 4), 255, np.uint8)
        for k, r in enumerate(rules):
            colour = next((s.fill or s.stroke for s in r.symbols if s.fill or s.stroke), None)
            if colour:
                out[k * 20 + 3 : k * 20 + 17, 3:21] = colour
        return png.encode(out)

    def wms_capabilities(self, version: str) -> str:
        rows, boxes = [], []
        key = "CRS" if version == "1.3.0" else "SRS"
        for layer in self.layers.values():
            b = systems.bounds(layer.crs, "CRS:84", layer.bounds())
            boxes += [b] if b else []
            box = "" if not b else f"<EX_GeographicBoundingBox><westBoundLongitude>{b[0]}</westBoundLongitude><eastBoundLongitude>{b[2]}</eastBoundLongitude><southBoundLatitude>{b[1]}</southBoundLatitude><northBoundLatitude>{b[3]}</northBoundLatitude></EX_GeographicBoundingBox>" if version == "1.3.0" else f'<LatLonBoundingBox minx="{b[0]}" miny="{b[1]}" maxx="{b[2]}" maxy="{b[3]}"/>'
            rows.append(f'<Layer queryable="1"><Name>{escape(layer.name)}</Name><Title>{escape(layer.title or layer.name)}</Title><{key}>{layer.crs}</{key}><{key}>EPSG:3857</{key}>{box}</Layer>')
        root = "" if version == "1.3.0" or not boxes else '<LatLonBoundingBox minx="{}" miny="{}" maxx="{}" maxy="{}"/>'.format(*(f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max))))
        name = "WMS_Capabilities" if version == "1.3.0" else "WMT_MS_Capabilities"
        return f'<?xml version="1.0"?><{name} version="{version}"><Service><Name>WMS</Name><Title>{escape(self.title)}</Title></Service><Capability><Request><GetCapabilities/><GetMap><Format>image/png</Format></GetMap><GetFeatureInfo>{"".join(f"<Format>{f}</Format>" for f in INFO_FORMATS)}</GetFeatureInfo></Request><Layer><Title>{escape(self.title)}</Title>{root}{"".join(rows)}</Layer></Capability></{name}>'

    # Tiles.

    def grid(self, layer: Layer, name: str) -> grids.Grid:
        found = grids.pick([x.id for x in layer.grids], name)
        if found is None:
            raise ServiceError("InvalidParameterValue", f"no grid {name!r}")
        return next(x for x in layer.grids if x.id == found)

    def tile(self, layer: Layer, grid: grids.Grid, z: int, col: int, row: int) -> bytes:
        """PNG of a tile, labels off, rasters smoothed; empty outside the layer."""
        box = grid.bounds(z, col, row)
        if box is None:
            raise ServiceError("TileOutOfRange", "the tile is outside the grid")
        own = systems.bounds(layer.crs, grid.crs, layer.bounds())
        if own is None or own[2] <= box[0] or own[0] >= box[2] or own[3] <= box[1] or own[1] >= box[3]:
            return png.encode(np.zeros((grid.tile_h, grid.tile_w, 4), np.uint8))
        return png.encode(self.image(layer, Frame(grid.crs, box, grid.tile_w, grid.tile_h), bilinear=True, with_labels=False))

    def vector_tile(self, layer: Layer, grid: grids.Grid, z: int, x: int, y: int) -> bytes:
        """An MVT from the archive if it has the tile, else made now."""
        if grid.bounds(z, x, y) is None:
            raise ServiceError("TileOutOfRange", "the tile is outside the grid")
        if layer.archive is not None:
            id = grids.tile_id(z, x, y)
            hit = layer.archive.filter((F.col("tile_id") <= id) & (F.col("tile_id") + F.col("run_length") > id)).select("blob").first()
            if hit:
                return bytes(hit[0])
        made = tiles.encoded(layer.features, grid, z, layer.crs, layer.name, layer.options, only=(x, y)).select("blob").first()
        return bytes(made[0]) if made else b""

    def xyz(self, name: str, grid: str, z: int, x: int, y: int) -> bytes:
        layer = self.layer(name)
        return self.vector_tile(layer, self.grid(layer, grid), z, x, y)

    def tms(self, name: str, grid: str, z: int, x: int, y: int) -> bytes:
        """A tile with rows counted from the bottom."""
        layer = self.layer(name)
        own = self.grid(layer, grid)
        level = own.level(z)
        if level is None or not 0 <= y < level.height:
            raise ServiceError("TileOutOfRange", "the tile is outside the grid")
        return self.tile(layer, own, z, x, level.height - 1 - y)

    def wmts(self, query: str) -> tuple[str, bytes]:
        """Content type and body of a WMTS request."""
        p = parameters(query)
        try:
            request = p.get("REQUEST", "")
            if request == "GetCapabilities":
                return "text/xml", self.wmts_capabilities().encode()
            layer = self.layer(p.get("LAYER", ""))
            grid = self.grid(layer, p.get("TILEMATRIXSET", ""))
            try:
                z, row, col = int(p["TILEMATRIX"].split(":")[-1]), int(p["TILEROW"]), int(p["TILECOL"])
            except (KeyError, ValueError):
                raise ServiceError("MissingParameterValue", "no tile") from None
            if request == "GetTile":
                if "mvt" in p.get("FORMAT", "") or "mapbox" in p.get("FORMAT", ""):
                    return "application/vnd.mapbox-vector-tile", self.vector_tile(layer, grid, z, col, row)
                return "image/png", self.tile(layer, grid, z, col, row)
            if request == "GetFeatureInfo":
                box = grid.bounds(z, col, row)
                if box is None:
                    raise ServiceError("TileOutOfRange", "the tile is outside the grid")
                kind = p.get("INFOFORMAT", "application/json")
                return kind, self.info(layer, Frame(grid.crs, box, grid.tile_w, grid.tile_h), int(p.get("I", 0)), int(p.get("J", 0)), 1, kind).encode()
            raise ServiceError("OperationNotSupported", f"no request {request!r}")
        except ServiceError as e:
            return "text/xml", f'<?xml version="1.0"?><ExceptionReport version="1.1.0"><Exception exceptionCode="{e.code}"><ExceptionText>{escape(str(e))}</ExceptionText></Exception></ExceptionReport>'.encode()

    def wmts_capabilities(self) -> str:
        layers, sets = [], {}
        for layer in self.layers.values():
            links = []
            for grid in layer.grids:
                sets[grid.id] = grid
                own = systems.bounds(layer.crs, grid.crs, layer.bounds())
                limits = "".join(f"<TileMatrixLimits><TileMatrix>{x.z}</TileMatrix><MinTileRow>{c[2]}</MinTileRow><MaxTileRow>{c[3]}</MaxTileRow><MinTileCol>{c[0]}</MinTileCol><MaxTileCol>{c[1]}</MaxTileCol></TileMatrixLimits>" for x in grid.levels if own and (c := grid.cover(own, x.z)))
                links.append(f"<TileMatrixSetLink><TileMatrixSet>{grid.id}</TileMatrixSet><TileMatrixSetLimits>{limits}</TileMatrixSetLimits></TileMatrixSetLink>")
            layers.append(f"<Layer><ows:Title>{escape(layer.title or layer.name)}</ows:Title><ows:Identifier>{escape(layer.name)}</ows:Identifier><Format>image/png</Format>{''.join(links)}</Layer>")
        matrices = []
        for grid in sets.values():
            urn = "urn:ogc:def:crs:OGC:1.3:CRS84" if grid.crs == "CRS:84" else f"urn:ogc:def:crs:EPSG::{grid.crs.split(':')[-1]}"
            corner = f"{grid.origin_y} {grid.origin_x}" if systems.northing_first(grid.crs) else f"{grid.origin_x} {grid.origin_y}"
            rows = "".join(f"<TileMatrix><ows:Identifier>{x.z}</ows:Identifier><ScaleDenominator>{grid.scale_denominator(x.z)}</ScaleDenominator><TopLeftCorner>{corner}</TopLeftCorner><TileWidth>{grid.tile_w}</TileWidth><TileHeight>{grid.tile_h}</TileHeight><MatrixWidth>{x.width}</MatrixWidth><MatrixHeight>{x.height}</MatrixHeight></TileMatrix>" for x in grid.levels)
            matrices.append(f"<TileMatrixSet><ows:Identifier>{grid.id}</ows:Identifier><ows:SupportedCRS>{urn}</ows:SupportedCRS>{rows}</TileMatrixSet>")
        return f'<?xml version="1.0"?><Capabilities xmlns="http://www.opengis.net/wmts/1.0" xmlns:ows="http://www.opengis.net/ows/1.1" version="1.0.0"><Contents>{"".join(layers)}{"".join(matrices)}</Contents></Capabilities>'

    def tms_map(self, name: str, grid: str) -> str:
        layer = self.layer(name)
        own = self.grid(layer, grid)
        e = own.extent()
        profile = {"EPSG:3857": "global-mercator", "EPSG:4326": "global-geodetic", "CRS:84": "global-geodetic"}.get(own.crs, "local")
        sets = "".join(f'<TileSet href="{x.z}" units-per-pixel="{x.resolution}" order="{x.z}"/>' for x in own.levels)
        return f'<?xml version="1.0"?><TileMap version="1.0.0"><Title>{escape(layer.title or name)}</Title><SRS>{own.crs}</SRS><BoundingBox minx="{e[0]}" miny="{e[1]}" maxx="{e[2]}" maxy="{e[3]}"/><Origin x="{e[0]}" y="{e[1]}"/><TileFormat width="{own.tile_w}" height="{own.tile_h}" mime-type="image/png" extension="png"/><TileSets profile="{profile}">{sets}</TileSets></TileMap>'

    def tms_service(self) -> str:
        rows = "".join(f'<TileMap title="{escape(n)}" srs="{x.crs}" href="{n}/{x.id}"/>' for n, layer in self.layers.items() for x in layer.grids)
        return f'<?xml version="1.0"?><TileMapService version="1.0.0"><Title>{escape(self.title)}</Title><TileMaps>{rows}</TileMaps></TileMapService>'

    def fields(self, layer: Layer) -> dict[str, str]:
        """Attribute types of a vector layer by first value."""
        from ..operators.aggregates import field_schema

        a = layer.features.select("ord", F.explode("props").alias("field", "v")).select("ord", "field", F.when(F.col("v.n").isNotNull(), "Number").when(F.col("v.s").isNotNull(), "String").alias("kind"))
        return {r["field"]: r["type"] for r in field_schema(a).collect()}

    def tilejson(self, name: str, grid: str, base: str) -> dict:
        layer = self.layer(name)
        own = self.grid(layer, grid)
        b = systems.bounds(layer.crs, "CRS:84", layer.bounds())
        return {"tilejson": "3.0.0", "name": name, "tiles": [f"{base}/mvt/{name}/{own.id}/{{z}}/{{x}}/{{y}}.pbf"], "minzoom": own.levels[0].z, "maxzoom": own.levels[-1].z, "bounds": list(b) if b else None, "vector_layers": [{"id": name, "fields": self.fields(layer)}]}

    def client_style(self, name: str, base: str) -> dict:
        """A client style document: a fill by class where the layer's style has class rules, else plain layers of each kind."""
        layer = self.layer(name)
        source = {"type": "vector", "url": f"{base}/tilejson/{name}"}
        common = {"source": name, "source-layer": name}
        hexed = lambda c: "#%02x%02x%02x" % tuple(c[:3])
        fills = [(r.filter, s.fill) for rs in (layer.style.layers if isinstance(layer.style, st.Style) else ()) for r in rs for s in r.symbols if s.kind == "polygon" and s.fill]
        classed = [(f.field, f.literal, c) for f, c in fills if f is not None and getattr(f, "op", "") == "="]
        if classed:
            paint = ["match", ["to-string", ["get", classed[0][0]]], *[v for f, lit, c in classed if f == classed[0][0] for v in (lit, hexed(c))], "#cccccc"]
            made = [{"id": f"{name}-fill", "type": "fill", **common, "paint": {"fill-color": paint}}]
        else:
            made = [{"id": f"{name}-fill", "type": "fill", **common, "filter": ["==", ["geometry-type"], "Polygon"], "paint": {"fill-color": "#888888", "fill-opacity": 0.4}}, {"id": f"{name}-line", "type": "line", **common, "paint": {"line-color": "#333333"}}, {"id": f"{name}-point", "type": "circle", **common, "filter": ["==", ["geometry-type"], "Point"], "paint": {"circle-radius": 3}}]
        return {"version": 8, "sources": {name: source}, "layers": made}


def client_fields(style: dict) -> list[str]:
    """Attributes that a client style gets."""
    out: list[str] = []

    def walk(v: object) -> None:
        if isinstance(v, list):
            if len(v) == 2 and v[0] == "get" and isinstance(v[1], str):
                out.append(v[1])
            for x in v:
                walk(x)
        elif isinstance(v, dict):
            for x in v.values():
                walk(x)

    walk(style.get("layers", []))
    return list(dict.fromkeys(out))


def parameters(query: str) -> dict[str, str]:
    """Key-value pairs with keys in upper case; the first of a repeated key counts."""
    out: dict[str, str] = {}
    for k, v in parse_qsl(query.lstrip("?"), keep_blank_values=True):
        out.setdefault(k.upper(), v)
    return out


def negotiated(version: str | None) -> str:
    """1.3.0 but for requests that ask for something lower."""
    try:
        asked = tuple(int(x) for x in (version or "1.3.0").split("."))
    except ValueError:
        return "1.3.0"
    return "1.3.0" if asked >= (1, 3, 0) else "1.1.1"


def background(text: str | None) -> tuple[int, int, int]:
    h = (text or "0xFFFFFF").lower().removeprefix("0x").lstrip("#")
    try:
        return tuple(int(h[k : k + 2], 16) for k in (0, 2, 4)) if len(h) == 6 else (255, 255, 255)
    except ValueError:
        return 255, 255, 255


def plain(props) -> dict:
    return {k: None if v is None else v["s"] if v["s"] is not None else v["n"] for k, v in (props or {}).items()}


def exception_report(e: ServiceError, version: str) -> str:
    return f'<?xml version="1.0"?><ServiceExceptionReport version="{version}"><ServiceException code="{e.code}">{escape(str(e))}</ServiceException></ServiceExceptionReport>'


def geojson(geom: tuple | None) -> dict | None:
    if geom is None:
        return None
    kind, parts = geom
    c = {"Point": lambda: list(parts[0][0][0]), "LineString": lambda: [list(p) for p in parts[0][0]], "Polygon": lambda: [[list(p) for p in r] for r in parts[0]], "MultiLineString": lambda: [[list(p) for p in part[0]] for part in parts], "MultiPolygon": lambda: [[[list(p) for p in r] for r in part] for part in parts]}[kind]()
    return {"type": kind, "coordinates": c}


def formatted(found: list[dict], kind: str) -> str:
    """Features as JSON, text, HTML or GML."""
    if kind == "application/json":
        return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": f["id"], "geometry": geojson(f["geometry"]), "properties": f["properties"]} for f in found]}, ensure_ascii=False)
    show = lambda v: "" if v is None else st.number_text(v) if isinstance(v, float) else str(v)
    if kind == "text/plain":
        return "\n".join("\n".join([f"Feature {f['id']}", *(f"{k} = {show(v)}" for k, v in f["properties"].items())]) for f in found) or "no features"
    if kind == "text/html":
        return "".join("<table>" + "".join(f"<tr><th>{html_escape(k)}</th><td>{html_escape(show(v))}</td></tr>" for k, v in f["properties"].items()) + "</table>" for f in found)
    return "<FeatureCollection>" + "".join(f'<featureMember fid="{f["id"]}">' + "".join(f"<property name=\"{escape(k)}\">{escape(show(v))}</property>" for k, v in f["properties"].items()) + "</featureMember>" for f in found) + "</FeatureCollection>"


def style_of(document: str):
    """A vector style from an SLD or JSON text."""
    return sld.parse(document) if sld.looks_like(document) else st.style_from_json(document)
