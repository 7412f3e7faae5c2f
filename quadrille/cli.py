"""A thin command line: python -m quadrille.cli {map,tile,bake,topology,wms} ... ; everything it does is a call of the library."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    """Run one command; returns the exit status."""
    top = argparse.ArgumentParser(prog="quadrille")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("map", "wms", "tile", "bake", "topology"):
        p = sub.add_parser(name)
        p.add_argument("source", help="path of a vector or raster source")
        p.add_argument("--crs", default="EPSG:4326")
        p.add_argument("--style", help="SLD or JSON style file")
        p.add_argument("--out", default="-")
        if name == "map":
            p.add_argument("--bbox", required=True)
            p.add_argument("--size", default="512,512")
        elif name == "wms":
            p.add_argument("query")
        elif name == "tile":
            p.add_argument("zxy", help="z/x/y")
        elif name == "bake":
            p.add_argument("--zooms", default="0-6")
            p.add_argument("--pixels", type=float, default=0.0)
            p.add_argument("--budget", type=int, default=0)
            p.add_argument("--dissolve")
            p.add_argument("--mosaic")
        else:
            p.add_argument("--tolerance", type=float, default=1e-7)
    a = top.parse_args(argv)

    from pyspark.sql import SparkSession

    from .functions import crs as systems
    from .functions import grids, mvt
    from .functions.style import Bands, raster_style
    from .operators import tiles, topology
    from .plans.service import Layer, Service, style_of
    from .sources import raster, vector

    spark = SparkSession.builder.appName("quadrille").getOrCreate()
    style = open(a.style, encoding="utf-8").read() if a.style else None
    grid = grids.preset("WebMercatorQuad")
    if vector.classify(a.source) == "geotiff":
        t = raster.read_header(a.source)
        chunks = vector.load(spark, a.source)
        layer = Layer("layer", f"EPSG:{t.epsg}" if t.epsg else a.crs, [grid], None, {k: raster.pixels(chunks, t, k) for k in range(len(t.levels))}, t, raster_style(style) if style else Bands())
    else:
        layer = Layer("layer", a.crs, [grid], vector.load(spark, a.source), style=style_of(style) if style else None)
    service = Service(spark)
    service.add(layer)

    def give(data: bytes) -> None:
        if a.out == "-":
            sys.stdout.buffer.write(data)
        else:
            with open(a.out, "wb") as f:
                f.write(data)

    if a.command == "map":
        w, h = a.size.split(",")
        give(service.wms(f"VERSION=1.1.1&REQUEST=GetMap&LAYERS=layer&SRS={a.crs}&BBOX={a.bbox}&WIDTH={w}&HEIGHT={h}")[1])
    elif a.command == "wms":
        give(service.wms(a.query)[1])
    elif a.command == "tile":
        z, x, y = map(int, a.zxy.split("/"))
        give(service.xyz("layer", grid.id, z, x, y) if layer.features is not None else service.tile(layer, grid, z, x, y))
    elif a.command == "bake":
        low, _, high = a.zooms.partition("-")
        bounds = layer.bounds()
        scale = grids.area_scale(systems.bounds(a.crs, "CRS:84", bounds), bounds)
        options = mvt.Options(pixels=a.pixels, area_scale=scale, budget=a.budget, dissolve_field=a.dissolve, cell_field=a.mosaic)
        print(tiles.bake(layer.features, a.out, grid, range(int(low), int(high or low) + 1), a.crs, "layer", options))
    else:
        refs = topology.ring_refs(topology.snapped_rings(layer.features, a.tolerance))
        print(topology.report(refs, topology.arcs(refs)).first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
