import json
import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.functions import grids, mvt, style, wkb
from quadrille.operators import raster as ro
from quadrille.operators import tiles, topology
from quadrille.plans.service import Layer, Service, client_fields
from quadrille.sources import archive, config, raster, vector
from quadrille.streaming import overlay

DOC = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"name": "pt", "length": 3, "flag": True}, "geometry": {"type": "Point", "coordinates": [10, 10]}},
        {"type": "Feature", "properties": {"name": "ln", "ne_id": 77}, "geometry": {"type": "LineString", "coordinates": [[-20, -20], [20, 20]]}},
        {"type": "Feature", "properties": {"kind": "poly", "area": 1.5}, "geometry": {"type": "Polygon", "coordinates": [[[-30, -30], [30, -30], [30, 30], [-30, 30], [-30, -30]], [[-10, -10], [10, -10], [10, 10], [-10, 10], [-10, -10]]]}},
        {"type": "Feature", "properties": None, "geometry": None},
    ],
}


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("geo") / "a.geojson"
    path.write_text(json.dumps(DOC))
    return vector.load(spark, str(path)).cache()


def test_geojson(features):
    rows = {r.fid: r for r in features.collect()}
    assert sorted(rows) == [0, 2, 77] and rows[0].props["flag"].n is None and rows[0].props["length"].n == 3.0
    assert rows[2].area == 3200 and (rows[2].minx, rows[2].maxy) == (-30, 30)


def test_geojson_errors(spark, tmp_path):
    (tmp_path / "x.geojson").write_text('{"type": "Feature"}')
    with pytest.raises(Exception, match="FeatureCollection"):
        vector.load(spark, str(tmp_path / "x.geojson")).collect()
    with pytest.raises(ValueError):
        vector.classify("a.xyz")
    assert vector.classify("A.GPKG") == "geopackage" and vector.classify("POSTGIS://h/d?table=t") == "postgis"


def geopackage(path, indexed):
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE gpkg_contents(table_name, data_type); CREATE TABLE gpkg_geometry_columns(table_name, column_name, srs_id); CREATE TABLE gpkg_spatial_ref_sys(srs_id, organization, organization_coordsys_id); CREATE TABLE t(id INTEGER PRIMARY KEY, geom BLOB, name TEXT, n REAL);")
    db.execute("INSERT INTO gpkg_contents VALUES ('t', 'features')")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom', 4326)")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (4326, 'EPSG', 4326)")
    for i in range(1, 101):
        geom = ("Point", [[[(float(i), float(i % 10))]]])
        db.execute("INSERT INTO t VALUES (?, ?, ?, ?)", [i, wkb.encode_blob(geom, 4326) if i != 50 else b"bad", f"n{i}", i / 2])
    if indexed:
        db.execute("CREATE TABLE rtree_t_geom(id, minx, maxx, miny, maxy)")
        db.executemany("INSERT INTO rtree_t_geom VALUES (?, ?, ?, ?, ?)", [(i, i, i, i % 10, i % 10) for i in range(1, 101)])
    db.commit()
    db.close()


@pytest.mark.parametrize("indexed", [True, False])
def test_geopackage(spark, tmp_path, indexed):
    path = str(tmp_path / "a.gpkg")
    geopackage(path, indexed)
    assert vector.geopackage_crs(path) == "EPSG:4326"
    df = vector.load(spark, path)
    assert df.count() == 99 and df.rdd.getNumPartitions() == 8
    window = vector.load(spark, path, minx="10", miny="0", maxx="20", maxy="9")
    assert sorted(r.fid for r in window.collect()) == list(range(10, 21))
    assert vector.load(spark, path, minx="900", miny="0", maxx="901", maxy="9").count() == 0  # an empty window is a result
    with pytest.raises(Exception):
        vector.load(spark, str(tmp_path / "none.gpkg")).count()  # a failed read is not


class Flat:
    """A small FlatBuffers writer, for this test only: tables from the end of their fields."""

    @staticmethod
    def table(fields):
        """fields: {number: (kind, value)}; kinds: struct code, 's' text, 'v<code>' vector, 't' table, 'tv' tables."""
        n = max(fields, default=-1) + 1
        vt_size = 4 + 2 * n
        body, tails, at = bytearray(4), [], 4
        offsets = [0] * n
        for k in sorted(fields):
            kind, value = fields[k]
            if kind in ("s", "t", "tv") or kind[0] == "v":
                while at % 4:
                    body += b"\0"
                    at += 1
                offsets[k] = at
                tails.append((at, kind, value))
                body += b"\0\0\0\0"
                at += 4
            else:
                size = struct.calcsize("<" + kind)
                while at % size:
                    body += b"\0"
                    at += 1
                offsets[k] = at
                body += struct.pack("<" + kind, value)
                at += size
        table_size = len(body)
        out = bytearray(struct.pack("<HH", vt_size, table_size) + struct.pack(f"<{n}H", *offsets))
        start = len(out)
        out += body
        struct.pack_into("<i", out, start, start)
        for at, kind, value in tails:
            while len(out) % 8 != 4:
                out += b"\0"
            struct.pack_into("<I", out, start + at, len(out) - (start + at))
            if kind == "s":
                out += struct.pack("<I", len(value)) + value.encode() + b"\0"
            elif kind[0] == "v":
                out += struct.pack("<I", len(value)) + struct.pack(f"<{len(value)}{kind[1:]}", *value)
            elif kind == "t":
                inner, root = Flat.table(value)
                struct.pack_into("<I", out, start + at, len(out) + root - (start + at))
                out += inner
            else:
                base = len(out)
                out += struct.pack("<I", len(value)) + b"\0\0\0\0" * len(value)
                for i, v in enumerate(value):
                    while len(out) % 8:
                        out += b"\0"
                    inner, root = Flat.table(v)
                    struct.pack_into("<I", out, base + 4 + 4 * i, len(out) + root - (base + 4 + 4 * i))
                    out += inner
        return bytes(out), start

    @staticmethod
    def sized(fields):
        data, root = Flat.table(fields)
        data = struct.pack("<I", root + 4) + data
        return struct.pack("<I", len(data)) + data


def flatgeobuf(path, indexed):
    feats, boxes = [], []
    for i in range(40):
        props = struct.pack("<HI", 0, 2) + b"n%d" % (i % 10) + struct.pack("<Hd", 1, i / 2)
        feats.append(Flat.sized({0: ("t", {1: ("vd", [float(i), float(i % 7)])}), 1: ("vB", list(props))}))
        boxes.append((float(i), float(i % 7)) * 2)
    header = {0: ("s", "pts"), 2: ("B", 1), 7: ("tv", [{0: ("s", "name"), 1: ("B", 11)}, {0: ("s", "v"), 1: ("B", 10)}]), 8: ("Q", 40), 9: ("H", 16 if indexed else 0), 10: ("t", {1: ("i", 3857)})}
    offsets = np.cumsum([0, *map(len, feats)]).tolist()
    nodes = b""
    if indexed:
        leaves = [(*b, o) for b, o in zip(boxes, offsets)]
        join = lambda part: (min(p[0] for p in part), min(p[1] for p in part), max(p[2] for p in part), max(p[3] for p in part))
        mid = [(*join(leaves[i : i + 16]), 4 + i) for i in range(0, 40, 16)]
        nodes = b"".join(struct.pack("<4dQ", *n) for n in [(*join(leaves), 1), *mid, *leaves])
    with open(path, "wb") as f:
        f.write(b"fgb\x03fgb\x00" + Flat.sized(header) + nodes + b"".join(feats))


@pytest.mark.parametrize("indexed", [True, False])
def test_flatgeobuf(spark, tmp_path, indexed):
    path = str(tmp_path / "a.fgb")
    flatgeobuf(path, indexed)
    f = vector.FlatGeobuf(path)
    assert (f.name, f.crs, f.count) == ("pts", "EPSG:3857", 40)
    rows = vector.load(spark, path).collect()
    assert len(rows) == 40 and {r.props["name"].s for r in rows} == {f"n{i}" for i in range(10)} and sum(r.props["v"].n for r in rows) == 390
    got = vector.load(spark, path, minx="10", miny="0", maxx="13", maxy="7").collect()
    assert sorted(r.minx for r in got) == [10, 11, 12, 13]


def image(n=100):
    y, x = np.mgrid[0:n, 0:n]
    return np.stack([x, y, (x + y) % 256], axis=2).astype(np.uint8)


@pytest.mark.parametrize("predictor", [1, 2])
def test_geotiff(spark, tmp_path, predictor):
    path = str(tmp_path / "a.tif")
    raster.write_tiff(path, image(), 32, (1000.0, 2000.0), (10.0, 10.0), overviews=1, predictor=predictor, nodata=255)
    t = raster.read_header(path)
    assert [x.factor for x in t.levels] == [1.0, 2.0] and t.origin == (1000.0, 2000.0) and t.nodata == 255 and t.epsg == 3857
    px = raster.pixels(vector.load(spark, path), t, 0, [1, 2])
    assert px.count() == 10_000 and px.filter("b1 <> col OR b2 <> row").count() == 0
    assert ro.overview([(0, 1.0), (1, 2.0)], 1.9) == 0 and ro.overview([(0, 1.0), (1, 2.0)], 2.0) == 1
    sample = ro.point_sample(spark.createDataFrame([(3.5, 4.5), (500.0, 1.0)], "u double, v double"), px, ["b1", "b2"], (100, 100), expression="B1 + B2").orderBy("u").collect()
    assert sample[0].derived == 7.0 and sample[0].in_image and not sample[1].in_image and sample[1].b1 is None


def test_lzw_and_float_predictor():
    import zlib

    # clear, 65, 66, 65, end in nine-bit codes
    bits = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert raster.lzw(data) == b"ABAB"
    values = np.array([[1.5, -2.25, 1e9, 0.0]], ">f4")
    planes = np.moveaxis(values.view(np.uint8).reshape(1, 4, 4), 2, 1).reshape(1, 16)
    packed = np.diff(planes, axis=1, prepend=np.zeros((1, 1), np.uint8))
    level = raster.Level(4, 1, 4, 1, 1, 32, 3, 8, 3, (), ())
    assert raster.samples(zlib.compress(packed.tobytes()), level)[0, :, 0].tolist() == [1.5, -2.25, 1e9, 0.0]
    assert raster.samples(None, level).sum() == 0


def test_pyramid_archive_and_tiles(spark, features, tmp_path):
    path = str(tmp_path / "p.pmtiles")
    counts = tiles.bake(features, path, grids.preset("WebMercatorQuad"), range(3), "EPSG:4326", "mini")
    back = {r.tile_id: bytes(r.blob) for r in archive.expanded(vector.load(spark, path)).collect()}
    live = {r.tile_id: bytes(r.blob) for r in tiles.pyramid(features, grids.preset("WebMercatorQuad"), range(3), "EPSG:4326", "mini").collect()}
    assert back == live and counts["addressed"] == len(live) and mvt.count_features(live[0]) == 3


def test_tile_rows_by_columns():
    """Shapes and layers made from columns have the bytes of those made one by one; a layer goes on over batches."""
    import numpy as np
    import pyarrow as pa

    from quadrille.functions import mvt

    rng = np.random.default_rng(3)
    corner, size = rng.uniform(-400, 4300, (300, 2)), rng.choice([0.2, 3.0, 200.0], (300, 1))
    points = np.stack([corner, corner + size * [1, 0], corner + size, corner + size * [0, 1], corner], axis=1)
    points[::2] = points[::2, ::-1]
    assert [len(p) for _, p in wkb.single_rings(pa.array([wkb.encode(("Polygon", [[[tuple(q) for q in r] for r in [p]]])) for p in points.tolist()], pa.binary()))] == [300]
    which, data, sizes = mvt.simple_shapes(points)
    made = mvt.binary(data, sizes).to_pylist()
    one = lambda i: mvt.commands(("Polygon", [[[tuple(q) for q in points[i].tolist()]]]), lambda r: r)
    assert made == [mvt.shape(*one(i)) for i in which.tolist()] and 100 < len(which) < 300
    names = [None, [], ["a"], ["a", "b"], ["a", "b", "ü"]]
    rows = [(i << 20, names[i % 5], made[i]) for i in range(len(made))]
    text = lambda i, k: f"t{i % 7}" * 60 if (i + k) % 3 == 0 else None
    number = lambda i, k: (None, float("nan"), -0.0, 0.0, i / 4)[(i + k) % 5] if text(i, k) is None else 1.0
    layer, want = mvt.Layer("rows"), mvt.Layer("rows")
    for a, b in ((0, 90), (90, 91), (91, len(rows))):
        own = range(a, b)
        lists = lambda f: [None if rows[i][1] is None else [f(i, k) for k in range(len(rows[i][1]))] for i in own]
        layer.add_rows(pa.array([rows[i][0] for i in own]), pa.array([rows[i][1] for i in own], pa.list_(pa.string())), pa.array(lists(text), pa.list_(pa.string())), pa.array(lists(number), pa.list_(pa.float64())), pa.array([rows[i][2] for i in own], pa.binary()))
    for i, (fid, keys, shape) in enumerate(rows):
        values = [(k, text(i, j) if text(i, j) is not None else n if (n := number(i, j)) is not None and n == n else None) for j, k in enumerate(keys or [])]
        want.add(fid, want.tags(values), shape)
    assert layer.encoded() == want.encoded() and mvt.count_features(layer.encoded()) == len(rows)


def test_topology_report_and_simplify(spark):
    zigzag = [(100.0, float(y)) if y % 2 else (101.0, float(y)) for y in range(1, 20)]
    a = ("Polygon", [[[(0.0, 0.0), (100.0, 0.0), *zigzag, (100.0, 20.0), (0.0, 20.0)]]])
    b = ("Polygon", [[[(200.0, 0.0), (200.0, 20.0), (100.0, 20.0), *zigzag[::-1], (100.0, 0.0)]]])
    rows = spark.createDataFrame([(1, wkb.encode(a)), (2, wkb.encode(b))], "fid long, wkb binary")
    rings = topology.snapped_rings(rows, 1.0)
    refs = topology.ring_refs(rings)
    pool = topology.arcs(refs)
    assert topology.report(refs, pool).first().shared == 1
    assert topology.mismatches(rings, topology.rebuilt(refs, pool)).count() == 0
    out = topology.rebuilt(refs, topology.simplified(pool, 20.0))
    total = sum(abs(g.ring_area2([(p.x, p.y) for p in r.pts])) / 2 for r in out.collect())
    assert total == 4000  # both sides of the shared line move alike
    with pytest.raises(ValueError):
        topology.snapped_rings(rows, 0.0)


def test_levels_of_detail_join_no_arcs(spark):
    """A part's pieces meet once for all zooms; rings equal those of simplified arcs that are put together and culled."""
    zigzag = [(100.0, float(y)) if y % 2 else (101.0, float(y)) for y in range(1, 20)]
    a = ("Polygon", [[[(0.0, 0.0), (100.0, 0.0), *zigzag, (100.0, 20.0), (0.0, 20.0)], [(10.0, 5.0), (10.0, 6.0), (20.0, 6.0), (20.0, 5.0)]]])
    b = ("MultiPolygon", [[[(200.0, 0.0), (200.0, 20.0), (100.0, 20.0), *zigzag[::-1], (100.0, 0.0)]], [[(300.0, 0.0), (303.0, 0.0), (303.0, 3.0)]]])
    rows = spark.createDataFrame([(1, wkb.encode(a)), (2, wkb.encode(b)), (3, None)], "fid long, wkb binary").filter("wkb IS NOT NULL")
    refs = topology.ring_refs(topology.snapped_rings(rows, 1.0))
    made = topology.levels_of_detail(refs, 1.0, grids.metres_per_pixel(0) ** 2, range(3), 20.0)
    assert " Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    points = lambda r: [(p.x, p.y) for p in r.pts]
    want = []
    for z, least in ((0, 20.0), (1, 5.0), (2, 0.0)):
        again = topology.culled(topology.rebuilt(refs, topology.simplified(topology.arcs(refs), least)), least)
        want += [(z, r.fid, r.part, r.ring, points(r)) for r in again.collect()]
    got = [(r.z, r.fid, r.part, r.ring, points(r)) for r in made.collect()]
    assert sorted(got) == sorted(want) and len(got) == 2 + 3 + 4


def test_first_hits_of_copies(spark):
    """Copies of queries, boxes and corners give the answers of all pairs, from few pairs."""
    from quadrille.operators import joins

    q = [(i, float(i * 7 % 10), float(i * 3 % 10)) for i in range(40)] + [(0, 0.0, 0.0), (0, 5.0, 5.0), (41, None, 1.0)]
    b = [(n * 50 + i, float(i % 9), float(i * 5 % 9), float(i % 9 + 1 + i % 3), float(i * 5 % 9 + 1 + i % 2)) for n in range(30) for i in range(50)]
    queries = spark.createDataFrame(q, "query_id long, px double, py double")
    features = spark.createDataFrame(b, "fid long, minx double, miny double, maxx double, maxy double")
    want = []
    for id in {r[0] for r in q}:
        hits = []
        for _, x, y in [r for r in q if r[0] == id and r[1] is not None]:
            hits += [(0, 0.0, f) for f, x0, y0, x1, y1 in b if x0 <= x < x1 and y0 <= y < y1]
            hits += [(1, d, f) for f, x0, y0, *_ in b if (d := (x0 - x) ** 2 + (y0 - y) ** 2) <= 4.0]
        want += [(id, h[2], rank) for rank, h in enumerate(sorted(hits)[:7], 1)]
    got = joins.first_hits(queries, features, 4.0, 2.0, 7)
    assert sorted((r.query_id, r.fid, r.rank) for r in got.collect()) == sorted(want)
    assert joins.least_of(features, ["minx", "miny", "maxx", "maxy"], "fid", 7).count() < len(b) / 3


def test_labels_of_copies(spark):
    """Many labels at one anchor: as many go on as there are spots, and the placed ones are those of all items."""
    from quadrille.operators import labels

    at = [(10.0 * (i % 5), 30.0 * (i % 4), 3.0, 2.0, *((18.0, 12.0), (0.4, 12.0), (0.0, 12.0))[0 if i % 40 else i // 40 % 3]) for i in range(4000)]
    rows = [(i % 2, i, float(i * 37 % 101), *a) for i, a in enumerate(at)]
    items = spark.createDataFrame(rows, "frame long, fid long, priority double, x double, y double, radius double, offset double, width double, height double")
    want = set()
    for frame in (0, 1):
        own = [(r[2], r[1], *r[3:]) for r in rows if r[0] == frame]
        want |= {(frame, own[i][1], a, b) for i, a, b in labels.placed(own)}
    assert {tuple(r) for r in labels.place(items).collect()} == want and len(want) > 20
    assert labels.contenders(items).count() < 1000
    obstacles = labels.Obstacles()
    for _ in range(9):
        obstacles.add((0, 0, 2, 2))
    assert sum(map(len, obstacles.cells.values())) == 1


@pytest.fixture(scope="module")
def service(spark, features, tmp_path_factory):
    s = Service(spark, "Test & maps")
    s.add(Layer("mini", "EPSG:4326", [grids.preset("WebMercatorQuad")], features))
    path = str(tmp_path_factory.mktemp("r") / "a.tif")
    raster.write_tiff(path, image(64), 32, (0.0, 64.0), (1.0, 1.0), overviews=1)
    t = raster.read_header(path)
    chunks = vector.load(spark, path)
    s.add(Layer("img", "EPSG:3857", [grids.for_raster("EPSG:3857", 0.0, 64.0, 1.0, 1.0, 64, 64, 2, 32)], None, {k: raster.pixels(chunks, t, k) for k in range(2)}, t, style.Bands()))
    return s


def test_wms_map_and_errors(service):
    from quadrille.functions import png

    kind, body = service.wms("SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS=mini&CRS=EPSG:4326&BBOX=-40,-40,40,40&WIDTH=40&HEIGHT=40&TRANSPARENT=TRUE")
    im = png.decode(body)
    assert kind == "image/png" and im[20, 7, 3] == 255 and im[23, 23, 3] == 0 and im[1, 1, 3] == 0
    _, whole = service.wms("VERSION=1.3.0&REQUEST=GetMap&LAYERS=img&CRS=EPSG:3857&BBOX=0,0,64,64&WIDTH=64&HEIGHT=64")
    assert (png.decode(whole)[..., :3] == image(64)).all()
    for query, code in [("REQUEST=GetMap&LAYERS=no&CRS=EPSG:4326&BBOX=0,0,1,1&WIDTH=2&HEIGHT=2", "LayerNotDefined"), ("REQUEST=GetMap&LAYERS=mini&CRS=EPSG:1&BBOX=0,0,1,1&WIDTH=2&HEIGHT=2", "InvalidCRS"), ("REQUEST=GetMap&LAYERS=mini&CRS=EPSG:4326&BBOX=0,0,1,1&WIDTH=99999&HEIGHT=2", "InvalidParameterValue"), ("REQUEST=Nope", "OperationNotSupported")]:
        kind, body = service.wms(query)
        assert kind == "text/xml" and f'code="{code}"' in body.decode()


def test_feature_info(service):
    q = "VERSION=1.1.1&REQUEST=GetFeatureInfo&QUERY_LAYERS=mini&LAYERS=mini&SRS=EPSG:4326&BBOX=-40,-40,40,40&WIDTH=80&HEIGHT=80&X={}&Y={}&FEATURE_COUNT=5&INFO_FORMAT={}"
    found = json.loads(service.wms(q.format(15, 15, "application/json"))[1])["features"]
    assert [f["id"] for f in found] == [2] and found[0]["properties"]["area"] == 1.5
    found = json.loads(service.wms(q.format(52, 28, "application/json"))[1])["features"]
    assert [f["id"] for f in found][-1] == 0
    assert "kind = poly" in service.wms(q.format(15, 15, "text/plain"))[1].decode()
    q = "VERSION=1.3.0&REQUEST=GetFeatureInfo&QUERY_LAYERS=img&LAYERS=img&CRS=EPSG:3857&BBOX=0,0,64,64&WIDTH=64&HEIGHT=64&I=5&J=9"
    assert json.loads(service.wms(q)[1])["features"][0]["properties"]["b1"] == 5.0


def test_tiles_agree_between_protocols(service):
    kind, mvt_tile = service.wmts("REQUEST=GetTile&LAYER=mini&TILEMATRIXSET=WebMercatorQuad&TILEMATRIX=1&TILEROW=0&TILECOL=1&FORMAT=application/vnd.mapbox-vector-tile")
    assert mvt_tile == service.xyz("mini", "WebMercatorQuad", 1, 1, 0) and mvt.count_features(mvt_tile) == 3
    _, a = service.wmts("REQUEST=GetTile&LAYER=img&TILEMATRIXSET=from_cog&TILEMATRIX=1&TILEROW=0&TILECOL=1")
    assert a == service.tms("img", "from_cog", 1, 1, 1) and b"ows:Identifier" in service.wmts("REQUEST=GetCapabilities")[1]
    _, body = service.wmts("REQUEST=GetTile&LAYER=img&TILEMATRIXSET=from_cog&TILEMATRIX=1&TILEROW=9&TILECOL=1")
    assert b"TileOutOfRange" in body
    doc = service.tilejson("mini", "WebMercatorQuad", "http://h")
    assert doc["vector_layers"][0]["fields"]["length"] == "Number" and "TileSets" in service.tms_map("img", "from_cog")
    assert client_fields({"layers": [{"paint": ["match", ["get", "k"], ["get", "j"]]}]}) == ["k", "j"]


def test_overlay(spark, tmp_path):
    log = str(tmp_path / "o.log")
    overlay.write_log(log, [(1, b"a"), (2, b"b"), (1, b"c")])
    with open(log, "ab") as f:
        f.write(b"\x07\x00\x00torn")
    records = list(overlay.read_log(log))
    assert records == [(1, 0, b"a"), (2, 1, b"b"), (1, 2, b"c")] and list(overlay.read_log(log)) == records
    path, base = str(tmp_path / "t"), str(tmp_path / "base")
    overlay.put(spark.createDataFrame(records, overlay.RECORD), path)
    assert {r.tile_id: bytes(r.blob) for r in overlay.current(spark, path).collect()} == {1: b"c", 2: b"b"}
    q = overlay.compact_stream(spark, path, base, str(tmp_path / "c"))
    q.awaitTermination()
    overlay.put(spark.createDataFrame([(2, 9, b"z"), (3, 10, b"y")], overlay.RECORD), path)
    q = overlay.compact_stream(spark, path, base, str(tmp_path / "c"))
    q.awaitTermination()
    tiles = lambda: {r.tile_id: bytes(r.blob) for r in overlay.base_tiles(spark, base).collect()}
    assert tiles() == {1: b"c", 2: b"z", 3: b"y"}
    # A late older record, a null blob, a new checkpoint that sees all records again, and merges: nothing is lost.
    overlay.put(spark.createDataFrame([(2, 5, b"old"), (3, 11, None), (4, 12, b"w")], overlay.RECORD), path)
    want = {1: b"c", 2: b"z", 3: b"y", 4: b"w"}
    for checkpoint, every in (("c", 8), ("new", 8), ("third", 1)):
        overlay.compact_stream(spark, path, base, str(tmp_path / checkpoint), merge_every=every).awaitTermination()
        assert tiles() == want
    owner = overlay.Owner(spark, base)
    assert owner.take() and not overlay.compact(spark, base)
    owner.release()
    assert overlay.compact(spark, base) and tiles() == want
    # A base that was there before, without sequence numbers, stays under new records.
    other = str(tmp_path / "other")
    spark.createDataFrame([(1, b"kept"), (9, b"nine")], "tile_id long, blob binary").write.parquet(other + "/v=7")
    overlay.compact_stream(spark, path, other, str(tmp_path / "o")).awaitTermination()
    assert {r.tile_id: bytes(r.blob) for r in overlay.base_tiles(spark, other).collect()} == {**want, 9: b"nine"}


def test_stream_of_invalidated_tiles(spark, tmp_path):
    spark.createDataFrame([("2020-01-01 00:00:01", 10.0, 10.0), ("2020-01-01 00:00:02", 10.0, 10.0)], "ts string, lon double, lat double").select(F.to_timestamp("ts").alias("ts"), "lon", "lat").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, lon double, lat double").parquet(str(tmp_path / "e"))
    out = overlay.invalidated_tiles(stream, lambda lon, lat: F.floor(lon).cast("long"))
    q = out.writeStream.format("memory").queryName("inv").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("inv").collect()] == [2]


def test_configuration():
    layers, own = config.load(json.dumps({"grids": [{"id": "g", "crs": "EPSG:3763", "extent": [0, 0, 512, 512], "resolutions": [2, 1]}], "layers": [{"name": "a", "vector": "x.gpkg", "grids": ["g", "WebMercatorQuad"]}]}))
    assert layers[0].name == "a" and own["g"].levels[1].width == 2
    with pytest.raises(ValueError):
        config.LayerConfig("b", raster="r.tif", vector="v.gpkg").check()
    with pytest.raises(ValueError):
        config.parse_dsn("postgis://u:secret@h/d?table=t")
    d = config.parse_dsn("postgis://u@h:5433/d?table=s.t&geom=g")
    assert d.port == 5433 and "password" not in repr(d)


def test_command_line(spark, tmp_path):
    from quadrille import cli

    path = tmp_path / "a.geojson"
    path.write_text(json.dumps(DOC))
    out = tmp_path / "a.png"
    assert cli.main(["map", str(path), "--bbox=-40,-40,40,40", "--size", "20,20", "--out", str(out)]) == 0 and out.read_bytes()[:4] == b"\x89PNG"
    assert cli.main(["tile", str(path), "0/0/0", "--out", str(out)]) == 0 and mvt.count_features(out.read_bytes()) == 3
    assert cli.main(["bake", str(path), "--zooms", "0-1", "--out", str(tmp_path / "a.pmtiles")]) == 0


def test_image_pyramid(spark, features, tmp_path):
    from quadrille.functions import png, pmtiles

    red = style.Style(((style.Rule(symbols=(style.Symbol("polygon", (255, 0, 0, 255)),)),),))
    path = str(tmp_path / "i.pmtiles")
    grid = grids.preset("WebMercatorQuad_64px")
    counts = tiles.bake_png(features, path, grid, range(3), "EPSG:4326", red)
    a = pmtiles.Archive(path)
    assert counts["addressed"] == 21 and a.kind == "png"  # blank tiles too
    whole = png.decode(a.get(0))
    assert whole[32, 27, 0] == 255 and whole[32, 27, 3] == 255 and whole[2, 2, 3] == 0 and whole[32, 32, 3] < 255


def jvm_jpeg(spark, pixels, kind):
    """Bytes of an image as the JVM writes it, and the samples that it reads back."""
    jvm = spark._jvm
    h, w = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            p = pixels[y, x]
            image.setRGB(x, y, (255 << 24 | int(p[0]) << 16 | int(p[1]) << 8 | int(p[2])) - (1 << 32))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    again = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    raster = again.getRaster()
    return data, np.array([raster.getSample(x, y, b) for y in range(h) for x in range(w) for b in range(raster.getNumBands())]).reshape(h, w, -1)


def test_jpeg_images(spark):
    from quadrille.functions import jpeg

    y, x = np.mgrid[0:37, 0:51]
    colour = np.stack([128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 11), 60 + 2 * x + y], axis=2).clip(0, 255).astype(int)
    data, want = jvm_jpeg(spark, colour, 1)
    got = jpeg.decode(data).astype(int)
    want = want if np.abs(got - want).mean() < np.abs(got - want[..., ::-1]).mean() else want[..., ::-1]  # the order of its bands
    assert got.shape == (37, 51, 3) and np.abs(got - want).mean() < 3 and np.abs(got - colour).mean() < 8
    grey = np.repeat(colour[..., :1], 3, axis=2)
    data, want = jvm_jpeg(spark, grey, 10)
    got = jpeg.decode(data)[..., 0].astype(int)
    assert got.shape == (37, 51) and np.abs(got - want[..., 0]).max() <= 1
    # Tables on their own, as TIFF files share them.
    head, tables, at = data[:2], b"", 2
    rest = b""
    while data[at + 1] != 0xDA:
        n = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        tables, rest = (tables + data[at : at + n], rest) if data[at + 1] in (0xDB, 0xC4) else (tables, rest + data[at : at + n])
        at += n
    assert (jpeg.decode(head + rest + data[at:], head + tables + b"\xff\xd9")[..., 0] == got).all()
    from quadrille.sources import raster

    level = raster.Level(51, 37, 64, 48, 1, 8, 1, 7, 1, (0,), (0,), head + tables + b"\xff\xd9")
    tile = raster.samples(head + rest + data[at:], level)
    assert tile.shape == (48, 64, 1) and (tile[:37, :51, 0] == got).all() and not tile[37:].any()
    with pytest.raises(ValueError):
        jpeg.decode(data.replace(b"\xff\xc0", b"\xff\xc2"))


def test_postgis_statements_and_features(spark, monkeypatch):
    """The statements that are sent, and features from their results; the server is stood in for."""
    asked = []

    def answer(_, dsn, sql, predicates=None):
        asked.append((sql, predicates))
        if "geometry_columns" in sql:
            return spark.createDataFrame([(3763,)] if "'roads'" in sql else [], "srid int")
        if "information_schema" in sql:
            return spark.createDataFrame([("id", "integer"), ("geom", "USER-DEFINED"), ("na\"me", "character varying"), ("width", "numeric"), ("open", "boolean")], "a string, b string")
        if "pg_index" in sql:
            return spark.createDataFrame([("id",)], "a string")
        if "min(" in sql:
            return spark.createDataFrame([(1, 20)], "low int, high int")
        return spark.createDataFrame([(7, b"w", 0.0, 1.0, 2.0, 3.0, 4.0, "A1", 7.5)], '__key int, __wkb binary, __minx double, __miny double, __maxx double, __maxy double, __area double, `na"me` string, width double')

    monkeypatch.setattr(vector, "_statement", answer)
    rows = vector.load(spark, "postgis://u@h/d?table=gis.roads", minx="0", miny="0", maxx="9", maxy="9", parts="2").collect()
    assert [(r.fid, r.ord, r.minx, r.area, {k: (v.n, v.s) for k, v in r.props.items()}) for r in rows] == [(7, 7, 0.0, 4.0, {'na"me': (None, "A1"), "width": (7.5, None), "open": (None, None)})]
    sql, ranges = asked[-1]
    assert ranges == ["__key >= 1 AND __key < 11", "__key >= 11 AND __key < 21"] and '"gis"."roads"' in sql and "ST_MakeEnvelope(0.0, 0.0, 9.0, 9.0" in sql and '"na""me"' in sql and '"open"' not in sql
    with pytest.raises(ValueError, match="no geometry column"):
        vector.load(spark, "postgis://u@h/d?table=none")


def test_windows_are_capped(spark, monkeypatch):
    rows = spark.range(50).selectExpr("id AS fid", "50 - id AS ord")
    few, seen = vector.capped(rows, 10)
    assert sorted(r.ord for r in few.collect()) == list(range(1, 11))
    with pytest.warns(UserWarning):
        assert vector.warn_if_capped(seen, 10)
    monkeypatch.setenv("QUADRILLE_MAX_FEATURES", "60")
    all_, seen = vector.capped(rows)
    assert len(all_.collect()) == 50 and not vector.warn_if_capped(seen)
    for bad in ("0", "-3", "x"):
        monkeypatch.setenv("QUADRILLE_MAX_FEATURES", bad)
        assert vector.most_features() == vector.CAP
