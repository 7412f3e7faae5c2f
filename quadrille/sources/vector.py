"""Vector sources as DataFrames of features.

A feature row has fid, wkb, props (attribute to struct of a number or a string; both null for null), its box,
area and ord, the place in its source. An unreadable source is an error; a window without features is an empty result.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as g
from ..functions import wkb
from .config import Dsn, parse_dsn

SCHEMA = "fid long, wkb binary, props map<string,struct<n:double,s:string>>, minx double, miny double, maxx double, maxy double, area double, ord long"
#: Most features of a windowed read; the cap is reported by readers that reach it.
CAP = 500_000


def value(v: object) -> dict:
    """An attribute: numbers become double, strings stay, anything else is null."""
    if isinstance(v, bool) or v is None:
        return {"n": None, "s": None}
    if isinstance(v, (int, float)):
        return {"n": float(v), "s": None}
    return {"n": None, "s": v} if isinstance(v, str) else {"n": None, "s": None}


def row(fid: int, geom: tuple, props: dict, ord: int) -> tuple:
    return (fid, wkb.encode(geom), props, *map(float, g.bbox(geom)), float(g.area(geom)), ord)


def geojson_geometry(doc: dict | None) -> tuple | None:
    """The geometry of a GeoJSON object; None for none. Kinds that aren't read are an error."""
    if doc is None:
        return None
    kind, c = doc.get("type"), doc.get("coordinates")
    pts = lambda ps: [(float(p[0]), float(p[1])) for p in ps]
    if kind == "Point":
        return kind, [[pts([c])]]
    if kind == "LineString":
        return kind, [[pts(c)]]
    if kind == "Polygon":
        return kind, [[pts(r) for r in c]]
    if kind == "MultiLineString":
        return kind, [[pts(line)] for line in c]
    if kind == "MultiPolygon":
        return kind, [[pts(r) for r in p] for p in c]
    if kind in ("MultiPoint", "GeometryCollection"):
        return None
    raise ValueError(f"unsupported geometry type {kind!r}")


def _geojson_rows(text: str) -> Iterator[tuple]:
    doc = json.loads(text)
    if doc.get("type") != "FeatureCollection":
        raise ValueError("not a FeatureCollection")
    for i, f in enumerate(doc["features"]):
        geom = geojson_geometry(f.get("geometry"))
        if geom is not None:
            props = f.get("properties") or {}
            ne = props.get("ne_id")
            yield row(int(ne) if isinstance(ne, (int, float)) and not isinstance(ne, bool) else i, geom, {k: value(v) for k, v in props.items()}, i)


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 9
    prop = pa.map_(pa.string(), pa.struct([("n", pa.float64()), ("s", pa.string())]))
    kinds = [pa.int64(), pa.binary(), prop, *[pa.float64()] * 5, pa.int64()]
    cols = [[list(p.items()) for p in c] if i == 2 else c for i, c in enumerate(cols)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["fid", "wkb", "props", "minx", "miny", "maxx", "maxy", "area", "ord"])


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollection files; each file is read as a whole by one task, as the format asks. No feature at all is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = list(_geojson_rows(data.decode("utf-8-sig")))
                if not rows:
                    raise ValueError("the collection has no features")
                for i in range(0, len(rows), 4096):
                    yield _batches(rows[i : i + 4096])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of newline-delimited GeoJSON: split among tasks; ord is a hash of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for line, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = json.loads(line.strip("\x1e \r")) if line and line.strip("\x1e \r") else {}
                geom = geojson_geometry(f.get("geometry"))
                if geom is not None:
                    rows.append(row(int(f["id"]) if str(f.get("id", "")).isdigit() else key, geom, {k: value(v) for k, v in (f.get("properties") or {}).items()}, key))
            yield _batches(rows)

    return spark.read.text(path).select("value", F.xxhash64("value").alias("k")).mapInArrow(run, SCHEMA)


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class GeoPackage(DataSource):
    """spark.read.format("geopackage"): options path, table, parts; and minx, miny, maxx, maxy for a windowed read by the R-tree."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _GeoPackageReader(self.options)


class _GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.parts = options["path"], int(options.get("parts", 8))
        window = [options.get(k) for k in ("minx", "miny", "maxx", "maxy")]
        self.window = [float(v) for v in window] if all(v is not None for v in window) else None
        with self.connect() as db:
            tables = db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features'").fetchall()
            self.table = options.get("table") or (tables[0][0] if tables else None)
            if self.table is None:
                raise ValueError("the file has no feature table")
            self.geom, self.srid = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", [self.table]).fetchone()
            info = db.execute(f'PRAGMA table_info("{self.table}")').fetchall()
            self.key = next((c[1] for c in info if c[5]), "rowid")
            self.columns = [c[1] for c in info if c[1] not in (self.geom, self.key)]
            self.index = f"rtree_{self.table}_{self.geom}"
            self.indexed = bool(db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", [self.index]).fetchone())
            self.span = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        low, high = self.span
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        names = ", ".join(f'f."{c}"' for c in [self.key, self.geom, *self.columns]) if self.key != "rowid" else ", ".join(["f.rowid", f'f."{self.geom}"', *[f'f."{c}"' for c in self.columns]])
        sql, args = f'SELECT {names}, f.rowid FROM "{self.table}" f', [part.low, part.high]
        if self.window and self.indexed:
            sql += f' JOIN "{self.index}" r ON r.id = f.rowid WHERE f.rowid BETWEEN ? AND ? AND r.maxx >= ? AND r.minx <= ? AND r.maxy >= ? AND r.miny <= ?'
            args += [self.window[0], self.window[2], self.window[1], self.window[3]]
        else:
            sql += " WHERE f.rowid BETWEEN ? AND ?"
        with self.connect() as db:
            for fid, blob, *rest in db.execute(sql + " ORDER BY f.rowid", args):
                try:
                    geom = wkb.decode_blob(blob) if blob else None
                except (ValueError, struct.error, IndexError):
                    geom = None  # a bad row is passed over; a failing read is not
                if geom is None:
                    continue
                out = row(fid, geom, {c: value(v) for c, v in zip(self.columns, rest)}, rest[-1])
                w = self.window
                if not w or (out[5] >= w[0] and out[3] <= w[2] and out[6] >= w[1] and out[4] <= w[3]):
                    yield out


def geopackage_crs(path: str, table: str | None = None) -> str | None:
    """EPSG name of a feature table's system, if its metadata has one."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = db.execute("SELECT s.organization, s.organization_coordsys_id FROM gpkg_geometry_columns g JOIN gpkg_spatial_ref_sys s USING (srs_id) WHERE ? IS NULL OR g.table_name = ?", [table, table]).fetchone()
    return f"EPSG:{found[1]}" if found and found[0].upper() == "EPSG" else None


class _Table:
    """A FlatBuffers table: its fields by number."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at
        self.vt = at - struct.unpack_from("<i", data, at)[0]
        self.n = (struct.unpack_from("<H", data, self.vt)[0] - 4) // 2

    def place(self, field: int) -> int:
        off = struct.unpack_from("<H", self.data, self.vt + 4 + 2 * field)[0] if field < self.n else 0
        return self.at + off if off else 0

    def scalar(self, field: int, kind: str, default=0):
        p = self.place(field)
        return struct.unpack_from("<" + kind, self.data, p)[0] if p else default

    def _target(self, field: int) -> int:
        p = self.place(field)
        return p + struct.unpack_from("<I", self.data, p)[0] if p else 0

    def vector(self, field: int, kind: str) -> tuple:
        p = self._target(field)
        return struct.unpack_from(f"<{struct.unpack_from('<I', self.data, p)[0]}{kind}", self.data, p + 4) if p else ()

    def raw(self, field: int) -> bytes:
        p = self._target(field)
        return self.data[p + 4 : p + 4 + struct.unpack_from("<I", self.data, p)[0]] if p else b""

    def text(self, field: int) -> str:
        return self.raw(field).decode()

    def table(self, field: int) -> _Table | None:
        p = self._target(field)
        return _Table(self.data, p) if p else None

    def tables(self, field: int) -> list[_Table]:
        p = self._target(field)
        if not p:
            return []
        n = struct.unpack_from("<I", self.data, p)[0]
        return [_Table(self.data, q + struct.unpack_from("<I", self.data, q)[0]) for q in range(p + 4, p + 4 + 4 * n, 4)]


#: Fixed values of FlatGeobuf: magic bytes, geometry codes, and struct codes of the column types (None: by length).
FGB_MAGIC = b"fgb\x03fgb"
FGB_KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 5: "MultiLineString", 6: "MultiPolygon"}
FGB_COLUMNS = ("b", "B", "?", "h", "H", "i", "I", "q", "Q", "f", "d", None, None, None, None)


class FlatGeobuf:
    """Header, index layout and features of a file."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            if f.read(8)[:7] != FGB_MAGIC:
                raise ValueError("not a FlatGeobuf file")
            size = struct.unpack("<I", f.read(4))[0]
            data = f.read(size)
        h = _Table(data, struct.unpack_from("<I", data, 0)[0])
        self.name, self.kind = h.text(0), h.scalar(2, "B")
        self.columns = [(c.text(0), c.scalar(1, "B")) for c in h.tables(7)]
        self.count, self.node = h.scalar(8, "Q"), h.scalar(9, "H", 16)
        crs = h.table(10)
        self.crs = f"EPSG:{crs.scalar(1, 'i')}" if crs and crs.scalar(1, "i") > 0 else None
        self.index_at = 12 + size
        self.levels = self._levels() if self.node >= 2 and self.count else []
        self.data_at = self.index_at + 40 * (sum(n for _, n in self.levels))

    def _levels(self) -> list[tuple[int, int]]:
        """First node and number of nodes of each level of the packed tree, leaves first."""
        counts = [self.count]
        while counts[-1] > 1:
            counts.append(-(-counts[-1] // self.node))
        out, end = [], sum(counts)
        for n in counts:
            out.append((end - n, n))
            end -= n
        return out

    def hits(self, window: tuple[float, float, float, float]) -> list[int]:
        """Offsets of features whose boxes overlap a window, from the root down."""
        found: list[int] = []
        with open(self.path, "rb") as f:
            todo = [(len(self.levels) - 1, 0)] if self.levels else []
            while todo:
                level, first = todo.pop()
                base, n = self.levels[level]
                f.seek(self.index_at + 40 * (base + first))
                data = f.read(40 * min(self.node if level < len(self.levels) - 1 else n, n - first))
                for x0, y0, x1, y1, offset in struct.iter_unpack("<4dQ", data):
                    if x1 >= window[0] and x0 <= window[2] and y1 >= window[1] and y0 <= window[3]:
                        if level == 0:
                            found.append(offset)
                        else:
                            todo.append((level - 1, offset - self.levels[level - 1][0] if offset >= self.levels[level - 1][0] else offset))
        return sorted(found)

    def leaf_offsets(self, first: int, after: int) -> list[int]:
        """Offsets of the features of a range of leaves."""
        with open(self.path, "rb") as f:
            f.seek(self.index_at + 40 * (self.levels[0][0] + first))
            return sorted(x[4] for x in struct.iter_unpack("<4dQ", f.read(40 * (after - first))))

    def geometry(self, t: _Table | None, kind: int) -> tuple | None:
        if t is None:
            return None
        kind = kind or t.scalar(6, "B")
        name = FGB_KINDS.get(kind)
        if name is None:
            return None
        if kind == 6:
            return name, [p[1][0] for p in (self.geometry(x, 3) for x in t.tables(7)) if p]
        flat, ends = t.vector(1, "d"), t.vector(0, "I")
        pts = list(zip(flat[::2], flat[1::2]))
        rings = [pts[a:b] for a, b in zip([0, *ends], ends)] if ends else [pts]
        return name, [[r] for r in rings] if kind == 5 else [rings]

    def feature(self, data: bytes, ord: int) -> tuple | None:
        t = _Table(data, struct.unpack_from("<I", data, 0)[0])
        geom = self.geometry(t.table(0), self.kind)
        if geom is None or not geom[1]:
            return None
        raw, at, props = t.raw(1), 0, {}
        columns = [(c.text(0), c.scalar(1, "B")) for c in t.tables(2)] or self.columns
        while at + 2 <= len(raw):
            name, kind = columns[struct.unpack_from("<H", raw, at)[0]]
            at += 2
            code = FGB_COLUMNS[kind]
            if code:
                v = float(struct.unpack_from("<" + code, raw, at)[0])
                at += struct.calcsize("<" + code)
            else:
                n = struct.unpack_from("<I", raw, at)[0]
                v = raw[at + 4 : at + 4 + n].decode() if kind != 14 else None
                at += 4 + n
            if v is not None:
                props[name] = value(v)
        return row(ord, geom, props, ord)

    def at(self, *offsets: int) -> Iterator[tuple | None]:
        """The features at ascending offsets."""
        with open(self.path, "rb") as f:
            for offset in offsets:
                f.seek(self.data_at + offset)
                yield self.feature(f.read(struct.unpack("<I", f.read(4))[0]), offset)

    def all(self) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(self.data_at)
            while len(n := f.read(4)) == 4:
                at = f.tell() - 4 - self.data_at
                data = f.read(struct.unpack("<I", n)[0])
                if len(data) < struct.unpack("<I", n)[0]:
                    raise OSError("the file ends inside a feature")
                if (r := self.feature(data, at)) is not None:
                    yield r


class FlatGeobufSource(DataSource):
    """spark.read.format("flatgeobuf"): option path, and minx, miny, maxx, maxy for a windowed read by the packed tree."""

    @classmethod
    def name(cls) -> str:
        return "flatgeobuf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FlatGeobufReader(self.options)


class _Offsets(InputPartition):
    def __init__(self, offsets: list[int] | None) -> None:
        self.offsets = offsets


class _FlatGeobufReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        window = [options.get(k) for k in ("minx", "miny", "maxx", "maxy")]
        self.window = tuple(float(v) for v in window) if all(v is not None for v in window) else None

    def partitions(self) -> list[InputPartition]:
        f = FlatGeobuf(self.path)
        if not f.levels:
            return [_Offsets(None)]
        if self.window is None:  # ranges of leaves; their offsets are read by the tasks
            return [_Range(i, min(i + 20_000, f.count)) for i in range(0, f.count, 20_000)]
        hits = f.hits(self.window)
        return [_Offsets(hits[i : i + 20_000]) for i in range(0, len(hits), 20_000)] or [_Offsets([])]

    def read(self, part: _Offsets | _Range) -> Iterator[tuple]:
        f = FlatGeobuf(self.path)
        w = self.window
        offsets = f.leaf_offsets(part.low, part.high) if isinstance(part, _Range) else part.offsets
        for r in f.all() if offsets is None else f.at(*offsets):
            if r is not None and (not w or (r[5] >= w[0] and r[3] <= w[2] and r[6] >= w[1] and r[4] <= w[3])):
                yield r


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    from .archive import PmtilesSource
    from .raster import GeoTiffSource

    for s in (GeoPackage, FlatGeobufSource, PmtilesSource, GeoTiffSource):
        spark.dataSource.register(s)


def most_features() -> int:
    """The cap of a windowed read: QUADRILLE_MAX_FEATURES where it is a whole number above zero, else CAP."""
    given = os.environ.get("QUADRILLE_MAX_FEATURES", "")
    return int(given) if given.isdigit() and int(given) > 0 else CAP


def capped(features: DataFrame, cap: int | None = None, order: str = "ord") -> tuple[DataFrame, Observation]:
    """At most `cap` features in their order, and what an action on them saw: the number n, which equals the cap where it was reached."""
    seen = Observation()
    return features.orderBy(order).limit(cap or most_features()).observe(seen, F.count(F.lit(1)).alias("n")), seen


def warn_if_capped(seen: Observation, cap: int | None = None) -> bool:
    """After an action: whether the cap was reached, with a warning."""
    full = seen.get["n"] >= (cap or most_features())
    if full:
        warnings.warn("the window holds as many features as a read may return; some may be missing", stacklevel=2)
    return full


#: The column types of PostGIS tables whose values are numbers and texts; others are null.
NUMBERS = frozenset("smallint integer bigint real numeric".split()) | {"double precision"}
TEXTS = frozenset("text name character uuid date".split()) | {"character varying"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def postgis_sql(table: str, geom: str, key: str, columns: dict[str, str], window: tuple | None = None, least_area: float = 0.0) -> str:
    """The statement of a feature table: key, geometry, box and area, numbers and texts as such; box and size gate in it."""
    g_ = _quoted(geom)
    where = [f"{g_} IS NOT NULL"]
    if window:
        where.append(f"{g_} && ST_MakeEnvelope({', '.join(repr(float(v)) for v in window)}, ST_SRID({g_}))")
    if least_area > 0:
        where.append(f"NOT (ST_Dimension({g_}) = 2 AND ST_Area({g_}) < {float(least_area)!r})")
    kept = [f"CAST({_quoted(c)} AS {'double precision' if kind in NUMBERS else 'text'}) AS {_quoted(c)}" for c, kind in columns.items() if kind in NUMBERS | TEXTS]
    box = ", ".join(f"ST_{f}({g_}) AS __{n}" for f, n in (("XMin", "minx"), ("YMin", "miny"), ("XMax", "maxx"), ("YMax", "maxy"), ("Area", "area")))
    return f"SELECT {', '.join([f'{_quoted(key)} AS __key', f'ST_AsBinary({g_}) AS __wkb', box, *kept])} FROM {'.'.join(map(_quoted, table.split('.')))} WHERE {' AND '.join(where)}"


def _statement(spark: SparkSession, dsn: Dsn, sql: str, predicates: list[str] | None = None) -> DataFrame:
    url, secret = dsn.jdbc()
    if predicates is None:
        return spark.read.format("jdbc").options(url=url, query=sql, **secret).load()
    return spark.read.jdbc(url, f"({sql}) t", predicates=predicates, properties=secret)


def postgis(spark: SparkSession, dsn: Dsn, window: tuple | None = None, least_area: float = 0.0, parts: int = 8, cap: int | None = None) -> DataFrame:
    """Features of a PostGIS table over JDBC (driver on the class path), in ranges of its key; a windowed read is capped.

    The table is checked first: it must have the geometry column with a system, and a whole-number primary key.
    """
    schema, _, name = dsn.table.rpartition(".")
    schema = schema or "public"
    found = _statement(spark, dsn, f"SELECT srid FROM geometry_columns WHERE f_table_schema = {_text(schema)} AND f_table_name = {_text(name)} AND f_geometry_column = {_text(dsn.geometry)}").collect()
    if not found or not found[0][0]:
        raise ValueError(f"{dsn!r} has no geometry column {dsn.geometry!r} with a system")
    columns = {r[0]: r[1] for r in _statement(spark, dsn, f"SELECT column_name, data_type FROM information_schema.columns WHERE table_schema = {_text(schema)} AND table_name = {_text(name)} ORDER BY ordinal_position").collect()}
    keys = [r[0] for r in _statement(spark, dsn, f"SELECT a.attname FROM pg_index i JOIN pg_attribute a ON a.attrelid = i.indrelid AND a.attnum = ANY(i.indkey) WHERE i.indisprimary AND i.indrelid = {_text(f'{_quoted(schema)}.{_quoted(name)}')}::regclass").collect()]
    if len(keys) != 1 or columns.get(keys[0]) not in ("smallint", "integer", "bigint"):
        raise ValueError(f"{dsn!r} needs a primary key of one whole-number column")
    key = keys[0]
    attributes = {c: kind for c, kind in columns.items() if c not in (key, dsn.geometry)}
    table = f"{schema}.{name}"
    low, high = _statement(spark, dsn, f"SELECT min({_quoted(key)}) AS low, max({_quoted(key)}) AS high FROM {'.'.join(map(_quoted, (schema, name)))}").first()
    step = max(1, -(-(high - low + 1) // parts)) if low is not None else 1
    ranges = [f"__key >= {a} AND __key < {a + step}" for a in range(low, high + 1, step)] if low is not None else ["1 = 0"]
    rows = _statement(spark, dsn, postgis_sql(table, dsn.geometry, key, attributes, window, least_area), ranges)
    one = lambda c, kind: F.struct((F.col(c).cast("double") if kind in NUMBERS else F.lit(None).cast("double")).alias("n"), (F.col(c) if kind in TEXTS else F.lit(None).cast("string")).alias("s"))
    pairs = [x for c, kind in attributes.items() for x in (F.lit(c), one(c, kind))]
    props = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,struct<n:double,s:string>>")
    out = rows.select(F.col("__key").cast("long").alias("fid"), F.col("__wkb").alias("wkb"), props.alias("props"), *[F.col(f"__{c}").cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy", "area")], F.col("__key").cast("long").alias("ord"))
    return capped(out, cap)[0] if window else out


#: What a path's ending or scheme means.
_ENDINGS = {".geojson": "geojson", ".json": "geojson", ".geojsonl": "geojson_lines", ".gpkg": "geopackage", ".fgb": "flatgeobuf", ".pmtiles": "pmtiles", ".tif": "geotiff", ".tiff": "geotiff", ".parquet": "parquet"}


def classify(uri: str) -> str:
    """The kind of a source by scheme or ending, whatever its case."""
    low = uri.lower().split("?")[0]
    if low.startswith(("postgres://", "postgresql://", "postgis://")):
        return "postgis"
    for end, kind in _ENDINGS.items():
        if low.endswith(end):
            return kind
    raise ValueError(f"can't tell what {uri.split('@')[-1]!r} is")


def load(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    """Features of a path by its kind; a windowed read (minx, miny, maxx, maxy) is capped, by `cap` or as most_features() says."""
    kind = classify(uri)
    if kind == "geojson":
        return geojson(spark, uri)
    if kind == "geojson_lines":
        return geojson_lines(spark, uri)
    if kind == "parquet":
        return spark.read.parquet(uri)
    names = ("minx", "miny", "maxx", "maxy")
    window = tuple(float(options[c]) for c in names) if all(c in options for c in names) else None
    cap = int(options.pop("cap")) if "cap" in options else None
    if kind == "postgis":
        return postgis(spark, parse_dsn(uri), window, float(options.get("least_area", 0.0)), int(options.get("parts", 8)), cap)
    register(spark)
    out = spark.read.format(kind).options(path=uri, **options).load()
    return capped(out, cap)[0] if window and kind in ("geopackage", "flatgeobuf") else out


def pruned(features: DataFrame, fields: list[str]) -> DataFrame:
    """Features with the named attributes only."""
    return features.withColumn("props", F.map_filter("props", lambda k, v: k.isin(*fields)))


def typed(features: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Features with attributes as columns: name to Number or String."""
    at = lambda f, kind: F.try_element_at("props", F.lit(f))["n" if kind == "Number" else "s"].alias(f)
    return features.select("fid", "wkb", "minx", "miny", "maxx", "maxy", "area", "ord", *[at(f, k) for f, k in fields.items()])
