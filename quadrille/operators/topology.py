"""Coverages as shared arcs: snap, junctions, arcs, simplification and levels of detail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import grids, wkb
from . import aggregates

POINTS = "array<struct<x:long,y:long>>"


def checked_tolerance(tolerance: float) -> float:
    """A tolerance above zero and finite."""
    if not 0 < tolerance < float("inf"):
        raise ValueError("the tolerance must be above zero and finite")
    return tolerance


def _list(points: list) -> list[dict]:
    return [{"x": p[0], "y": p[1]} for p in points]


def _column(lines: list[list[tuple]]) -> pa.Array:
    """A column of point lists, without an object for each point."""
    flat = np.array([p for line in lines for p in line], np.int64).reshape(-1, 2)
    ends = np.cumsum([0, *map(len, lines)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"]))


def _lines(column: pa.Array) -> list[list[tuple]]:
    """The point lists of a column without nulls; more fields than x and y come behind them in a point."""
    flat = column.flatten()
    points = list(zip(*(f.to_pylist() for f in flat.flatten()), strict=True))
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
    return [points[a:b] for a, b in zip(ends, ends[1:])]


def snapped_rings(features: DataFrame, tolerance: float) -> DataFrame:
    """Oriented open rings on the tolerance's grid: fid, part, ring, pts. Rings that vanish are left out, with their holes if it is the exterior."""
    checked_tolerance(tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for fid, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, part in enumerate(g.polygons(wkb.decode(data) or ("Point", []))):
                    rings = [g.snap_ring(r, tolerance) for r in part]
                    if rings and rings[0]:
                        out += [(fid, k, i, r) for i, r in enumerate(g.oriented([r for r in rings if r]))]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(cols[:3], (pa.int64(), pa.int32(), pa.int32()))), _column(cols[3])], names=["fid", "part", "ring", "pts"])

    return aggregates.dealt(features.select("fid", "wkb"), "fid").mapInArrow(run, f"fid long, part int, ring int, pts {POINTS}")


def arcs_of(ring: list[tuple], marked: list[bool]) -> list[tuple[list[tuple], bool]]:
    """Arcs of an open ring between its junctions, each in its canonical direction and whether that is reversed.

    A ring without junctions is one arc from its least vertex round to it again.
    """
    n = len(ring)
    starts = [i for i in range(n) if marked[i]]
    if not starts:
        k = ring.index(min(ring))
        starts = [k]
    out = []
    for a, b in zip(starts, [*starts[1:], starts[0] + n]):
        arc = [ring[i % n] for i in range(a, b + 1)]
        back = arc[::-1]
        out.append((back, True) if back < arc else (arc, False))
    return out


def ring_refs(rings: DataFrame) -> DataFrame:
    """fid, part, ring, seq, reversed, pts (canonical arc), arc_id (a hash of the points) for every piece of every ring.

    Vertices meet at their place with their neighbours, where two different pairs make a junction; the rings are read once,
    and only one ring's vertices are gathered again at a time.
    """
    v = rings.select("fid", "part", "ring", F.posexplode(aggregates.with_neighbours("pts")).alias("pos", "t"))
    v = v.select("fid", "part", "ring", "pos", F.col("t.p.x").alias("x"), F.col("t.p.y").alias("y"), F.struct("t.l", "t.r").alias("n"))
    at = Window.partitionBy("x", "y")
    v = v.select("fid", "part", "ring", "pos", "x", "y", (F.min("n").over(at) != F.max("n").over(at)).alias("j"))
    whole = v.groupBy("fid", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "j"))).alias("v"))
    whole = whole.select("fid", "part", "ring", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["j"].alias("j"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for fid, part, ring, vs in zip(*(b.column(i).to_pylist() for i in range(3)), _lines(b.column(3))):
                for seq, (arc, turned) in enumerate(arcs_of([p[:2] for p in vs], [p[2] for p in vs])):
                    out.append((fid, part, ring, seq, turned, arc))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(cols[:5], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))), _column(cols[5])], names=["fid", "part", "ring", "seq", "reversed", "pts"])

    refs = whole.mapInArrow(run, f"fid long, part int, ring int, seq int, reversed boolean, pts {POINTS}")
    return refs.withColumn("arc_id", F.sha2(F.to_json("pts"), 256))


def arcs(refs: DataFrame) -> DataFrame:
    """Distinct arcs: arc_id, pts, degree (how many ring pieces share it)."""
    return refs.groupBy("arc_id").agg(F.first("pts").alias("pts"), F.count(F.lit(1)).alias("degree"))


def report(refs: DataFrame, pool: DataFrame) -> DataFrame:
    """One row of counts: ring pieces and their points, arcs and theirs, shared arcs and theirs, and the most rings that share one."""
    rows = refs.select(F.lit(0).cast("long").alias("degree"), F.size("pts").alias("n")).union(pool.select("degree", F.size("pts").alias("n")))
    piece, arc, shared = F.col("degree") == 0, F.col("degree") > 0, F.col("degree") > 1
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.agg(F.count_if(piece).alias("pieces"), total(piece).alias("piece_points"), F.count_if(arc).alias("arcs"), total(arc).alias("arc_points"), F.count_if(shared).alias("shared"), total(shared).alias("shared_points"), F.max("degree").alias("most"))


def simplified(pool: DataFrame, least: float | DataFrame) -> DataFrame:
    """Arcs with points of little weight dropped; an arc that would cross itself stays as it is.

    least: the weight in square grid units, or a column of that name in pool (then one arc may come at several levels).
    """
    rows = pool.withColumn("least", F.lit(float(least))) if isinstance(least, (int, float)) else pool
    keep = [c for c in rows.columns if c not in ("pts", "least")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c, b=b: b.column(b.schema.get_field_index(c))
            pts = [g.simplify_guarded(p, w) for p, w in zip(_lines(col("pts")), col("least").to_pylist())]
            yield pa.RecordBatch.from_arrays([*map(col, keep), _column(pts)], names=[*keep, "pts"])

    schema = rows.select(*keep).schema.add("pts", rows.schema["pts"].dataType)
    return rows.mapInArrow(run, schema)


def rebuilt(refs: DataFrame, pool: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rings from their pieces: by..., fid, part, ring, pts (open). Rings of fewer than three points vanish."""
    by = by or []
    pieces = refs.drop("pts").join(pool.select(*by, "arc_id", "pts"), "arc_id")
    turned = F.when(F.col("reversed"), F.reverse("pts")).otherwise(F.col("pts"))
    open_end = F.slice(turned, F.lit(1), F.size("pts") - 1)
    rings = pieces.withColumn("o", open_end).groupBy(*by, "fid", "part", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "o"))), lambda s: s["o"])).alias("pts"))
    return rings.filter(F.size("pts") >= 3)


def mismatches(rings: DataFrame, again: DataFrame) -> DataFrame:
    """Rings that the round trip through arcs changes, but for where they begin."""

    def turned(c: str):
        at = F.array_position(c, F.array_min(c)).cast("int")
        return F.concat(F.slice(c, at, F.size(c) - at + 1), F.slice(c, F.lit(1), at - 1))

    a = rings.select("fid", "part", "ring", turned("pts").alias("a"))
    return a.join(again.select("fid", "part", "ring", turned("pts").alias("b")), ["fid", "part", "ring"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def ring_area2(points: str):
    """Twice the signed area of rings, by a fold over whole numbers."""
    n = F.size(points)
    at = lambda i: F.get(F.col(points), i)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda s, i: s + at(i)["x"] * at((i + 1) % n)["y"] - at((i + 1) % n)["x"] * at(i)["y"])


def culled(rings: DataFrame, least_area: str | float, by: list[str] | None = None) -> DataFrame:
    """Rings but those of parts whose exterior is smaller than the least area, in square grid units."""
    by = by or []
    least = F.col(least_area) if isinstance(least_area, str) else F.lit(float(least_area))
    sized = rings.withColumn("a", F.abs(ring_area2("pts")) / 2)
    keep = sized.filter((F.col("ring") == 0) & (F.col("a") >= least)).select(*by, "fid", "part")
    return sized.filter(F.col("a") > 0).join(keep, [*by, "fid", "part"], "left_semi").drop("a")


def part_levels(pieces: list[tuple], gates: list[tuple[int, float]]) -> list[tuple[int, int, list]]:
    """(z, ring, points) of a part at every level (z, least), from its pieces (ring, seq, reversed, arc) in order."""
    out: list[tuple[int, int, list]] = []
    for z, least in gates:
        rings: dict[int, list] = {}
        for ring, _, turned, arc in pieces:
            line = g.simplify_guarded(arc, least) if len(arc) > 2 else arc
            rings.setdefault(ring, []).extend((line[::-1] if turned else line)[:-1])
        sizes = {k: abs(g.ring_area2(r)) / 2 for k, r in rings.items() if len(r) >= 3}
        if sizes.get(0, -1.0) >= least:
            out += [(z, k, rings[k]) for k, a in sizes.items() if a > 0]
    return out


def levels_of_detail(refs: DataFrame, tolerance: float, scale: float, zooms: range = range(23), pixels: float = 1.0) -> DataFrame:
    """Rings of every zoom: z, fid, part, ring, pts; arcs simplified by the zoom's square pixel, small parts culled; the last zoom is uncut.

    An arc has the same points in every ring that refers to it, so each part simplifies its own pieces and neighbours still
    agree: a part's pieces meet once for all zooms, and neither arcs nor levels are joined. A written result can be
    partitioned by z and read one level at a time.
    """
    unit = tolerance * tolerance
    gates = [(z, 0.0 if z == max(zooms) else grids.gate_for_zoom(z, scale, pixels) / unit) for z in zooms]
    parts = refs.groupBy("fid", "part").agg(F.array_sort(F.collect_list(F.struct("ring", "seq", "reversed", "pts"))).alias("v"))
    parts = parts.select("fid", "part", *[F.col("v")[c].alias(c) for c in ("ring", "seq", "reversed", "pts")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = iter(_lines(b.column(5).flatten()))
            out: list[tuple] = []
            for fid, part, *own in zip(*(b.column(i).to_pylist() for i in range(5))):
                pieces = [(*piece, next(lines)) for piece in zip(*own, strict=True)]
                out += [(z, fid, part, ring, pts) for z, ring, pts in part_levels(pieces, gates)]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(cols[:4], (pa.int32(), pa.int64(), pa.int32(), pa.int32()))), _column(cols[4])], names=["z", "fid", "part", "ring", "pts"])

    return parts.mapInArrow(run, f"z int, fid long, part int, ring int, pts {POINTS}")


def dissolved_edges(rings: DataFrame, by: list[str]) -> DataFrame:
    """Boundary edges of each class when neighbours of one class are merged."""
    from .joins import cancel_edges

    return cancel_edges(aggregates.ring_edges(rings, "pts", *by), by)


def dissolved(rings: DataFrame, by: str) -> DataFrame:
    """Polygons of each class: by, polygon, ring, pts. Rows of rings have `by` and pts.

    Edges meet their opposites in a partial aggregation; what is left, the outer boundary of a class, is walked by class.
    """

    def run(pdf):
        edges = {((a, b), (c, d)): int(n) for a, b, c, d, n in zip(pdf.ax, pdf.ay, pdf.bx, pdf.by_, pdf.n)}
        polys = g.nested([s for r in g.walk(edges) if (s := g.straightened(r))])
        rows = [(pdf[by].iloc[0], i, k, _list(r)) for i, p in enumerate(polys) for k, r in enumerate(p)]
        return pd.DataFrame(rows, columns=[by, "polygon", "ring", "pts"])

    edges = dissolved_edges(rings.filter(F.col(by).isNotNull()), [by])
    kind = rings.schema[by].dataType.simpleString()
    return edges.groupBy(by).applyInPandas(run, f"{by} {kind}, polygon int, ring int, pts {POINTS}")
