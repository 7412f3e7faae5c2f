"""Plane geometry kernels on lists of points; geometries are (kind, parts).

kind is one of KINDS; parts is a list of polygons (or lines, or single points), each a list of rings (or the one
line or point), each a list of (x, y): so Point and LineString nest like the others.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

KINDS = ("Point", "LineString", "Polygon", "MultiLineString", "MultiPolygon")
GEOMETRY = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"


def polygons(geom: tuple) -> list:
    return geom[1] if geom[0] in ("Polygon", "MultiPolygon") else []


def bbox(geom: tuple) -> tuple[float, float, float, float]:
    """minx, miny, maxx, maxy; an inverted infinite box for no points."""
    pts = [p for part in geom[1] for ring in part for p in ring]
    if not pts:
        return math.inf, math.inf, -math.inf, -math.inf
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return min(xs), min(ys), max(xs), max(ys)


def ring_area2(ring: list) -> float:
    """Twice the signed area of a ring, closed or not (exact for whole numbers)."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]]))


def area(geom: tuple) -> float:
    """Exteriors less holes, never negative; 0 for points and lines."""
    return sum(max(0.0, abs(ring_area2(p[0])) / 2 - sum(abs(ring_area2(h)) / 2 for h in p[1:])) for p in polygons(geom) if p)


def in_ring(x: float, y: float, ring: list) -> bool:
    """Even-odd containment with half-open edges."""
    inside = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def contains(geom: tuple, x: float, y: float) -> bool:
    """Whether a polygon holds a point outside its holes."""
    return any(p and in_ring(x, y, p[0]) and not any(in_ring(x, y, h) for h in p[1:]) for p in polygons(geom))


def centroid(geom: tuple) -> tuple[float, float] | None:
    """Label point: the point itself, the middle vertex of the longest line, or the area centroid of the part with most vertices."""
    kind, parts = geom
    if not parts or not parts[0] or not parts[0][0]:
        return None
    if kind == "Point":
        return tuple(parts[0][0][0])
    part = max(parts, key=lambda p: len(p[0]))
    ring = part[0]
    if kind in ("LineString", "MultiLineString"):
        return tuple(ring[len(ring) // 2])
    a = sx = sy = 0.0
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]]):
        c = ax * by - bx * ay
        a, sx, sy = a + c, sx + (ax + bx) * c, sy + (ay + by) * c
    if abs(a) > 1e-12:
        return sx / (3 * a), sy / (3 * a)
    return sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)


def clip_ring(ring: list, rect: tuple) -> list:
    """A ring cut by a box, one border after another."""
    for axis, bound, sign in ((0, rect[0], 1), (0, rect[2], -1), (1, rect[1], 1), (1, rect[3], -1)):
        out: list = []
        for a, b in zip([*ring[-1:], *ring[:-1]], ring):
            ins_a, ins_b = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ins_a != ins_b:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cut[axis] = bound
                out.append(tuple(cut))
            if ins_b:
                out.append(tuple(b))
        ring = out
        if not ring:
            break
    return ring


def clip_polygon(rings: list, rect: tuple) -> list:
    """A polygon cut by a box; nothing if its exterior vanishes."""
    open_rings = [r[:-1] if len(r) > 1 and tuple(r[0]) == tuple(r[-1]) else r for r in rings]
    cut = [clip_ring(r, rect) for r in open_rings]
    return [r for r in cut if len(r) >= 3] if cut and len(cut[0]) >= 3 else []


def clip_line(line: list, rect: tuple) -> list:
    """The pieces of a line inside a box."""
    pieces: list = []
    for a, b in zip(line, line[1:]):
        lo, hi, dx, dy = 0.0, 1.0, b[0] - a[0], b[1] - a[1]
        for p, q in ((-dx, a[0] - rect[0]), (dx, rect[2] - a[0]), (-dy, a[1] - rect[1]), (dy, rect[3] - a[1])):
            if p == 0:
                if q < 0:
                    lo = 2.0
            elif p < 0:
                lo = max(lo, q / p)
            else:
                hi = min(hi, q / p)
        if lo > hi:
            continue
        s, e = (a[0] + lo * dx, a[1] + lo * dy), (a[0] + hi * dx, a[1] + hi * dy)
        if pieces and lo == 0.0 and pieces[-1][-1] == s:
            pieces[-1].append(e)
        else:
            pieces.append([s, e])
    return [p for p in pieces if len(p) > 1 and any(q != p[0] for q in p)]


def snap(x: float, tolerance: float) -> int:
    """Grid number of a coordinate, half away from zero."""
    v = x / tolerance
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def snap_ring(ring: list, tolerance: float) -> list | None:
    """An open ring on the grid without repeats; None if fewer than three points or no area are left."""
    out: list = []
    for p in ring:
        q = (snap(p[0], tolerance), snap(p[1], tolerance))
        if not out or out[-1] != q:
            out.append(q)
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out if len(out) >= 3 and ring_area2(out) != 0 else None


def crosses_itself(line: list) -> bool:
    """Whether two segments of a line that share no end cross properly."""
    turn = lambda a, b, c: (v := (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]), (v > 0) - (v < 0))[1]
    segs = list(zip(line, line[1:]))
    boxes = [(min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])) for a, b in segs]
    order = sorted(range(len(segs)), key=lambda i: boxes[i][0])
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if boxes[j][0] > boxes[i][2]:
                break
            if abs(i - j) <= 1 or boxes[j][1] > boxes[i][3] or boxes[j][3] < boxes[i][1]:
                continue
            (a, b), (c, d) = segs[i], segs[j]
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return True
    return False


#: Fixed value: how far straight runs weigh less than corners in line simplification.
STRAIGHT = 0.7


def corner_weight(a: tuple, b: tuple, c: tuple) -> float:
    """Area of the triangle at b, less where the line runs straight on."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    size = math.hypot(ux, uy) * math.hypot(vx, vy)
    cos = max(-1.0, min(1.0, (ux * vx + uy * vy) / size)) if size else 1.0
    return abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2 * (1 - STRAIGHT * cos)


def simplify(line: list, least: float) -> list:
    """Drop inner points of least weight until all that are left weigh `least`; ends stay, ties go by coordinates."""
    if len(line) <= 2 or not least > 0:
        return list(line)
    left, right = {i: i - 1 for i in range(1, len(line) - 1)}, {i: i + 1 for i in range(1, len(line) - 1)}
    weigh = lambda i: corner_weight(line[left[i]], line[i], line[right[i]])
    weights = {i: weigh(i) for i in left}  # of the inner points that are left
    queue = [(w, line[i], i) for i, w in weights.items()]
    heapq.heapify(queue)
    while queue and queue[0][0] < least:
        w, _, i = heapq.heappop(queue)
        if weights.get(i) != w:  # dropped, or weighed anew since
            continue
        del weights[i]
        a, b = left[i], right[i]
        for j, side, neighbour in ((a, right, b), (b, left, a)):
            if j in weights:
                side[j] = neighbour
                weights[j] = weigh(j)
                heapq.heappush(queue, (weights[j], line[j], j))
    return [line[0], *(line[i] for i in sorted(weights)), line[-1]]


def simplify_guarded(line: list, least: float) -> list:
    """simplify, unless the result crosses itself."""
    out = simplify(line, least)
    return list(line) if len(out) < len(line) and crosses_itself(out) else out


def oriented(rings: list) -> list:
    """Exterior with positive area, holes with negative."""
    return [r if (ring_area2(r) > 0) == (i == 0) else r[::-1] for i, r in enumerate(rings)]


def boundary_edges(rings: list) -> list:
    """Directed edges of oriented rings."""
    return [e for r in rings for e in zip(r, [*r[1:], *r[:1]]) if e[0] != e[1]]


def cancelled(edges: list) -> dict:
    """Edges that are left when each meets its opposite, with their numbers."""
    net: dict = defaultdict(int)
    for a, b in edges:
        if a < b:
            net[a, b] += 1
        else:
            net[b, a] -= 1
    return {(e if n > 0 else e[::-1]): abs(n) for e, n in net.items() if n}


def _angle(a: tuple, b: tuple) -> tuple:
    """Exact order of directions around a point, counter-clockwise from the positive x axis."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    half = 0 if dy > 0 or (dy == 0 and dx > 0) else 1
    return half, dx, dy


def walk(edges: dict) -> list:
    """Rings along directed edges: from the least edge on, at every vertex the rightmost turn."""
    from functools import cmp_to_key

    left: dict = defaultdict(dict)
    for (a, b), n in edges.items():
        left[a][b] = n
    compare = cmp_to_key(lambda p, q: (p[0] > q[0]) - (p[0] < q[0]) or -((c := p[1] * q[2] - p[2] * q[1]) > 0) or (c < 0))
    rings = []
    for start in sorted(left):
        while left[start]:
            ring, a, b = [], start, min(left[start])
            while True:
                ring.append(a)
                left[a][b] -= 1
                if not left[a][b]:
                    del left[a][b]
                if b == start:
                    break
                outs = sorted(left[b], key=lambda c: compare(_angle(b, c)))
                if not outs:
                    ring = []
                    break
                back = compare(_angle(b, a))
                later = [c for c in outs if compare(_angle(b, c)) > back]
                a, b = b, (later or outs)[0]
            if ring:
                rings.append(ring)
    return rings


def straightened(ring: list) -> list:
    """A ring without points on straight runs."""
    out = [b for a, b, c in zip([*ring[-1:], *ring[:-1]], ring, [*ring[1:], *ring[:1]]) if (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])]
    return out if len(out) >= 3 else []


def inner_point(ring: list) -> tuple[float, float]:
    """A point inside a ring of whole numbers, at half-odd height."""
    ys = sorted({p[1] for p in ring})
    y = ys[0] + 0.5
    xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, [*ring[1:], *ring[:1]]) if (a[1] > y) != (b[1] > y))
    return (xs[0] + xs[1]) / 2, y


def nested(rings: list) -> list:
    """Polygons from rings: each hole goes to the smallest exterior around it."""
    outer = sorted((r for r in rings if ring_area2(r) > 0), key=lambda r: (min(r), ring_area2(r)))
    polys = [[r] for r in outer]
    for h in sorted((r for r in rings if ring_area2(r) < 0), key=min):
        x, y = inner_point(h)
        around = [i for i, r in enumerate(outer) if in_ring(x, y, r)]
        if around:
            polys[min(around, key=lambda i: ring_area2(outer[i]))].append(h)
    return polys


def dissolved(polys: list) -> list:
    """Polygons of the union of grid polygons that meet along whole edges."""
    edges = [e for p in polys for e in boundary_edges(oriented(p))]
    return nested([s for r in walk(cancelled(edges)) if (s := straightened(r))])
