"""Map images of vector frames: fills, strokes, markers, halos and label boxes on RGBA arrays."""

from __future__ import annotations

import numpy as np

from ..functions import geometry as g
from ..functions import style as st
from . import labels

#: Sub-rows and sub-columns of a pixel's coverage.
FINE = 4


def blend(image: np.ndarray, coverage: np.ndarray, colour: tuple, at: tuple[int, int] = (0, 0)) -> None:
    """Lay a colour over a part of a straight-alpha float image."""
    y, x = at
    view = image[y : y + coverage.shape[0], x : x + coverage.shape[1]]
    a = coverage[..., None] * (colour[3] / 255)
    out = a + view[..., 3:4] * (1 - a)
    safe = np.where(out == 0, 1, out)
    view[..., :3] = (np.array(colour[:3]) / 255 * a + view[..., :3] * view[..., 3:4] * (1 - a)) / safe
    view[..., 3:4] = out


def fill_coverage(rings: list, width: int, height: int) -> np.ndarray:
    """Even-odd coverage of rings, by crossings on fine scan lines."""
    out = np.zeros((height, width * FINE), np.float32)
    edges = [(a, b) for r in rings if len(r) > 2 for a, b in zip(r, [*r[1:], *r[:1]]) if a[1] != b[1]]
    if not edges:
        return np.zeros((height, width), np.float32)
    e = np.array(edges, float)
    y0, y1 = np.minimum(e[:, 0, 1], e[:, 1, 1]), np.maximum(e[:, 0, 1], e[:, 1, 1])
    centres = (np.arange(width * FINE) + 0.5) / FINE
    for row in range(max(0, int(y0.min())), min(height, int(y1.max()) + 1)):
        for k in range(FINE):
            y = row + (k + 0.5) / FINE
            on = (y0 <= y) & (y < y1)
            if on.any():
                p, q = e[on, 0], e[on, 1]
                xs = np.sort(p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]))
                out[row] += np.searchsorted(xs, centres, side="right") % 2
    return out.reshape(height, width, FINE).sum(axis=2) / FINE**2


def stroke_coverage(line: list, stroke: float, width: int, height: int) -> np.ndarray:
    """Coverage of a line with round caps and joins, from distances."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    d = np.full((height, width), np.inf)
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / n, 0, 1) if n else 0.0
        d = np.minimum(d, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return np.clip(stroke / 2 + 0.5 - d, 0, 1).astype(np.float32)


def disc_coverage(cx: float, cy: float, radius: float, width: int, height: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width] + 0.5
    return np.clip(radius + 0.5 - np.hypot(x - cx, y - cy), 0, 1).astype(np.float32)


def draw(features: list[tuple], style: st.Style, project, width: int, height: int, scale: float, with_labels: bool = True) -> np.ndarray:
    """RGBA bytes of (fid, geometry, props) features: geometry by feature type style, then markers, halos and labels."""
    image = np.zeros((height, width, 4))
    markers, texts = [], []
    shown = [(fid, geom, props, [[project(r) for r in part] for part in geom[1]]) for fid, geom, props in features]
    for rules in style.layers:
        for fid, geom, props, parts in shown:
            for n in st.chosen(rules, props, scale):
                for s in rules[n].symbols:
                    good = [p for p in parts if all(r is not None for r in p)]
                    if s.kind == "polygon" and g.polygons(geom):
                        rings = [r for p in good for r in p]
                        if s.fill:
                            blend(image, fill_coverage(rings, width, height), s.fill)
                        if s.stroke and rings:
                            blend(image, np.maximum.reduce([stroke_coverage([*r, r[0]], s.width, width, height) for r in rings]), s.stroke)
                    elif s.kind == "line" and s.stroke and geom[0] != "Point":
                        for p in good:
                            for r in p:
                                blend(image, stroke_coverage([*r, r[0]] if g.polygons(geom) else r, s.width, width, height), s.stroke)
                    elif s.kind in ("point", "text"):
                        at = g.centroid((geom[0], good)) if good else None
                        if at and s.kind == "point":
                            markers.append((at, s))
                        elif at:
                            key = s.priority if isinstance(s.priority, (int, float)) else props.get(s.priority) if s.priority else None
                            texts.append((float(key) if isinstance(key, (int, float)) else float("inf"), fid, at, s, st.label(s.label, props)))
    for (x, y), s in markers:
        if s.fill:
            blend(image, disc_coverage(x, y, s.size / 2, width, height), s.fill)
        if s.stroke:
            ring = disc_coverage(x, y, s.size / 2 + s.width / 2, width, height) - disc_coverage(x, y, s.size / 2 - s.width / 2, width, height)
            blend(image, np.clip(ring, 0, 1), s.stroke)
    if with_labels and texts:
        boxes = [labels.text_box(t[4], t[3].font_size) for t in texts]
        spots = labels.placed([(t[0], t[1], *t[2], 0.0, t[3].offset, *b) for t, b in zip(texts, boxes)])
        for layer in ("halo", "body"):
            for i, x, y in spots:
                s, (w, h) = texts[i][3], boxes[i]
                r = s.halo_radius if layer == "halo" else 0
                colour = s.halo if layer == "halo" else s.fill or (0, 0, 0, 255)
                if colour and (layer == "body" or r > 0):
                    blend(image, fill_coverage([[(x - r, y + h / 3 - r), (x + w + r, y + h / 3 - r), (x + w + r, y + 2 * h / 3 + r), (x - r, y + 2 * h / 3 + r)]], width, height), colour)
    return np.floor(image * 255 + 0.5).astype(np.uint8)
