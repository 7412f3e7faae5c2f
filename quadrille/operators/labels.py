"""Greedy label placement, frame by frame."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.style import half_away

#: Fixed value: side of the cells that obstacles are kept in.
CELL = 64.0
#: How many boxes are tried around an anchor; the least size and the largest coordinates for which a rounded box surely has an area.
SPOTS, SOLID, FAR = 8, 2.0, 2.0**40


def text_box(text: str, size: float) -> tuple[float, float]:
    """Width and height of a text by average glyph metrics (there is no font library)."""
    return 0.6 * size * len(text), 1.2 * size


class Obstacles:
    """Boxes that are taken, found by uniform cells; touching is free. Equal boxes are one, and a box that was hit stays hit."""

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], list[tuple]] = {}
        self.known: set[tuple] = set()
        self.blocked: set[tuple] = set()

    def _keys(self, b: tuple) -> list[tuple[int, int]]:
        return [(i, j) for i in range(math.floor(b[0] / CELL), math.floor(b[2] / CELL) + 1) for j in range(math.floor(b[1] / CELL), math.floor(b[3] / CELL) + 1)]

    def add(self, b: tuple) -> None:
        if b not in self.known:
            self.known.add(b)
            for k in self._keys(b):
                self.cells.setdefault(k, []).append(b)

    def hit(self, b: tuple) -> bool:
        if b in self.blocked:
            return True
        found = any(o[0] < b[2] and b[0] < o[2] and o[1] < b[3] and b[1] < o[3] for k in self._keys(b) for o in self.cells.get(k, ()))
        if found:
            self.blocked.add(b)
        return found


def candidates(x: float, y: float, radius: float, w: float, h: float, offset: float) -> list[tuple]:
    """Boxes to try around an anchor: east, north-east, south-east, north-west, south-west, west, north, south."""
    gap = radius + offset
    right, left, mid_x = x + gap, x - gap - w, x - w / 2
    above, below, mid_y = y - gap - h, y + gap, y - h / 2
    spots = [(right, mid_y), (right, above), (right, below), (left, above), (left, below), (left, mid_y), (mid_x, above), (mid_x, below)]
    return [(half_away(a), half_away(b), half_away(a + w), half_away(b + h)) for a, b in spots]


def placed(items: list[tuple]) -> list[tuple[int, int, int]]:
    """(item, x, y) of the labels that find room; items are (priority, fid, x, y, radius, offset, width, height).

    All markers are obstacles from the start; labels go by priority (NaN last), then id.
    """
    taken = Obstacles()
    for _, _, x, y, r, *_ in items:
        taken.add((half_away(x - r), half_away(y - r), half_away(x + r), half_away(y + r)))
    out = []
    for i in sorted(range(len(items)), key=lambda i: (items[i][0] != items[i][0], *items[i][:2])):
        _, _, x, y, r, offset, w, h = items[i]
        if w <= 0:
            continue
        for b in candidates(x, y, r, w, h, offset):
            if not taken.hit(b):
                taken.add(b)
                out.append((i, b[0], b[1]))
                break
    return out


def contenders(items: DataFrame) -> DataFrame:
    """Items that can be placed or block others: of those that agree in anchor and sizes, the first by priority and id, one for each spot.

    They try the same boxes in the same order, and one that is placed takes its box from the next, so no more of them find
    room; their markers are one obstacle. Items whose boxes may round to nothing, which block nothing, all stay.
    """
    alike = ["frame", "x", "y", "radius", "offset", "width", "height"]
    rank = F.row_number().over(Window.partitionBy(*alike).orderBy(F.coalesce(F.col("priority").cast("double"), F.lit(math.nan)), "fid"))
    solid = (F.col("width") >= SOLID) & (F.col("height") >= SOLID)
    for c in alike[1:]:
        solid &= F.abs(c) < FAR
    return items.withColumn("__r", rank).filter(~F.coalesce(solid, F.lit(False)) | (F.col("__r") <= SPOTS)).drop("__r")


def place(items: DataFrame) -> DataFrame:
    """frame, fid, lx, ly of placed labels from rows frame, fid, priority, x, y, radius, offset, width, height."""

    def run(pdf):
        rows = list(zip(pdf.priority, pdf.fid, pdf.x, pdf.y, pdf.radius, pdf.offset, pdf.width, pdf.height))
        return pd.DataFrame([(pdf.frame.iloc[i], pdf.fid.iloc[i], a, b) for i, a, b in placed(rows)], columns=["frame", "fid", "lx", "ly"])

    kind = items.schema["frame"].dataType.simpleString()
    return contenders(items).groupBy("frame").applyInPandas(run, f"frame {kind}, fid long, lx long, ly long")
