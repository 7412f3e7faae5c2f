"""Raster operators over tables of pixels (col, row, bands) and of encoded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bandmath, style


def request_pixels(spark, box: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """The pixels of a map request with the place of their centres: (i, j, x, y)."""
    dx, dy = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    n = spark.range(width * height)
    i, j = F.col("id") % width, F.floor(F.col("id") / width)
    return n.select(i.alias("i"), j.alias("j"), (F.lit(box[0]) + (i + 0.5) * F.lit(dx)).alias("x"), (F.lit(box[3]) - (j + 0.5) * F.lit(dy)).alias("y"))


def source_pixels(targets: DataFrame, origin: tuple[float, float], pixel: tuple[float, float]) -> DataFrame:
    """u, v: fractional source pixels of the places x, y."""
    return targets.withColumn("u", (F.col("x") - F.lit(float(origin[0]))) / F.lit(float(pixel[0]))).withColumn("v", (F.lit(float(origin[1])) - F.col("y")) / F.lit(float(pixel[1])))


def chunk_of(col: Column, row: Column, tile_w: int, tile_h: int) -> list[Column]:
    """The chunk that holds a source pixel."""
    return [F.floor(col / tile_w).cast("long").alias("grid_col"), F.floor(row / tile_h).cast("long").alias("grid_row")]


def warp_nearest(targets: DataFrame, pixels: DataFrame, keep: list[str]) -> DataFrame:
    """Each target (i, j, u, v) with the bands of the source pixel that it falls in; null where there is none."""
    t = targets.withColumn("col", F.floor("u").cast("long")).withColumn("row", F.floor("v").cast("long"))
    return t.join(pixels.select("col", "row", *keep), ["col", "row"], "left").select("i", "j", *keep)


def warp_bilinear(targets: DataFrame, pixels: DataFrame, band: str, scale: float = 1.0, size: tuple[int, int] | None = None) -> DataFrame:
    """Tent-weighted mean of the source pixels around each target; the tent's radius is max(1, source pixels a target pixel).

    Taps beyond the raster's edges are held at it where size is given. Weights are those of whole taps that exist.
    """
    r = max(1.0, float(scale))
    lo = lambda c: F.ceil(F.col(c) - 0.5 - F.lit(r)).cast("long")
    hi = lambda c: F.floor(F.col(c) - 0.5 + F.lit(r)).cast("long")
    taps = targets.withColumn("tc", F.explode(F.sequence(lo("u"), hi("u")))).withColumn("tr", F.explode(F.sequence(lo("v"), hi("v"))))
    weight = lambda c, t: F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col(t) + 0.5 - F.col(c)) / F.lit(r))
    taps = taps.withColumn("w", weight("u", "tc") * weight("v", "tr")).filter("w > 0")
    hold = (lambda t, n: F.greatest(F.lit(0), F.least(F.col(t), F.lit(n - 1)))) if size else (lambda t, n: F.col(t))
    w, h = size or (0, 0)
    taps = taps.withColumn("col", hold("tc", w).cast("long")).withColumn("row", hold("tr", h).cast("long"))
    found = taps.join(pixels.select("col", "row", F.col(band).cast("double").alias("__b")), ["col", "row"])
    return found.groupBy("i", "j").agg((F.sum(F.col("w") * F.col("__b")) / F.sum("w")).alias(band))


def band_math(pixels: DataFrame, text: str, nodata: float | None = None, out: str = "value") -> DataFrame:
    """The value of an expression for every pixel; null where a band of it is nodata."""
    tree = bandmath.parse(text)
    return pixels.withColumn(out, F.when(bandmath.valid(tree, nodata), bandmath.column(tree)))


def colourized(pixels: DataFrame, ramp: style.Ramp, value: str = "value") -> DataFrame:
    """r, g, b, a of a value by a ramp; transparent where it isn't finite."""
    return pixels.select(*[c for c in pixels.columns if c not in ("r", "g", "b", "a")], *[style.ramp_column(ramp, F.col(value), k).alias(n) for k, n in enumerate("rgba")])


def rgb(pixels: DataFrame, bands: style.Bands, alpha: str | None = None) -> DataFrame:
    """r, g, b by 1-based band columns b1.. and a from a band, else opaque."""
    pick = lambda n: F.col(f"b{n}").cast("int")
    return pixels.select("col", "row", pick(bands.red).alias("r"), pick(bands.green).alias("g"), pick(bands.blue).alias("b"), (F.col(alpha).cast("int") if alpha else F.lit(255)).alias("a"))


def flattened(pixels: DataFrame, background: tuple[int, int, int]) -> DataFrame:
    """r, g, b on a background, opaque."""
    mixed = [style.over(F.col(c), F.col("a"), b).alias(c) for c, b in zip("rgb", background)]
    return pixels.select(*[c for c in pixels.columns if c not in ("r", "g", "b", "a")], *mixed, F.lit(255).alias("a"))


def overview(levels: list[tuple[int, float]], wanted: float) -> int:
    """The coarsest level whose factor is at most the wanted one (with a thousandth's slack); levels by rising factor."""
    best = levels[0][0]
    for number, factor in levels:
        if factor > wanted * 1.001:
            break
        best = number
    return best


def point_sample(points: DataFrame, pixels: DataFrame, bands: list[str], size: tuple[int, int], nodata: float | None = None, expression: str | None = None) -> DataFrame:
    """Values of all bands at points (u, v), whether the point is in the image, nodata, and an expression's value."""
    inside = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < size[0]) & (F.col("v") < size[1])
    p = points.withColumn("in_image", inside).withColumn("col", F.floor("u").cast("long")).withColumn("row", F.floor("v").cast("long"))
    out = p.join(pixels.select("col", "row", *bands), ["col", "row"], "left")
    if nodata is not None:
        out = out.withColumn("is_nodata", F.coalesce(F.abs(F.col(bands[0]).cast("double") - F.lit(float(nodata))) < 0.5, F.lit(False)))
    return band_math(out, expression, nodata, "derived") if expression else out
