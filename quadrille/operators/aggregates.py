"""Aggregations of layers, tiles and archives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mvt import positions

#: Fixed value: the most classes of a palette.
MOST_CLASSES = 65_534


def extent(df: DataFrame) -> DataFrame:
    """The box of a layer in one row."""
    return df.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def field_schema(attributes: DataFrame) -> DataFrame:
    """Type of each field by its first value that isn't null; rows are (ord, field, kind) with kind Number, String or null."""
    return attributes.filter(F.col("kind").isNotNull()).groupBy("field").agg(F.min_by("kind", "ord").alias("type"))


def palette(values: DataFrame) -> DataFrame:
    """Classes of (class_key, ord) rows numbered from 1 by first appearance; nulls are left out.

    The classes are few once they are aggregated; only those are numbered.
    """
    firsts = values.filter(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min("ord").alias("first_ord"))
    top = firsts.orderBy("first_ord", "class_key").limit(MOST_CLASSES)
    return top.withColumn("class_index", F.row_number().over(Window.orderBy("first_ord", "class_key")))


def cell_mosaic(covered: DataFrame, by: list[str]) -> DataFrame:
    """Class of each cell: the feature that comes last by ord wins. Rows are (by..., col, row, class_key, ord)."""
    return covered.groupBy(*by, "col", "row").agg(F.max_by("class_key", "ord").alias("class_key"))


def row_runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Runs of equal neighbours in each row of cells: (by..., row, class_key, col0, col1 exclusive)."""
    island = F.col("col") - F.row_number().over(Window.partitionBy(*by, "row", "class_key").orderBy("col"))
    runs = cells.withColumn("__i", island).groupBy(*by, "row", "class_key", "__i").agg(F.min("col").alias("col0"), (F.max("col") + 1).alias("col1"))
    return runs.drop("__i")


def ring_edges(df: DataFrame, ring: str, *keep: str) -> DataFrame:
    """Edges of open rings array<struct<x,y>>, with the neighbours that junctions need: keep..., ax, ay, bx, by_."""
    n = F.size(ring)
    pairs = F.transform(F.col(ring), lambda p, i: F.struct(p.alias("a"), F.get(F.col(ring), F.when(i + 1 < n, i + 1).otherwise(F.lit(0))).alias("b")))
    return df.select(*keep, F.explode(pairs).alias("e")).select(*keep, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by_"))


def with_neighbours(ring: str) -> Column:
    """Vertices of an open ring with their unordered pairs of neighbours: array<struct<p, l, r>>."""
    n = F.size(ring)
    at = lambda i: F.get(F.col(ring), i)
    before = lambda i: at(F.when(i > 0, i - 1).otherwise(n - 1))
    after = lambda i: at(F.when(i + 1 < n, i + 1).otherwise(F.lit(0)))
    return F.transform(F.col(ring), lambda p, i: F.struct(p.alias("p"), F.least(before(i), after(i)).alias("l"), F.greatest(before(i), after(i)).alias("r")))


def junctions(df: DataFrame, ring: str) -> DataFrame:
    """Vertices that have two or more different unordered pairs of neighbours: (x, y, pairs)."""
    pairs = df.select(F.explode(with_neighbours(ring)).alias("t")).select("t.p.x", "t.p.y", "t.l", "t.r").distinct()
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("pairs")).filter("pairs > 1")


def edge_degrees(edges: DataFrame) -> DataFrame:
    """How many rings share each undirected edge."""
    forward = F.struct("ax", "ay") < F.struct(F.col("bx").alias("ax"), F.col("by_").alias("ay"))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return edges.groupBy(pick("ax", "bx").alias("ax"), pick("ay", "by_").alias("ay"), pick("bx", "ax").alias("bx"), pick("by_", "ay").alias("by_")).agg(F.count(F.lit(1)).alias("degree"))


def content_ids(tiles: DataFrame, blob: str = "blob") -> DataFrame:
    """One row for each distinct content: its hash, its least tile, and how many tiles have it."""
    return tiles.groupBy(F.sha2(F.col(blob).cast("binary"), 256).alias("content")).agg(F.min("tile_id").alias("first_tile"), F.count(F.lit(1)).alias("tiles"))


def archive_runs(tiles: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Directory entries: runs of consecutive tile ids with one content, (tile_id, run_length, content).

    Gaps and islands within each content in chunks of ids, which bound a group whatever one content holds. Chunks that
    are one run from end to end collapse by number of chunk, and only runs that touch a chunk's border are then joined
    by content: at most two in `chunk` of the ids.
    """
    island = F.col("tile_id") - F.row_number().over(Window.partitionBy("content", "__k").orderBy("tile_id"))
    parts = tiles.withColumn("__k", F.floor(F.col("tile_id") / chunk)).withColumn("__i", island)
    parts = parts.groupBy("content", "__k", "__i").agg(F.min("tile_id").alias("lo"), F.max("tile_id").alias("hi"))
    first, last = F.col("lo") == F.col("__k") * chunk, F.col("hi") == F.col("__k") * chunk + (chunk - 1)
    inner = parts.filter(~first & ~last).select("lo", "hi", "content")
    # At most two rows for each content and chunk, so 2 / chunk of the ids at most; whole chunks collapse by island first.
    edge = parts.filter(first | last)
    spread = F.floor(F.col("__k") / chunk)
    whole = edge.filter(first & last).withColumn("__s", spread)
    whole = whole.withColumn("__i", F.col("__k") - F.row_number().over(Window.partitionBy("content", "__s").orderBy("__k")))
    whole = whole.groupBy("content", "__s", "__i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi", "content")
    ends = whole.union(edge.filter(~(first & last)).select("lo", "hi", "content"))
    w = Window.partitionBy("content").orderBy("lo")
    starts = F.when(F.lag("hi").over(w) + 1 == F.col("lo"), 0).otherwise(1)
    joined = ends.withColumn("__s", starts).withColumn("__g", F.sum("__s").over(w)).groupBy("content", "__g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi", "content")
    return inner.union(joined).select(F.col("lo").alias("tile_id"), (F.col("hi") - F.col("lo") + 1).alias("run_length"), "content")


def latest(records: DataFrame, key: str = "tile_id", order: str = "seq") -> DataFrame:
    """The last record of each key, by an aggregation that combines before the shuffle."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def hit_ranks(hits: DataFrame, limit: int) -> DataFrame:
    """Hits of each query in order: polygons by ord, then points by distance; at most limit, at least one."""
    w = Window.partitionBy("query_id").orderBy("kind_order", "dist", "ord")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, limit))


def archive_counts(entries: DataFrame) -> DataFrame:
    """Addressed tiles, entries and contents of a directory."""
    return entries.agg(F.sum("run_length").alias("addressed"), F.count(F.lit(1)).alias("entries"), F.count_distinct("content").alias("contents"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table that comes in few splits, dealt out by a key to all cores; tables that come out of a shuffle stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(4 * cores, key)


def ranked(df: DataFrame, by: list[str], order: str, width: int = 1 << 16) -> DataFrame:
    """Add __k, a row's place in its group by a whole-number column (from 0), and __n, the size of the group.

    Places come from counts of stretches of `width` numbers and the place within one, so a group may hold all rows and is
    never in one task; a stretch holds as many rows as share its numbers.
    """
    stretch = F.floor(F.col(order) / F.lit(width))
    named = [f"__g{i}" for i in range(len(by))]
    counts = df.groupBy(*[F.col(c).alias(n) for c, n in zip(by, named, strict=True)], stretch.alias("__of")).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*named)
    before = F.sum("__c").over(whole.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__n", F.sum("__c").over(whole)).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__c")
    within = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(order)) - 1
    rows = df.withColumn("__b", stretch).withColumn("__k", within)
    same = F.col("__b").eqNullSafe(F.col("__of"))
    for c, n in zip(by, named, strict=True):
        same &= F.col(c).eqNullSafe(F.col(n))
    return rows.join(counts, same).withColumn("__k", F.col("__k") + F.col("__before")).drop(*named, "__of", "__before", "__b")


def sampled(df: DataFrame, by: list[str], order: str, budget: int) -> DataFrame:
    """An even sample of at most `budget` rows of each group by a whole-number column: the places that positions() gives for its size."""
    if budget <= 0:
        return df

    @F.pandas_udf("boolean")
    def chosen(k: pd.Series, n: pd.Series) -> pd.Series:
        out = np.zeros(len(k), bool)
        for size in n.unique():
            own = (n == size).to_numpy()
            out[own] = np.isin(k[own].to_numpy(), positions(int(size), budget))
        return pd.Series(out)

    rows = ranked(df, by, order)
    return rows.filter((F.col("__n") <= budget) | chosen("__k", "__n")).drop("__k", "__n")
