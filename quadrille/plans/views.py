"""Geographic views over the driver's tables, in Spark and as DuckDB SQL.

Whole-number arithmetic and divisions by powers of two or exact decimals only, so both engines agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wkb

POINTS = "points AS (SELECT event_id AS fid, CAST(event_id * 7919 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(event_id * 104729 % 16000 AS DOUBLE) / 100 - 80 AS lat, event_type, value, user_id FROM events)"
BOXES = "boxes AS (SELECT o_orderkey AS fid, CAST(o_orderkey * 37 % 1000 AS DOUBLE) AS minx, CAST(o_orderkey * 91 % 1000 AS DOUBLE) AS miny, CAST(o_orderkey * 37 % 1000 + 1 + o_custkey % 20 AS DOUBLE) AS maxx, CAST(o_orderkey * 91 % 1000 + 1 + o_orderkey % 15 AS DOUBLE) AS maxy, CAST((1 + o_custkey % 20) * (1 + o_orderkey % 15) AS DOUBLE) AS area, o_orderstatus AS class_key, o_orderpriority AS name, o_totalprice AS price FROM orders)"
CELLS = "cells AS (SELECT p_partkey AS fid, p_partkey % 50 AS col, p_partkey // 50 AS row, p_brand AS class_key FROM part)"
PIXELS = "pixels AS (SELECT l_orderkey % 256 AS col, (l_orderkey * 7 + l_linenumber) % 256 AS row, max(l_quantity) AS b1, max(l_extendedprice) AS b2, max(l_discount) AS b3, max(l_tax) AS b4 FROM lineitem GROUP BY 1, 2)"
CORNERS = "corners AS (SELECT fid, class_key, CAST(10 * col AS BIGINT) AS x0, CAST(10 * row AS BIGINT) AS y0, CAST(10 * col + 10 AS BIGINT) AS x1, CAST(10 * row + 10 AS BIGINT) AS y1 FROM cells)"
EDGES = "edges AS (SELECT fid, class_key, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by_ FROM corners UNION ALL SELECT fid, class_key, x1, y0, x1, y1 FROM corners UNION ALL SELECT fid, class_key, x1, y1, x0, y1 FROM corners UNION ALL SELECT fid, class_key, x0, y1, x0, y0 FROM corners)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points in degrees."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("fid"), F.expr("CAST(event_id * 7919 % 36000 AS DOUBLE) / 100D - 180D").alias("lon"), F.expr("CAST(event_id * 104729 % 16000 AS DOUBLE) / 100D - 80D").alias("lat"), "event_type", "value", "user_id")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as boxes on a thousand units square."""
    o = table(spark, sf_dir, "orders")
    e = lambda t, n: F.expr(f"CAST({t} AS DOUBLE)").alias(n)
    return o.select(
        F.col("o_orderkey").alias("fid"), e("o_orderkey * 37 % 1000", "minx"), e("o_orderkey * 91 % 1000", "miny"), e("o_orderkey * 37 % 1000 + 1 + o_custkey % 20", "maxx"), e("o_orderkey * 91 % 1000 + 1 + o_orderkey % 15", "maxy"),
        e("(1 + o_custkey % 20) * (1 + o_orderkey % 15)", "area"), F.col("o_orderstatus").alias("class_key"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("price"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the squares of a wall-to-wall coverage, fifty to a row."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), F.expr("p_partkey % 50").alias("col"), F.expr("p_partkey div 50").alias("row"), F.col("p_brand").alias("class_key"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage's squares as open rings, ten units wide."""
    at = lambda x, y: F.struct((F.col("col") * 10 + x).cast("long").alias("x"), (F.col("row") * 10 + y).cast("long").alias("y"))
    return cells(spark, sf_dir).withColumn("ring", F.array(at(0, 0), at(10, 0), at(10, 10), at(0, 10)))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a raster of four bands; one row for each pixel that has any."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey % 256").alias("col"), F.expr("(l_orderkey * 7 + l_linenumber) % 256").alias("row"))
    return rows.agg(F.max("l_quantity").alias("b1"), F.max("l_extendedprice").alias("b2"), F.max("l_discount").alias("b3"), F.max("l_tax").alias("b4"))


def box_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as polygon features with attributes."""
    @F.pandas_udf("binary")
    def polygon(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(wkb.encode_boxes(a, b, c, d))

    one = lambda n, s: F.struct(n.cast("double").alias("n"), s.cast("string").alias("s"))
    null = F.lit(None)
    props = F.create_map(F.lit("class"), one(null, F.col("class_key")), F.lit("price"), one(F.col("price"), null))
    return boxes(spark, sf_dir).select("fid", polygon("minx", "miny", "maxx", "maxy").alias("wkb"), props.alias("props"), "minx", "miny", "maxx", "maxy", "area", F.col("fid").alias("ord"))


def cell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage's squares as polygon features."""
    @F.pandas_udf("binary")
    def square(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(wkb.encode_boxes(10.0 * c, 10.0 * r, 10.0 * c + 10, 10.0 * r + 10))

    at = lambda c, d: (F.col(c) * 10 + d).cast("double")
    one = F.struct(F.lit(None).cast("double").alias("n"), F.col("class_key").alias("s"))
    return cells(spark, sf_dir).select("fid", square("col", "row").alias("wkb"), F.create_map(F.lit("class"), one).alias("props"), at("col", 0).alias("minx"), at("row", 0).alias("miny"), at("col", 10).alias("maxx"), at("row", 10).alias("maxy"), F.lit(100.0).alias("area"), F.col("fid").alias("ord"), "class_key")
