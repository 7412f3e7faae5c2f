"""Every registered geographic query against its SQL in DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from quadrille.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: float(v) if isinstance(v, decimal.Decimal) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cur = db.execute(registry.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), columns)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_same_under_either_ansi_mode(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for name in ("p02_bandmath_ndvi", "p06_filter_cmp", "p15_rule_select", "g08_hilbert_id", "r06_colorize"):
            assert registry.QUERIES[name](spark, SF).count() > 0
        rows = registry.raster.band_math(spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (6.0, 3.0)], "b1 double, b2 double"), "B1 / B2").collect()
        assert [str(r.value) for r in rows] == ["inf", "nan", "-inf", "2.0"]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_no_product_of_tables(spark):
    for name in ("j02_tile_feature_join", "j03_point_in_polygon", "j04_nearest_points", "r03_warp_nearest", "w07_gfi_rank"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_window_reaches_the_scan(spark, tmp_path):
    from quadrille.operators import joins
    from quadrille.plans import views

    views.boxes(spark, SF).write.parquet(str(tmp_path / "b"))
    plan = joins.window(spark.read.parquet(str(tmp_path / "b")), (1.0, 2.0, 3.0, 4.0)).select("fid")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(maxx,1.0)" in plan and "area" not in plan.split("ReadSchema")[1]


def test_entry_without_the_corpus_package(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
