"""Hydrological views over the driver's tables, in Spark and in DuckDB, by the same integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view -> (table, filter, columns); ``//`` is integer division.
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "a_catch": (
        "orders",
        "o_orderkey >= 1",
        {
            "id": "o_orderkey",
            "down": "CASE WHEN o_orderkey > 1 THEN (2 * o_orderkey) // 3 END",
            "area_milli": "10 + o_orderkey % 97",
            "elev_min_cm": "10000 + 37 * (o_orderkey % 211)",
            "elev_max_cm": "10500 + 37 * (o_orderkey % 211) + o_orderkey % 1500",
            "elev_mean_cm": "CASE WHEN o_orderkey % 53 <> 0 THEN 10250 + 37 * (o_orderkey % 211) + (o_orderkey % 1500) // 2 END",
            "slope_bp": "CASE WHEN o_orderkey % 59 <> 0 THEN o_orderkey % 900 END",
            "strahler": "1 + o_orderkey % 5",
            "len_m": "CASE WHEN o_orderkey % 61 <> 0 THEN 50 + o_orderkey % 701 END",
        },
    ),
    "a_segment": (
        "orders",
        "o_orderkey >= 1",
        {
            "id": "o_orderkey",
            "x1": "500000 + (7919 * o_orderkey) % 20011",
            "y1": "300000 + (104729 * o_orderkey) % 20021",
            "x2": "500000 + (7919 * ((2 * o_orderkey) // 3)) % 20011",
            "y2": "300000 + (104729 * ((2 * o_orderkey) // 3)) % 20021",
            "source": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'BDOT' ELSE 'DEM_DERIVED' END",
        },
    ),
    "a_cells": (
        "orders",
        "true",
        {
            "r": "o_orderkey // 100",
            "c": "o_orderkey % 100",
            "z": "CASE WHEN o_orderkey % 101 <> 0 THEN 20000 - 40 * (o_orderkey // 100) - 10 * (o_orderkey % 100) + (7919 * o_orderkey) % 31 END",
            "label": "((o_orderkey // 100) // 10) * 10 + (o_orderkey % 100) // 10 + 1",
        },
    ),
    "a_stations": ("customer", "true", {"id": "c_custkey", "x": "500000 + (7919 * c_custkey) % 20011", "y": "300000 + (104729 * c_custkey) % 20021"}),
    "a_land": (
        "part",
        "true",
        {"id": "p_partkey", "x0": "500000 + (3571 * p_partkey) % 20000", "y0": "300000 + (6869 * p_partkey) % 20000", "w": "50 + p_partkey % 400", "h": "50 + (13 * p_partkey) % 300", "cat": "p_partkey % 8"},
    ),
    "a_soil": ("supplier", "true", {"id": "s_suppkey", "x0": "500000 + (1999 * s_suppkey) % 18000", "y0": "300000 + (2897 * s_suppkey) % 18000", "w": "CAST(1500 AS BIGINT)", "h": "CAST(1200 AS BIGINT)", "grp": "s_suppkey % 4"}),
    "a_sheds": (
        "nation",
        "true",
        {"qid": "CAST(n_nationkey AS BIGINT)", "x0": "CAST(500000 + 3500 * (n_nationkey % 5) AS BIGINT)", "y0": "CAST(300000 + 3500 * (n_nationkey // 5) AS BIGINT)", "w": "CAST(4000 AS BIGINT)", "h": "CAST(4000 AS BIGINT)"},
    ),
    "a_depr": ("part", "true", {"id": "p_partkey", "x": "500000 + (3571 * p_partkey) % 20000", "y": "300000 + (6869 * p_partkey) % 20000", "vol_dm3": "(7907 * p_partkey) % 100003", "area_dm2": "50 + (613 * p_partkey) % 5000", "depth_mm": "(31 * p_partkey) % 500"}),
    "a_points": ("supplier", "true", {"qid": "s_suppkey", "x": "500000 + (7901 * s_suppkey) % 20000", "y": "300000 + (6101 * s_suppkey) % 20000"}),
}
DURATIONS = (15, 30, 60, 120, 360, 720, 1440)
PROBABILITIES = (1, 2, 5, 10, 20, 50)
THRESHOLDS = {1000: 1, 10000: 10, 100000: 100}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, kept, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(kept).selectExpr(*(f"{e.replace('//', 'div')} AS {c}" for c, e in columns.items()))


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, id, duration, probability, mm_x10) of every station."""
    stations = view(spark, sf_dir, "a_stations")
    d = ", ".join(f"named_struct('duration', {v}, 'd', {i})" for i, v in enumerate(DURATIONS))
    p = ", ".join(f"named_struct('probability', {v}, 'p', {i})" for i, v in enumerate(PROBABILITIES))
    return stations.selectExpr("*", f"explode(array({d})) AS a").selectExpr("*", f"explode(array({p})) AS b").selectExpr("id", "x", "y", "a.duration", "b.probability", "50 + 60 * a.d + 25 * b.p + id % 40 AS mm_x10")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catchments at all thresholds: (threshold, columns of a_catch)."""
    from pyspark.sql import functions as F

    catch = view(spark, sf_dir, "a_catch")
    top = catch.agg(F.max("id").alias("top"))
    steps = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(d).alias("d")) for t, d in THRESHOLDS.items())))
    return catch.crossJoin(F.broadcast(top)).withColumn("s", steps).where(F.expr("id <= top div s.d")).select(F.col("s.threshold").alias("threshold"), *catch.columns)


def sql(*names: str, recursive: bool = False) -> str:
    """WITH list of DuckDB views, to be followed by more of it or by a query after ``SELECT``."""
    parts = []
    for name in names:
        if name == "a_rain":
            d = ", ".join(f"({v}, {i})" for i, v in enumerate(DURATIONS))
            p = ", ".join(f"({v}, {i})" for i, v in enumerate(PROBABILITIES))
            parts.append(f"a_rain AS MATERIALIZED (SELECT id, x, y, duration, probability, 50 + 60 * d + 25 * p + id % 40 AS mm_x10 FROM a_stations, (VALUES {d}) AS dd(duration, d), (VALUES {p}) AS pp(probability, p))")
        elif name == "a_levels":
            t = ", ".join(f"({a}, {b})" for a, b in THRESHOLDS.items())
            parts.append(f"a_levels AS MATERIALIZED (SELECT threshold, a_catch.* FROM a_catch, (VALUES {t}) AS tt(threshold, d) WHERE id <= (SELECT max(id) FROM a_catch) // d)")
        else:
            table, kept, columns = VIEWS[name]
            parts.append(f"{name} AS MATERIALIZED (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table} WHERE {kept})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)
