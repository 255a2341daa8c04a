"""Design rainfall from stations: interpolation, coverage and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.spatial import nearest_points

#: Duration names by minutes, and the allowed probabilities in percent.
DURATIONS = {15: "15min", 30: "30min", 60: "1h", 120: "2h", 360: "6h", 720: "12h", 1440: "24h"}
PROBABILITIES = (1, 2, 5, 10, 20, 50)
POWER, EPSILON = 2, 0.001


def duration_name(minutes: Column) -> Column:
    """Name of a duration in minutes; null if it isn't one of DURATIONS."""
    names = F.create_map(*(F.lit(x) for pair in DURATIONS.items() for x in pair))
    return F.try_element_at(names, minutes)


def valid(duration: Column, probability: Column) -> Column:
    return F.coalesce(duration.isin(*DURATIONS) & probability.isin(*PROBABILITIES), F.lit(False))


def interpolate(asks: DataFrame, stations: DataFrame, value: str, by: list[str], k: int = 4, size: int | None = None) -> DataFrame:
    """(qid, by, value, n) by inverse squared distance of the k nearest stations (id, x, y, by, value).

    A station nearer than EPSILON decides alone; an ask without stations gives no row. Stations
    that have values for the same set of ``by`` are searched once for all of them.
    """
    each = F.sort_array(F.collect_list(F.struct(*by, F.col(value).alias("_value"))))
    places = stations.groupBy("id", "x", "y").agg(each.alias("_values"))
    kind = F.xxhash64(F.transform("_values", lambda v: F.struct(*(v[b] for b in by)))) if by else F.lit(0)
    near = nearest_points(asks, places.withColumn("_kind", kind), k, ["_kind"], size)
    near = near.select("qid", "id", "d2", F.explode("_values").alias("v")).select("qid", "id", "d2", *(F.col(f"v.{b}") for b in by), F.col("v._value").alias(value))
    # of several kinds of stations each gave its k nearest
    rank = F.row_number().over(Window.partitionBy("qid", *by).orderBy("d2", "id"))
    near = near.withColumn("_rank", rank).where(F.col("_rank") <= k)
    d = F.sqrt("d2")
    weight = 1 / F.pow(d + EPSILON, F.lit(POWER))
    sums = near.withColumn("weight", weight).groupBy("qid", *by).agg(
        (F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("mean"), F.min_by(value, F.struct("d2", "id")).alias("first"), F.min("d2").alias("d2"), F.count("*").alias("n")
    )
    return sums.select("qid", *by, F.when(F.sqrt("d2") < EPSILON, F.col("first").cast("double")).otherwise(F.col("mean")).alias("value"), "n")


def coverage(stations: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """(n_points, n_records) of stations inside a box."""
    inside = stations.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return inside.agg(F.count_distinct("x", "y").alias("n_points"), F.count("*").alias("n_records"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Rows of both, one per key: the one with the largest ``newest``; of equals, the new one, then the larger value. Rows of ``new`` without a value are left out."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.where("mm_x10 is not null").withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    # the largest of each key's rows, combined before the shuffle
    best = F.max(F.struct(F.col(newest).alias("_a"), F.col("_new").alias("_b"), F.col("mm_x10").alias("_c"), F.struct(*rest).alias("_row")))
    return both.groupBy(*keys).agg(best.alias("_best")).select(*(c if c in keys else F.col(f"_best._row.{c}").alias(c) for c in old.columns))
