"""Writing and checking the persistent relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_segments(df: DataFrame, path: str) -> None:
    """Segments by threshold, one per (name, threshold, ends, length); repeats are left out."""
    df.dropDuplicates(["name", "threshold", "x1", "y1", "x2", "y2"]).write.mode("append").partitionBy("threshold").parquet(path)


def replace_box(old: DataFrame, new: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """``old`` without what touches the box, and ``new``."""
    c = F.col
    touches = (c("x0") <= box[2]) & (c("x0") + c("w") >= box[0]) & (c("y0") <= box[3]) & (c("y0") + c("h") >= box[1])
    return old.where(~touches).unionByName(new)


def drop_small_parts(parts: DataFrame, least: float = 50.0) -> DataFrame:
    """Parts (id, part, area) of at least ``least``; the largest one stays if all are smaller."""
    largest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("area"), "part"))
    return parts.withColumn("rank", largest).where((F.col("area") >= least) | (F.col("rank") == 1)).drop("rank")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that break each check; null passes, as in SQL constraints."""
    return df.agg(*(F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in checks.items()))


def segment_checks() -> dict[str, Column]:
    return {"length_positive": F.col("length_m") > 0, "order_positive": F.col("strahler_order") > 0}


def features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, as text lines."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def merge_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Layers on top of each other with ``source_layer``; columns that one lacks are null."""
    out: DataFrame | None = None
    for name, layer in layers.items():
        tagged = layer.withColumn("source_layer", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no layers")
    return out
