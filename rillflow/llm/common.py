"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.checkpoint import cut

__all__ = ["bounded_sample", "cut", "slices", "table", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """UTF-8 length of a text, null as empty."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def bounded_sample(df: DataFrame, key: list[str], bound: int) -> DataFrame:
    """At most ``bound`` rows of ``df``: those whose ``key`` has the smallest hashes.

    Rows are counted first, and only hashes below a limit that some more than ``bound`` rows
    are expected to meet are sorted: what tasks send for the top stays as small when there
    are more of them.
    """
    total = df.count()
    room = 1 << 30
    share = min(1.0, (1.2 * bound + 10 * bound**0.5) / max(1, total))
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(*key), F.lit(room)))
    return hashed.where(F.col("_hash") < int(room * share) + 1).orderBy("_hash", *key).limit(bound).drop("_hash")


def slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Consecutive slices whose sizes sum to ``limit`` or less; a larger row is alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))
