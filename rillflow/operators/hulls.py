"""Convex hulls: hulls of parts are hulls of hulls, so batches are reduced where they lie before anything moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of the hull's corners, counter-clockwise from the smallest point: no point on a side, no point twice."""
    order = np.lexsort((y, x)).tolist()
    px, py = x.tolist(), y.tolist()
    order = [i for k, i in enumerate(order) if k == 0 or (px[i], py[i]) != (px[order[k - 1]], py[order[k - 1]])]
    if len(order) < 3:
        return order
    halves = []
    for way in (order, order[::-1]):
        side: list[int] = []
        for i in way:
            while len(side) > 1:
                a, b = side[-2], side[-1]
                if (px[b] - px[a]) * (py[i] - py[a]) - (py[b] - py[a]) * (px[i] - px[a]) > 0:
                    break
                side.pop()
            side.append(i)
        halves.append(side[:-1])
    return halves[0] + halves[1]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, x, y = (batch.column(k).to_numpy() for k in ("key", "x", "y"))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        keep = [part[hull(x[part], y[part])] for part in np.split(order, cuts) if len(part)]
        yield batch.take(pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64)))


def _whole(table: pa.Table) -> pa.Table:
    x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
    at = hull(x, y)
    return pa.Table.from_pydict({"key": table.column("key").slice(0, 1).combine_chunks(), "shell": pa.array([[{"x": float(x[i]), "y": float(y[i])} for i in at]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})


def convex_hulls(points: DataFrame) -> DataFrame:
    """(key, shell) of points (key, x, y): the hull's corners, counter-clockwise from the smallest, without a closing point.

    Points in a line give its two ends, a single point itself; rows with a null are left out. Two rounds of hulls before the last one keep what
    reaches a key's task small: batches first, then 64 parts of each key.
    """
    given = points.select(F.col("key").cast("long").alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    kind = "key long, x double, y double"
    parts = given.mapInArrow(_partial, kind).repartition(F.col("key"), F.pmod(F.xxhash64("x", "y"), F.lit(64))).mapInArrow(_partial, kind)
    return parts.groupBy("key").applyInArrow(_whole, "key long, shell array<struct<x: double, y: double>>")
