"""Rasters between projections: each target cell looks back at the four source cells around its centre."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.raster import resample_bilinear

#: Cells of a warped tile are no smaller than this, in metres.
LEAST = 5.0

Projection = Callable[[Column, Column], tuple[Column, Column]]


class Grid(NamedTuple):
    """Cells of a raster: row 0 is on top, (x0, y0) the lower left corner."""

    x0: float
    y0: float
    size: float
    nrows: int
    ncols: int


def target_grid(source: DataFrame, grid: Grid, forward: Projection, size: float, steps: int = 21) -> Grid:
    """The grid of cells of ``size``, LEAST at least, that covers ``grid`` in the new projection: by points along its sides.

    source: any DataFrame of the session.
    """
    size = max(size, LEAST)
    w, h = grid.ncols * grid.size, grid.nrows * grid.size
    along = source.sparkSession.range(steps).select((F.col("id") / (steps - 1)).alias("t"))
    side = lambda x, y: F.struct((grid.x0 + w * x).alias("x"), (grid.y0 + h * y).alias("y"))
    t, zero, one = F.col("t"), F.lit(0.0), F.lit(1.0)
    ring = along.select(F.explode(F.array(side(t, zero), side(t, one), side(zero, t), side(one, t))).alias("p"))
    x, y = forward(F.col("p.x"), F.col("p.y"))
    box = ring.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    return Grid(box.x0, box.y0, size, math.ceil((box.y1 - box.y0) / size), math.ceil((box.x1 - box.x0) / size))


def warp(cells: DataFrame, source: Grid, target: Grid, back: Projection) -> DataFrame:
    """(r, c, z) of the cells of ``target`` whose centres lie among the source's cells (r, c, z): bilinear, by ``back`` from the target's
    coordinates to the source's. Cells without four valid neighbours are left out."""
    spark, c = cells.sparkSession, F.col
    each = spark.range(target.nrows * target.ncols).select("id", F.expr(f"id div {target.ncols}").alias("tr"), (c("id") % target.ncols).alias("tc"))
    x, y = target.x0 + (c("tc") + 0.5) * target.size, target.y0 + (target.nrows - c("tr") - 0.5) * target.size
    sx, sy = back(x, y)
    rr, cc = (source.y0 + source.nrows * source.size - sy) / source.size - 0.5, (sx - source.x0) / source.size - 0.5
    asked = each.select("id", rr.alias("rr"), cc.alias("cc")).where((c("rr") >= 0) & (c("rr") <= source.nrows - 1) & (c("cc") >= 0) & (c("cc") <= source.ncols - 1))
    found = resample_bilinear(cells.select("r", "c", "z"), asked).where("z is not null")
    return found.select(F.expr(f"id div {target.ncols}").alias("r"), (c("id") % target.ncols).alias("c"), "z")
