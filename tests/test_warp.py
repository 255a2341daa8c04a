"""Warped rasters: there and back again, and the plane that bilinear values lie on."""

import math

from pyspark.sql import functions as F
from rillflow.functions import crs
from rillflow.operators import warp


def test_warp_there_and_back(spark):
    """A smooth surface keeps its values but for the curvature inside a cell."""
    source = warp.Grid(18.9, 51.9, 0.002, 60, 50)
    value = lambda lon, lat: 100 + 900 * (lon - 18.9) + 700 * (lat - 51.9) + 5 * math.sin(40 * lon)
    rows = [(r, c, value(18.9 + (c + 0.5) * 0.002, 51.9 + (60 - r - 0.5) * 0.002)) for r in range(60) for c in range(50)]
    cells = spark.createDataFrame(rows, "r long, c long, z double")
    target = warp.target_grid(cells, source, crs.to_grid, 100.0)
    assert target.size == 100 and 68 <= target.ncols <= 72 and 132 <= target.nrows <= 136
    there = warp.warp(cells, source, target, crs.to_degrees)
    x, y = target.x0 + (F.col("c") + 0.5) * 100, target.y0 + (target.nrows - F.col("r") - 0.5) * 100
    lon, lat = crs.to_degrees(x, y)
    truth = 100 + 900 * (lon - 18.9) + 700 * (lat - 51.9) + 5 * F.sin(40 * lon)
    # of the sine, bilinear values lose (cell / 2)^2 / 2 of its second derivative at most
    assert there.select(F.max(F.abs(F.col("z") - truth))).first()[0] < 5 * 40**2 * 0.001**2 / 2 + 1e-6
    assert there.count() > 0.85 * target.nrows * target.ncols
    back = warp.warp(there, target, source, crs.to_grid)
    joined = back.join(cells.withColumnRenamed("z", "was"), ["r", "c"])
    assert joined.count() == back.count() > 2500
    assert joined.select(F.max(F.abs(F.col("z") - F.col("was")))).first()[0] < 0.02


def test_warp_leaves_out_what_it_does_not_know(spark):
    grid = warp.Grid(0.0, 0.0, 10.0, 4, 4)
    cells = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else float(r)) for r in range(4) for c in range(4)], "r long, c long, z double")
    same = warp.warp(cells, grid, grid, lambda x, y: (x, y))
    assert {(r.r, r.c): r.z for r in same.collect()} == {(r, c): float(r) for r in range(4) for c in range(4) if (r, c) != (1, 1)}
    moved = warp.warp(cells, grid, grid, lambda x, y: (x + 5, y))
    assert {(r.r, r.c) for r in moved.collect()} == {(r, c) for r in range(4) for c in range(3)} - {(1, 0), (1, 1)}
    assert warp.warp(cells.limit(0), grid, grid, lambda x, y: (x, y)).count() == 0
    assert warp.target_grid(cells, grid, lambda x, y: (x, y), 1.0).size == warp.LEAST
