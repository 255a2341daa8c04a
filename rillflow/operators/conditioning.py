"""Conditioning of terrain cells (r, c, z): buildings, burnt streams, samples, nearest fill and sinks.

Cells are squares of one unit: cell (r, c) spans c to c + 1 in x and r to r + 1 in y.
Polygons and lines are laid onto the cells they touch and meet them by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators import spatial
from rillflow.operators.raster import DIAGONAL, DIRECTIONS, ROW, cell_id


def _low(v: Column) -> Column:
    return F.floor(v).cast("long")


def _touched(low: Column, high: Column) -> Column:
    """Unit cells that meet low..high, both ends and the cells' edges included."""
    return F.explode(F.sequence((F.ceil(low) - 1).cast("long"), _low(high)))


def cells_in_rings(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Distinct (r, c) whose centre lies in a polygon, a closed ring of struct(x, y)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    box = polygons.select(ring, F.explode(F.sequence(_low(F.array_min(ys)), _low(F.array_max(ys)))).alias("r"), xs.alias("xs"))
    each = box.select(ring, "r", F.explode(F.sequence(_low(F.array_min("xs")), _low(F.array_max("xs")))).alias("c"))
    inside = spatial.polygon_contains(F.col("c") + 0.5, F.col("r") + 0.5, F.col(ring))
    return each.where(inside).select("r", "c").distinct()


def cells_on_segments(segments: DataFrame) -> DataFrame:
    """Distinct (r, c) that a segment (x1, y1, x2, y2) touches, at an edge or corner too: row by row, the columns it passes in that row."""
    c = F.col
    rows = segments.withColumn("r", _touched(F.least("y1", "y2"), F.greatest("y1", "y2")))
    at = lambda y: c("x1") + (c("x2") - c("x1")) * (y - c("y1")) / F.nullif(c("y2") - c("y1"), F.lit(0))
    clip = lambda y: F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2"))
    flat = c("y1") == c("y2")
    a = F.when(flat, c("x1")).otherwise(at(clip(c("r"))))
    b = F.when(flat, c("x2")).otherwise(at(clip(c("r") + 1)))
    return rows.select("r", _touched(F.least(a, b), F.greatest(a, b)).alias("c")).distinct()


def shift_cells(cells: DataFrame, where: DataFrame, by: float) -> DataFrame:
    """``cells`` with ``by`` added to the valid ones that are in ``where`` (r, c); nothing is added twice."""
    hit = where.select("r", "c").distinct().withColumn("hit", F.lit(True))
    return cells.join(hit, ["r", "c"], "left").withColumn("z", F.when(F.col("hit"), F.col("z") + by).otherwise(F.col("z"))).drop("hit")


def raise_buildings(cells: DataFrame, buildings: DataFrame, by: float = 5.0) -> DataFrame:
    return shift_cells(cells, cells_in_rings(buildings), by)


def burn_streams(cells: DataFrame, segments: DataFrame, depth: float = 10.0) -> DataFrame:
    return shift_cells(cells, cells_on_segments(segments), -depth)


def sample_near(cells: DataFrame, points: DataFrame, reach: int = 3) -> DataFrame:
    """``points`` (qid, r, c) with z of their cell, else of the nearest valid one within ``reach`` cells; the first in row order of equals, null if none."""
    valid = cells.where("z is not null").select("r", "c", "z")
    off = F.sequence(F.lit(-reach), F.lit(reach))
    own = points.join(valid, ["r", "c"], "left")
    looks = own.where("z is null").withColumn("dr", F.explode(off)).withColumn("dc", F.explode(off))
    at = looks.select("qid", "dr", "dc", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    near = at.join(valid, ["r", "c"]).groupBy("qid").agg(F.min_by("z", F.struct(F.expr("dr * dr + dc * dc"), "dr", "dc")).alias("near"))
    return own.join(near, "qid", "left").select("qid", "r", "c", F.coalesce("z", "near").alias("z"))


def fill_nearest(cells: DataFrame) -> DataFrame:
    """Every cell without a value gets the nearest one, however far; the first in row order of equals."""
    at = lambda d: d.select(cell_id(F.col("r"), F.col("c")).alias("id"), F.col("c").alias("x"), F.col("r").alias("y"), "z")
    holes = at(cells.where("z is null")).select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    near = spatial.nearest_points(holes, at(cells.where("z is not null")), 1, []).select("qid", F.col("z").alias("near"))
    keyed = cells.withColumn("qid", cell_id(F.col("r"), F.col("c")))
    return keyed.join(near, "qid", "left").withColumn("z", F.coalesce("z", "near")).drop("qid", "near")


def repair_sinks(flow: DataFrame, cells: DataFrame) -> DataFrame:
    """``flow`` (id, down, r, c) with sinks inside the grid turned to a neighbour, and the rule in column ``how``.

    cells: (r, c, z, acc). The steepest lower neighbour, else the one of the largest acc of 0 or
    more, else any valid one; ties to the first direction. Sinks on the grid's edge and sinks
    without a valid neighbour stay. Only sinks are laid out to their neighbours.
    """
    c = F.col
    box = cells.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    inner = flow.where("down is null").crossJoin(F.broadcast(box)).where("r > r0 and r < r1 and c > c0 and c < c1").select("id", "r", "c")
    own = inner.join(cells.where("z is not null").select("r", "c", c("z").alias("own")), ["r", "c"])
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(DIRECTIONS))))
    looks = own.withColumn("k", around).select("id", "own", "k.*", (c("r") + c("k.dr")).alias("r"), (c("c") + c("k.dc")).alias("c"))
    seen = looks.join(cells.where("z is not null"), ["r", "c"]).withColumn("fall", (c("own") - c("z")) / F.when(c("ord") % 2 == 1, DIAGONAL).otherwise(1.0))
    step = F.struct("dr", "dc")
    best = seen.groupBy("id").agg(
        F.max_by(step, F.when(c("fall") > 0, F.struct("fall", -c("ord")))).alias("steepest"),
        F.max_by(step, F.when(c("acc") >= 0, F.struct("acc", -c("ord")))).alias("max_acc"),
        F.min_by(step, "ord").alias("any_valid"),
    )
    move = F.coalesce("steepest", "max_acc", "any_valid")
    how = F.when(c("steepest").isNotNull(), "steepest").when(c("max_acc").isNotNull(), "max_acc").otherwise("any_valid")
    turned = best.select("id", (c("id") + move["dr"] * F.lit(ROW) + move["dc"]).alias("turned"), how.alias("how"))
    return flow.join(turned, "id", "left").withColumn("down", F.coalesce("down", "turned")).drop("turned")
