"""Raster operators on long-form cells (r, c, z), one row per cell; z is null for no data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.checkpoint import cut
from rillflow.operators import forest
from rillflow.operators.components import components

#: Fixed order in which directions win ties: E, SE, S, SW, W, NW, N, NE.
DIRECTIONS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
DIAGONAL = 1.414
#: Cells of a row that a 64-bit cell id has room for.
ROW = 1 << 31


def cell_id(r: Column, c: Column) -> Column:
    return r * ROW + c


def neighbours(cells: DataFrame) -> DataFrame:
    """(r, c, ord, nz): for each cell position around a valid cell, that cell's value; one shuffle later an aggregate has all eight."""
    around = F.array(*(F.struct((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(i).alias("ord")) for i, (dr, dc) in enumerate(DIRECTIONS)))
    return cells.where("z is not null").select(F.explode(around).alias("to"), F.col("z").alias("nz")).select("to.r", "to.c", "to.ord", "nz")


def fill_holes(cells: DataFrame, passes: int = 3, least: int = 5) -> DataFrame:
    """Cells without a value get the mean of their valid neighbours if there are ``least`` or more; all at once, ``passes`` times."""
    now = cells.select("r", "c", F.col("z").cast("double").alias("z"))
    for _ in range(passes):
        means = neighbours(now).groupBy("r", "c").agg(F.count("*").alias("n"), (F.sum("nz") / F.count("*")).alias("mean"))
        now = cut(now.join(means, ["r", "c"], "left").select("r", "c", F.when(F.col("z").isNull() & (F.col("n") >= least), F.col("mean")).otherwise(F.col("z")).alias("z")))
    return now


def gradients(cells: DataFrame, cell: float) -> DataFrame:
    """(r, c, gx, gy) by Sobel's weights; null where a cell or a neighbour has no value."""
    wx = dict(zip(DIRECTIONS, (2, 1, 0, -1, -2, -1, 0, 1), strict=True))
    wy = dict(zip(DIRECTIONS, (0, 1, 2, 1, 0, -1, -2, -1), strict=True))
    weigh = lambda w: F.sum(F.col("nz") * F.element_at(F.array(*(F.lit(w[d]) for d in DIRECTIONS)), F.col("ord") + 1))
    sums = neighbours(cells).groupBy("r", "c").agg(F.count("*").alias("n"), weigh(wx).alias("sx"), weigh(wy).alias("sy"))
    whole = (F.col("n") == 8) & F.col("z").isNotNull()
    return cells.join(sums, ["r", "c"], "left").select("r", "c", F.when(whole, F.col("sx") / (8 * cell)).alias("gx"), F.when(whole, F.col("sy") / (8 * cell)).alias("gy"))


def slope_aspect(gx: Column, gy: Column) -> dict[str, Column]:
    """Slope in percent, 0 without a gradient; aspect in degrees from 0 to 360, -1 for flat and without one."""
    angle = F.degrees(F.atan2(-gx, gy))
    turned = F.when(angle < 0, angle + 360).otherwise(angle)
    flat = gx.isNull() | ((gx == 0) & (gy == 0))
    return {"slope": F.coalesce(100 * F.sqrt(gx * gx + gy * gy), F.lit(0.0)), "aspect": F.when(flat, -1.0).otherwise(turned)}


def hillshade(gx: Column, gy: Column) -> Column:
    """Light from four sides at 45 degrees, 0 to 1."""
    import math

    steep = F.atan(F.sqrt(gx * gx + gy * gy))
    facing = F.atan2(-gx, gy)
    total = F.lit(0.0)
    for azimuth, weight in ((315, 0.4), (45, 0.2), (135, 0.2), (225, 0.2)):
        light = math.sin(math.radians(45)) * F.cos(steep) + math.cos(math.radians(45)) * F.sin(steep) * F.cos(math.radians(azimuth) - facing)
        total = total + weight * F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0))
    return total


def colour(value: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """Red, green and blue by piecewise linear stops; values beyond them get the end colours."""

    def channel(i: int) -> Column:
        out = F.lit(stops[-1][1][i]).cast("double")
        for (a, x), (b, y) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(value <= b, x[i] + (y[i] - x[i]) * F.greatest(value - a, F.lit(0.0)) / (b - a)).otherwise(out)
        return F.rint(out).cast("int")

    return F.array(*(channel(i) for i in range(3)))


def focal_max(cells: DataFrame, reach: int) -> DataFrame:
    """Largest value in a square around each cell."""
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    spread = cells.where("z is not null").withColumn("dr", F.explode(offsets)).groupBy((F.col("r") + F.col("dr")).alias("r"), "c").agg(F.max("z").alias("z"))
    both = spread.withColumn("dc", F.explode(offsets)).groupBy("r", (F.col("c") + F.col("dc")).alias("c")).agg(F.max("z").alias("focal"))
    return cells.join(both, ["r", "c"], "left")


def twi(acc: Column, cell: float, slope: Column) -> Column:
    """Wetness index: ln(accumulation x cell / tan(slope)), slope in percent, 0.1 at least."""
    return F.log(acc * cell / F.tan(F.atan(F.greatest(slope, F.lit(0.1)) / 100)))


def steepest(cells: DataFrame) -> DataFrame:
    """(id, down, r, c, z) of each valid cell: the neighbour of steepest descent, null for a sink; ties to the first direction."""
    distance = F.when(F.col("ord") % 2 == 1, DIAGONAL).otherwise(1.0)
    drops = neighbours(cells).join(cells.where("z is not null"), ["r", "c"]).where("z > nz").withColumn("fall", (F.col("z") - F.col("nz")) / distance)
    best = drops.groupBy("r", "c").agg(F.max_by("ord", F.struct("fall", -F.col("ord"))).alias("ord"))
    pick = lambda k: F.element_at(F.array(*(F.lit(d[k]) for d in DIRECTIONS)), F.col("ord") + 1)
    joined = cells.where("z is not null").join(best, ["r", "c"], "left")
    down = F.when(F.col("ord").isNotNull(), cell_id(F.col("r") + pick(0), F.col("c") + pick(1)))
    return joined.select(cell_id(F.col("r"), F.col("c")).alias("id"), down.alias("down"), "r", "c", "z")


def accumulation(flow: DataFrame) -> DataFrame:
    """(id, acc): cells that drain through each cell, itself included."""
    return forest.subtree(flow.select("id", F.lit(1).cast("long").alias("acc")), flow.select("id", "down"), {"acc": "sum"})


def headwaters(flow: DataFrame, streams: DataFrame) -> DataFrame:
    """(id, n_up, head) of stream cells (id): how many stream cells flow in; a head has none."""
    inner = flow.join(streams, "id").join(streams.withColumnRenamed("id", "down"), "down").groupBy(F.col("down").alias("id")).agg(F.count("*").alias("n_up"))
    return streams.join(inner, "id", "left").select("id", F.coalesce("n_up", F.lit(0).cast("long")).alias("n_up"), F.col("n_up").isNull().alias("head"))


def stream_segments(flow: DataFrame, streams: DataFrame, order: DataFrame) -> DataFrame:
    """(id, segment): stream cells by the first cell of their segment, which ends where the order changes or streams meet.

    The head of a segment is found upstream by pointer doubling over links inside segments.
    """
    ups = headwaters(flow, streams)
    ordered = streams.join(order, "id")
    link = flow.join(ordered, "id").select("id", "down", "strahler_order")
    below = ordered.join(ups, "id").select(F.col("id").alias("down"), F.col("strahler_order").alias("next"), F.col("n_up"))
    inside = link.join(below, "down").where("next = strahler_order and n_up <= 1").select(F.col("down").alias("id"), F.col("id").alias("down"))
    # turned around: each cell points to the one before it, and the head has no pointer
    starts = cut(streams.join(inside.select("id"), "id", "left_anti"))
    marked = streams.join(inside, "id", "left").join(starts.withColumn("stop", F.lit(True)), "id", "left").select("id", "down", F.coalesce("stop", F.lit(False)).alias("stop"))
    return forest.first_downstream(marked).select("id", F.col("label").alias("segment"))


def depressions(cells: DataFrame, least: float, cell_area: float) -> DataFrame:
    """(component, n_cells, volume, area, max_depth, mean_depth) of 4-connected cells (r, c, depth) at least ``least`` deep."""
    wet = cut(cells.where(F.col("depth") >= least).select(cell_id(F.col("r"), F.col("c")).alias("id"), "depth"))
    edges = [wet.select("id", (F.col("id") + step).alias("other")).join(wet.select(F.col("id").alias("other")), "other").select(F.col("id").alias("a"), F.col("other").alias("b")) for step in (1, ROW)]
    roots = components(edges[0].union(edges[1]))
    joined = wet.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("root", "id"))
    return joined.groupBy("component").agg(F.count("*").alias("n_cells"), (F.sum("depth") * cell_area).alias("volume"), (F.count("*") * cell_area).alias("area"), F.max("depth").alias("max_depth"), (F.sum("depth") / F.count("*")).alias("mean_depth"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """(r, c, z) of tiles (tile, r, c, z): the value of the first tile that has one."""
    return tiles.groupBy("r", "c").agg(F.min_by("z", F.when(F.col("z").isNotNull(), F.col("tile"))).alias("z"))


def resample_mean(cells: DataFrame, factor: int) -> DataFrame:
    """Mean of blocks of factor x factor cells, over those that have a value."""
    return cells.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg("z").alias("z"))


def resample_bilinear(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (id, rr, cc in cell units) with z from the four cells around; null if one of them has none."""
    base = targets.withColumns({"r0": F.floor("rr"), "c0": F.floor("cc")})
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    fr, fc = F.col("rr") - F.col("r0"), F.col("cc") - F.col("c0")
    weight = F.when(F.col("k.a") == 1, fr).otherwise(1 - fr) * F.when(F.col("k.b") == 1, fc).otherwise(1 - fc)
    each = base.withColumn("k", corner).withColumn("weight", weight).where("weight > 0").withColumns({"r": F.col("r0") + F.col("k.a"), "c": F.col("c0") + F.col("k.b")})
    sums = each.join(cells, ["r", "c"], "left").groupBy("id").agg(F.sum(F.col("weight") * F.col("z")).alias("z"), F.count_if(F.col("z").isNull()).alias("lost"))
    return sums.select("id", F.when(F.col("lost") == 0, F.col("z")).alias("z"))


def sample(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (r, c) with z of their cell; 0 and ``missing`` where there is no value."""
    return points.join(cells.select("r", "c", "z"), ["r", "c"], "left").withColumns({"missing": F.col("z").isNull(), "z": F.coalesce("z", F.lit(0))})


def nearest_fill(cells: DataFrame, reach: int = 3) -> DataFrame:
    """Cells without a value get the nearest within ``reach`` cells, the first in row order of equals."""
    holes = cells.where("z is null").select("r", "c")
    off = F.sequence(F.lit(-reach), F.lit(reach))
    looks = holes.withColumn("dr", F.explode(off)).withColumn("dc", F.explode(off)).withColumns({"nr": F.col("r") + F.col("dr"), "nc": F.col("c") + F.col("dc")})
    found = looks.join(cells.where("z is not null").select(F.col("r").alias("nr"), F.col("c").alias("nc"), "z"), ["nr", "nc"]).groupBy("r", "c").agg(F.min_by("z", F.struct(F.expr("dr * dr + dc * dc"), "dr", "dc")).alias("near"))
    return cells.join(found, ["r", "c"], "left").select("r", "c", F.coalesce("z", "near").alias("z"))
