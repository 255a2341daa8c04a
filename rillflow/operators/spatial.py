"""Spatial joins through a grid: a cell key makes them equi-joins, exact tests follow.

Rectangles are (x0, y0, w, h), points (x, y), segments (x1, y1, x2, y2), in whole metres.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.checkpoint import cut

#: Points, by the cells they look at, that are broadcast at a time.
ASKS = 200_000


def _cells(low_x: Column, high_x: Column, low_y: Column, high_y: Column, size: int) -> Column:
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(low_x, high_x), lambda x: F.transform(span(low_y, high_y), lambda y: F.struct(x.alias("gx"), y.alias("gy")))))


def with_cells(df: DataFrame, low_x: Column, high_x: Column, low_y: Column, high_y: Column, size: int) -> DataFrame:
    """One row per grid cell that the box touches: columns gx, gy are added."""
    return df.withColumn("cell", F.explode(_cells(low_x, high_x, low_y, high_y, size))).withColumns({"gx": F.col("cell.gx"), "gy": F.col("cell.gy")}).drop("cell")


def rect_overlay(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Pairs of rectangles of ``a`` (x0, y0, w, h) and ``b`` (bx0, by0, bw, bh) that share area, with column ``shared``.

    A pair is kept only in the cell that holds the lower-left corner of what it shares, so no
    pair is found twice and nothing is deduplicated.
    """
    c = F.col
    left = with_cells(a, c("x0"), c("x0") + c("w"), c("y0"), c("y0") + c("h"), size)
    right = with_cells(b, c("bx0"), c("bx0") + c("bw"), c("by0"), c("by0") + c("bh"), size)
    lx, ly = F.greatest("x0", "bx0"), F.greatest("y0", "by0")
    hx, hy = F.least(c("x0") + c("w"), c("bx0") + c("bw")), F.least(c("y0") + c("h"), c("by0") + c("bh"))
    pairs = left.join(right, ["gx", "gy"]).where((hx > lx) & (hy > ly) & (c("gx") == F.floor(lx / size)) & (c("gy") == F.floor(ly / size)))
    return pairs.withColumn("shared", (hx - lx) * (hy - ly)).drop("gx", "gy")


def segments_in_rects(segments: DataFrame, rects: DataFrame, size: int) -> DataFrame:
    """Pairs of segments (x1, y1, x2, y2) and rectangles (bx0, by0, bw, bh) that meet along a length, with column ``inside``.

    A pair is kept only in the cell of the lower-left corner of what the two boxes share.
    """
    c = F.col
    low_x, low_y, high_x, high_y = F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")
    left = with_cells(segments, low_x, high_x, low_y, high_y, size)
    right = with_cells(rects, c("bx0"), c("bx0") + c("bw"), c("by0"), c("by0") + c("bh"), size)
    first = (c("gx") == F.floor(F.greatest(low_x, c("bx0")) / size)) & (c("gy") == F.floor(F.greatest(low_y, c("by0")) / size))

    def span(a: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """Shares of the segment where it enters and leaves a strip."""
        p, q = (low - a) / F.nullif(d, F.lit(0)), (high - a) / F.nullif(d, F.lit(0))
        held = (a >= low) & (a <= high)
        return F.when(d == 0, F.when(held, 0.0).otherwise(2.0)).otherwise(F.least(p, q)), F.when(d == 0, 1.0).otherwise(F.greatest(p, q))

    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    (in_x, out_x), (in_y, out_y) = span(c("x1"), dx, c("bx0"), c("bx0") + c("bw")), span(c("y1"), dy, c("by0"), c("by0") + c("bh"))
    share = F.least(out_x, out_y, F.lit(1.0)) - F.greatest(in_x, in_y, F.lit(0.0))
    pairs = left.join(right, ["gx", "gy"]).where(first).drop("gx", "gy").withColumn("share", share).where("share > 0")
    return pairs.withColumn("inside", c("share") * F.sqrt((dx * dx + dy * dy).cast("double"))).drop("share")


def points_in_rects(points: DataFrame, rects: DataFrame, size: int) -> DataFrame:
    """Pairs of points (x, y) and rectangles that hold them; the boundary is outside."""
    c = F.col
    cells = with_cells(rects, c("x0"), c("x0") + c("w"), c("y0"), c("y0") + c("h"), size)
    keyed = points.withColumns({"gx": F.floor(c("x") / size), "gy": F.floor(c("y") / size)})
    inside = (c("x") > c("x0")) & (c("x") < c("x0") + c("w")) & (c("y") > c("y0")) & (c("y") < c("y0") + c("h"))
    return keyed.join(cells, ["gx", "gy"]).where(inside).drop("gx", "gy")


def segment_distance2(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point and a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / length2, F.lit(0.0)), F.lit(1.0)))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return ex * ex + ey * ey


def segment_cells(df: DataFrame, size: int) -> DataFrame:
    """One row per grid cell that the segment passes: strips of x, and in each the y that it spans."""
    c = F.col
    ax, ay, bx, by = (F.when(c("x1") <= c("x2"), c(p)).otherwise(c(q)) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1")))
    ends = df.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by}).withColumn("gx", F.explode(F.sequence(F.floor(c("ax") / size), F.floor(c("bx") / size))))
    at = lambda x: F.when(c("bx") == c("ax"), c("ay").cast("double")).otherwise(c("ay") + (c("by") - c("ay")) * (x - c("ax")) / (c("bx") - c("ax")))
    lo, hi = F.greatest(c("ax"), c("gx") * size), F.least(c("bx"), (c("gx") + 1) * size)
    upright = c("ax") == c("bx")
    y1, y2 = F.when(upright, c("ay").cast("double")).otherwise(at(lo)), F.when(upright, c("by").cast("double")).otherwise(at(hi))
    # a hair of room for rounding at cell borders
    rows = ends.withColumns({"ylo": F.floor((F.least(y1, y2) - 1e-6) / size), "yhi": F.floor((F.greatest(y1, y2) + 1e-6) / size)})
    return rows.withColumn("gy", F.explode(F.sequence("ylo", "yhi"))).drop("ax", "ay", "bx", "by", "ylo", "yhi")


def nearest_segment(points: DataFrame, segments: DataFrame, within: int = 1000) -> DataFrame:
    """(qid, id, distance): each point's nearest segment at most ``within`` away, ties to the smaller id.

    A point looks at every 256th segment first, in its own cell, then in all cells within reach. What it finds there
    bounds the distance, so that it then looks at all segments in the cells that lie within the bound, and in all within reach if
    it found nothing. Cells of segments are many more rows than segments, so they are not shuffled: points are broadcast to them, ``ASKS`` at a time.
    """
    c = F.col
    size = max(1, within // 16, min(within // 2, _cell_of(points, 2)))
    asks, near = points.select("qid", c("x").alias("px"), c("y").alias("py")), float(within * within)
    box = lambda df, r: with_cells(df, c("px") - r, c("px") + r, c("py") - r, c("py") + r, size)

    def best(asks: DataFrame, segments: DataFrame) -> DataFrame:
        """(qid, m) of asks (qid, px, py, gx, gy, most): the nearest of the cells' segments, ``most`` away by its square at most."""
        d2 = segment_distance2(*(c(n) for n in ("px", "py", "x1", "y1", "x2", "y2")))
        parts, cells = 1 + asks.count() // ASKS, segment_cells(segments, size)
        some = (asks.where(F.pmod(F.xxhash64("qid", "gx", "gy"), F.lit(parts)) == k) if parts > 1 else asks for k in range(parts))
        pairs = functools.reduce(DataFrame.union, (cells.join(F.broadcast(a), ["gx", "gy"]).withColumn("d2", d2).where(c("d2") <= c("most")).select("qid", "d2", "id") for a in some))
        return pairs.groupBy("qid").agg(F.min(F.struct("d2", "id")).alias("m"))

    first = cut(asks.withColumn("m", F.lit(None).cast(f"struct<d2: double, id: {segments.schema['id'].dataType.simpleString()}>")))
    for reach in (0, within):
        some = cut(box(first.where("m is null").select("qid", "px", "py", F.lit(near).alias("most")), F.lit(reach)))
        found = best(some, segments.where(F.pmod(F.xxhash64("id"), F.lit(256)) == 0)).withColumnRenamed("m", "new")
        first = cut(first.join(found, "qid", "left").select("qid", "px", "py", F.coalesce("m", "new").alias("m")))
    # one more metre keeps segments as far as the bound
    asked = first.select("qid", "px", "py", F.coalesce("m.d2", F.lit(near)).alias("most"), F.coalesce(F.ceil(F.sqrt("m.d2")) + 1, F.lit(within)).alias("reach"))
    asked = cut(box(asked, c("reach")).drop("reach"))
    return best(asked, segments).select("qid", c("m.id").alias("id"), F.sqrt("m.d2").alias("distance"))


def _cell_of(points: DataFrame, k: int) -> int:
    """A cell that holds about k points, from their number and extent."""
    n, w, h = points.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return max(1, math.ceil(math.sqrt(max(w, 1) * max(h, 1) * k / n))) if n else 1


def nearest_points(asks: DataFrame, points: DataFrame, k: int, by: list[str], size: int | None = None) -> DataFrame:
    """The k nearest ``points`` (id, x, y, by) of each of ``asks`` (qid, qx, qy), for each value of ``by``, with columns d2 and rank.

    Rings of grid cells: an ask is settled once its k-th point lies within the ring's reach;
    those that aren't look twice as far in the next round, up to the extent of all points.
    Cells are ``size`` wide, or hold about k points.
    """
    c = F.col
    size = size or _cell_of(points, k)
    keyed = cut(points.withColumns({"gx": F.floor(c("x") / size), "gy": F.floor(c("y") / size)}))
    box = keyed.agg(F.min("gx"), F.max("gx"), F.min("gy"), F.max("gy")).first()
    if box[0] is None:
        return asks.join(points.withColumn("d2", F.lit(0.0)).withColumn("rank", F.lit(0)), F.lit(False))
    left, ring, done = cut(asks), 1, None
    groups = keyed.select(*by).distinct().count() if by else 1
    while True:
        clip = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
        gx, gy = F.floor(c("qx") / size), F.floor(c("qy") / size)
        span = lambda g, low, high: F.sequence(clip(g - ring, low, high), clip(g + ring, low, high))
        cells = left.withColumn("gx", F.explode(span(gx, box[0], box[1]))).withColumn("gy", F.explode(span(gy, box[2], box[3])))
        d2 = (c("x") - c("qx")) * (c("x") - c("qx")) + (c("y") - c("qy")) * (c("y") - c("qy"))
        pairs = cells.join(keyed, ["gx", "gy"]).drop("gx", "gy").withColumn("d2", d2.cast("double"))
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid", *by).orderBy("d2", "id"))).where(c("rank") <= k)
        reach = float(ring * size) ** 2
        # outside the points' box a ring may be clipped, so only its own reach counts
        full = ranked.where((c("rank") == k) & (c("d2") <= reach)).groupBy("qid").agg(F.count("*").alias("n")).where(c("n") >= groups).select("qid")
        last = ring * size >= 1 << 40 or left.where((gx - ring > box[0]) | (gx + ring < box[1]) | (gy - ring > box[2]) | (gy + ring < box[3])).isEmpty()
        settled = ranked if last else ranked.join(full, "qid", "left_semi")
        settled = cut(settled)
        done = settled if done is None else done.union(settled)
        if last:
            return done
        left = cut(left.join(full, "qid", "left_anti"))
        if left.isEmpty():
            return done
        ring *= 2


def polygon_contains(x: Column, y: Column, ring: Column) -> Column:
    """Ray cast: whether a closed ring (array of struct x, y) holds a point."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(crosses) % 2 == 1
