"""Simplification of polygons that share borders, without gaps, overlaps or crossings.

Where three borders meet is a junction and stays. Between junctions runs an arc, which two polygons share, in opposite
directions; it is simplified in one direction only (Douglas and Peucker's rule), so both keep the same points. Arcs whose new sides
meet other sides elsewhere than in a common end are simplified anew with half the tolerance, in the end not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.checkpoint import saved
from rillflow.operators.polygons import POINTS, TILE, noded, ring_sides
from rillflow.operators.spatial import segment_cells

#: Times that an arc's tolerance is halved before it is left as it is.
HALVINGS = 5

c = F.col


def kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of an open line stay: ends, and what is farther than the tolerance from the line between kept points."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        dx, dy = x[b] - x[a], y[b] - y[a]
        length2 = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length2, 0, 1) if length2 else np.zeros(len(px))
        d = np.hypot(px - t * dx, py - t * dy)
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def _closed(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """The same for a ring without junctions, its last point being its first: three points stay at least."""
    far = int(np.hypot(x - x[0], y - y[0]).argmax())
    keep = np.r_[kept(x[: far + 1], y[: far + 1], tolerance), kept(x[far:], y[far:], tolerance)[1:]]
    if keep[:-1].sum() < 3:
        dx, dy = x[far] - x[0], y[far] - y[0]
        keep[int(np.abs((x - x[0]) * dy - (y - y[0]) * dx).argmax())] = True
    return keep


def arcs_of(points: list[tuple], junction: list[bool]) -> list[tuple[tuple, list[int]]]:
    """(name, places) of a ring's arcs: places in the arc's own direction, both ends included. Its name is its first two points."""
    n = len(points)
    at = [i for i in range(n) if junction[i]]
    if not at:
        i = min(range(n), key=points.__getitem__)
        ring = [(i + k) % n for k in range(n + 1)]
        if points[ring[-2]] < points[ring[1]]:
            ring.reverse()
        return [((*points[ring[0]], *points[ring[1]]), ring)]
    out = []
    for a, b in zip(at, at[1:] + [at[0] + n], strict=True):
        arc = [k % n for k in range(a, b + 1)]
        # by both ends, then by what is next to them: a way round from a junction to itself has equal ends
        if (points[arc[-1]], points[arc[-2]]) < (points[arc[0]], points[arc[1]]):
            arc.reverse()
        out.append(((*points[arc[0]], *points[arc[1]]), arc))
    return out


_ARC = ("x0", "y0", "x1", "y1")
_RING_ARROW = pa.schema([
    ("key", pa.int64()), ("part", pa.int64()), ("ring", pa.int32()), ("points", pa.list_(pa.struct([(k, pa.int64()) for k in "xy"]))), ("arcs", pa.list_(pa.struct([(k, pa.int64()) for k in _ARC]))),
])
_RING = f"key long, part long, ring int, points {POINTS}, arcs array<struct<x0: long, y0: long, x1: long, y1: long>>"


def _simplified(tolerance: float):
    """Rings with the points that stay, and for each of their sides the arc it is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                points, junction = [(p["x"], p["y"]) for p in row["points"]], [p["junction"] for p in row["points"]]
                less = {(h["x0"], h["y0"], h["x1"], h["y1"]): h["times"] for h in row["halved"] or []}
                stay, arc_from = [False] * len(points), {}
                n = len(points)
                for name, arc in arcs_of(points, junction):
                    x, y = (np.array([points[i][k] for i in arc], float) for k in (0, 1))
                    times = less.get(name, 0)
                    limit = 0.0 if times > HALVINGS else tolerance / 2**times
                    # a way round from a junction to itself is a ring, too
                    keep = (_closed if points[arc[0]] == points[arc[-1]] and len(arc) > 3 else kept)(x, y, limit)
                    for i, k in zip(arc, keep, strict=True):
                        stay[i] |= bool(k)
                    forward = (arc[1] - arc[0]) % n == 1 if n > 2 else True
                    for i in arc[:-1] if forward else arc[1:]:
                        arc_from[i] = name
                at = [i for i in range(n) if stay[i]]
                new = {k: row[k] for k in ("key", "part", "ring")} | {"points": [dict(zip("xy", points[i], strict=True)) for i in at], "arcs": [dict(zip(_ARC, arc_from[i], strict=True)) for i in at]}
                yield pa.RecordBatch.from_pylist([new], _RING_ARROW)

    return run


def _side(ox, oy, px, py, qx, qy):
    return F.signum(((px - ox) * (qy - oy) - (py - oy) * (qx - ox)).cast("double"))


def _conflicts(rings: DataFrame, size: int) -> DataFrame:
    """(key, arc) of arcs whose sides meet a side elsewhere than in a common end, or are the same as another's, or leave a ring two points."""
    after = F.concat(F.slice("points", F.lit(2), F.size("points") - 1), F.slice("points", 1, 1))
    each = rings.select("key", F.explode(F.arrays_zip(c("points").alias("a"), after.alias("b"), c("arcs").alias("arc"))).alias("s"))
    up = c("s.a") < c("s.b")
    p, q = F.when(up, c("s.a")).otherwise(c("s.b")), F.when(up, c("s.b")).otherwise(c("s.a"))
    # both neighbours have an arc's sides: once is enough
    sides = saved(each.select("key", p.alias("p"), q.alias("q"), "s.arc").distinct().select("key", "arc", c("p.x").alias("x1"), c("p.y").alias("y1"), c("q.x").alias("x2"), c("q.y").alias("y2")))
    laid = segment_cells(sides, size)
    mine = laid.select("key", "gx", "gy", "arc", *(c(k) for k in ("x1", "y1", "x2", "y2")))
    other = laid.select("key", "gx", "gy", c("arc").alias("arc2"), *(c(k).alias(f"o{k}") for k in ("x1", "y1", "x2", "y2")))
    a, b, s, t = (c("x1"), c("y1")), (c("x2"), c("y2")), (c("ox1"), c("oy1")), (c("ox2"), c("oy2"))
    same = lambda m, n: (m[0] == n[0]) & (m[1] == n[1])
    first = F.struct("x1", "y1", "x2", "y2", "arc") < F.struct("ox1", "oy1", "ox2", "oy2", "arc2")
    boxes = (F.greatest("x1", "x2") >= F.least("ox1", "ox2")) & (F.least("x1", "x2") <= F.greatest("ox1", "ox2")) & (F.greatest("y1", "y2") >= F.least("oy1", "oy2")) & (F.least("y1", "y2") <= F.greatest("oy1", "oy2"))
    cross = (_side(*a, *b, *s) * _side(*a, *b, *t) <= 0) & (_side(*s, *t, *a) * _side(*s, *t, *b) <= 0)
    # with a common end they may only go on in one line, over each other
    shared = same(a, s) | same(a, t) | same(b, s) | same(b, t)
    apex = lambda m, n, o, k: same(m, o) & (_side(*m, *n, *k) == 0) & ((n[0] - m[0]) * (k[0] - m[0]) + (n[1] - m[1]) * (k[1] - m[1]) > 0)
    over = apex(a, b, s, t) | apex(a, b, t, s) | apex(b, a, s, t) | apex(b, a, t, s)
    bad = mine.join(other, ["key", "gx", "gy"]).where(first & boxes & F.when(shared, over).otherwise(cross))
    thin = rings.where("size(points) < 3").select("key", F.explode("arcs").alias("arc"))
    return bad.select("key", F.explode(F.array("arc", "arc2")).alias("arc")).union(thin).distinct()


def simplify(polygons: DataFrame, tolerance: float, size: int = TILE) -> DataFrame:
    """``polygons`` (key, part, shell, holes) with fewer points: no point that goes is farther than ``tolerance`` from its new side.

    Polygons of one key border each other: they may not overlap. Coordinates are whole; rings are without their closing points, shells turn left and holes right.
    """
    sides = saved(noded(ring_sides(polygons, order=True), size, ("ring", "pos")))
    ends = sides.select("key", c("ax").alias("x"), c("ay").alias("y"), c("bx").alias("ox"), c("by").alias("oy")).union(sides.select("key", "bx", "by", "ax", "ay"))
    junctions = ends.groupBy("key", "x", "y").agg((F.size(F.collect_set(F.struct("ox", "oy"))) > 2).alias("junction"))
    placed = sides.withColumnsRenamed({"ax": "x", "ay": "y"}).join(junctions, ["key", "x", "y"])
    rings = placed.groupBy("key", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "nth", "x", "y", "junction"))).alias("l"))
    rings = saved(rings.select("key", "part", "ring", F.transform("l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["junction"].alias("junction"))).alias("points")))
    halved = None
    while True:
        given = rings.withColumn("halved", F.lit(None).cast("array<struct<x0: long, y0: long, x1: long, y1: long, times: int>>"))
        if halved is not None:
            # an arc goes to the rings that have its first side, one way or the other
            on = sides.select("key", "part", "ring", c("ax").alias("x0"), c("ay").alias("y0"), c("bx").alias("x1"), c("by").alias("y1")).union(sides.select("key", "part", "ring", "bx", "by", "ax", "ay"))
            lists = on.join(halved, ["key", "x0", "y0", "x1", "y1"]).groupBy("key", "part", "ring").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "times")).alias("halved"))
            given = rings.join(lists, ["key", "part", "ring"], "left")
        found = saved(given.select("key", "part", "ring", "points", "halved").mapInArrow(_simplified(tolerance), _RING))
        bad = saved(_conflicts(found, size).select("key", "arc.*"))
        if not bad.isEmpty() and halved is not None:
            more = bad.withColumn("more", F.lit(1)).join(halved, ["key", "x0", "y0", "x1", "y1"], "full")
            new = saved(more.select("key", "x0", "y0", "x1", "y1", (F.coalesce("times", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("times")))
        else:
            new = saved(bad.withColumn("times", F.lit(1)))
        # arcs that are left as they are can't be changed any more
        if bad.isEmpty() or bad.join(new.where(c("times") <= HALVINGS + 1), ["key", "x0", "y0", "x1", "y1"], "left_semi").isEmpty():
            break
        halved = new
    back = found.groupBy("key", "part").agg(F.max(F.when(c("ring") == 0, c("points"))).alias("shell"), F.array_sort(F.collect_list(F.when(c("ring") > 0, F.struct("ring", "points")))).alias("h"))
    return back.select("key", "part", "shell", F.transform("h", lambda h: h["points"]).alias("holes"))
