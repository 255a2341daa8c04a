"""Polygons from cells and unions of polygons: shared sides cancel, what is left is chained to rings.

A side is met from both of the areas beside it, once in each direction, so a signed count leaves the
sides between inside and outside. Areas that share a side are one part, and a part has one shell; its other rings are
holes. Rings are chained inside tiles first, which leaves a path for each stretch of a ring in a tile; paths
are joined by pointer doubling. Coordinates are whole numbers here; shells go counter-clockwise, holes clockwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.checkpoint import saved
from rillflow.operators.components import components, stars
from rillflow.operators.raster import ROW

#: Cells, or units of length, on a side of a tile.
TILE = 256
POINTS = "array<struct<x: long, y: long>>"


def _points(xs: list[np.ndarray], ys: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, xs)]).astype(np.int32)
    x, y = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (xs, ys))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))


def _sides(table: pa.Table) -> pa.Table:
    """Sides of one tile's cells (r, c, label) that no cell of the same label shares, with the part (its smallest cell) that they bound."""
    r, c, label = (table.column(k).to_numpy() for k in ("r", "c", "label"))
    r0, c0 = r.min(), c.min()
    shape = (int(r.max() - r0) + 3, int(c.max() - c0) + 3)
    at = np.full(shape, -1, np.int64)
    i, j = r - r0 + 1, c - c0 + 1
    at[i, j] = np.arange(len(r))
    same = lambda di, dj: (n := at[i + di, j + dj]) * 0 + np.where((n >= 0) & (label[n] == label), n, -1)
    east, north = same(0, 1), same(1, 0)
    mine = np.arange(len(r))
    part = stars(np.r_[mine[east >= 0], mine[north >= 0]], np.r_[east[east >= 0], north[north >= 0]], len(r))
    ids = r * ROW + c
    low = np.full(len(r), np.iinfo(np.int64).max)
    np.minimum.at(low, part, ids)
    out = []
    # around a cell, its inside on the left
    for (di, dj), (ay, ax, by, bx) in (((-1, 0), (0, 0, 0, 1)), ((0, 1), (0, 1, 1, 1)), ((1, 0), (1, 1, 1, 0)), ((0, -1), (1, 0, 0, 0))):
        k = np.flatnonzero(same(di, dj) < 0)
        out.append(np.stack([label[k], c[k] + ax, r[k] + ay, c[k] + bx, r[k] + by, low[part[k]]]))
    return pa.Table.from_arrays([pa.array(v) for v in np.concatenate(out, axis=1)], ["key", "ax", "ay", "bx", "by", "part"])


def cell_sides(cells: DataFrame, size: int = TILE) -> DataFrame:
    """(key, ax, ay, bx, by, part) of cells (r, c, label): directed sides, already without those inside a tile."""
    tiles = cells.where("label is not null").select(*(F.col(k).cast("long").alias(k) for k in ("r", "c", "label")))
    by = [F.floor(F.col(k) / size).alias(f"t{k}") for k in ("r", "c")]
    return tiles.groupBy(*by).applyInArrow(_sides, "key long, ax long, ay long, bx long, by long, part long")


def cancel(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sides left after those met in both directions are gone, and (a, b) of parts that shared one."""
    c = F.col
    up = F.struct("ax", "ay") < F.struct("bx", "by")
    low, high = F.when(up, F.struct(c("ax").alias("x"), c("ay").alias("y"))).otherwise(F.struct(c("bx").alias("x"), c("by").alias("y"))), F.when(up, F.struct(c("bx").alias("x"), c("by").alias("y"))).otherwise(F.struct(c("ax").alias("x"), c("ay").alias("y")))
    met = sides.select("key", low.alias("p"), high.alias("q"), F.when(up, 1).otherwise(-1).alias("sign"), "part")
    met = saved(met.groupBy("key", "p", "q").agg(F.sum("sign").alias("sign"), F.min("part").alias("a"), F.max("part").alias("b")))
    ends = lambda s, e: [c(f"{s}.x").alias("ax"), c(f"{s}.y").alias("ay"), c(f"{e}.x").alias("bx"), c(f"{e}.y").alias("by")]
    left = met.where("sign > 0").select("key", *ends("p", "q"), c("a").alias("part")).union(met.where("sign < 0").select("key", *ends("q", "p"), c("a").alias("part")))
    return left, met.where("a <> b").select("a", "b").distinct()


def _paths(table: pa.Table) -> pa.Table:
    """Sides (id, next, ax, ay) of one tile as paths: (id of the first, next after the last, closed, points)."""
    ids, following, ax, ay = (table.column(k).to_numpy() for k in ("id", "next", "ax", "ay"))
    order = np.argsort(ids)
    ids, following, ax, ay = ids[order], following[order], ax[order], ay[order]
    at = np.minimum(np.searchsorted(ids, following), len(ids) - 1)
    to = np.where(ids[at] == following, at, -1)
    inner = np.zeros(len(ids), bool)
    inner[to[to >= 0]] = True
    then, seen = to.tolist(), [False] * len(ids)
    paths, closed = [], []
    for start in (*np.flatnonzero(~inner).tolist(), *range(len(ids))):
        if seen[start]:
            continue
        path, i = [], start
        while i >= 0 and not seen[i]:
            seen[i] = True
            path.append(i)
            i = then[i]
        paths.append(np.array(path))
        closed.append(i >= 0)
    key = table.column("key").to_numpy()[:1]
    columns = [pa.array(np.repeat(key, len(paths))), pa.array(np.repeat(table.column("root").to_numpy()[:1], len(paths))), pa.array([ids[p[0]] for p in paths]), pa.array([following[p[-1]] for p in paths]), pa.array(closed)]
    return pa.Table.from_arrays([*columns, _points([ax[p] for p in paths], [ay[p] for p in paths])], ["key", "root", "id", "next", "closed", "points"])


def _double(nodes: DataFrame, value: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, next, v) after one doubling: v joins the v of the node at ``next``, whose next is taken over."""
    ahead = nodes.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("v").alias("w"))
    return saved(nodes.join(ahead, "next", "left").select("id", F.col("after").alias("next"), value(F.col("v"), F.col("w")).alias("v")))


def join_paths(paths: DataFrame) -> DataFrame:
    """(key, root, ring, points) of paths (key, root, id, next, points) that form cycles.

    Each cycle is named by its smallest id, which pointer doubling finds in log2(paths of a ring) rounds; then it is cut there and paths are ranked.
    """
    nodes = saved(paths.select("id", "next", F.col("id").alias("v")))
    while True:
        new = _double(nodes, F.least)
        if new.join(nodes.select("id", F.col("v").alias("old")), "id").where("v <> old").isEmpty():
            break
        nodes = new
    named = saved(paths.join(nodes.select("id", F.col("v").alias("ring")), "id"))
    line = saved(named.select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("v")))
    while not line.where("next is not null").isEmpty():
        line = _double(line, lambda v, w: v + F.coalesce(w, F.lit(0)))
    ranked = named.join(line.select("id", "v"), "id")
    each = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("at"), "points")))
    return ranked.groupBy("key", "root", "ring").agg(F.flatten(F.transform(each, lambda p: p["points"])).alias("points"))


def chain(sides: DataFrame, size: int = TILE) -> DataFrame:
    """(key, root, ring, points) of directed sides (key, root, ax, ay, bx, by): points without the closing one.

    At a corner that a part touches twice the path turns right, so that what it encloses becomes a hole of its own.
    """
    c = F.col
    sides = saved(sides.withColumn("id", F.monotonically_increasing_id()))
    then = sides.select("key", "root", c("ax").alias("bx"), c("ay").alias("by"), (c("bx") - c("ax")).alias("ux"), (c("by") - c("ay")).alias("uy"), c("id").alias("to"))
    met = sides.join(then, ["key", "root", "bx", "by"])
    dx, dy = c("bx") - c("ax"), c("by") - c("ay")
    turn = F.atan2((dx * c("uy") - dy * c("ux")).cast("double"), (dx * c("ux") + dy * c("uy")).cast("double"))
    linked = met.groupBy("id").agg(F.min_by("to", F.struct(turn, "to")).alias("next"), *(F.first(k).alias(k) for k in ("key", "root", "ax", "ay")))
    tile = [F.floor(c(k) / size).alias(f"t{k}") for k in ("ax", "ay")]
    paths = saved(linked.groupBy("key", "root", *tile).applyInArrow(_paths, f"key long, root long, id long, next long, closed boolean, points {POINTS}"))
    whole = paths.where("closed").select("key", "root", c("id").alias("ring"), "points")
    rest = paths.where("not closed").drop("closed")
    return whole if rest.isEmpty() else whole.union(join_paths(rest))


def twice_area(points: Column) -> Column:
    """Signed, twice the area of a ring without its closing point: whole for whole coordinates."""
    first = F.element_at(points, 1)
    after = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.array(first))
    # about the first point, which keeps products small
    cross = F.zip_with(points, after, lambda p, q: (p["x"] - first["x"]) * (q["y"] - first["y"]) - (q["x"] - first["x"]) * (p["y"] - first["y"]))
    return F.aggregate(cross, F.lit(0).cast("long"), lambda t, v: t + v)


def corners(points: Column) -> Column:
    """A ring without points on a straight way, from its smallest point on."""
    n = F.size(points)
    before = F.concat(F.slice(points, n, F.lit(1)), F.slice(points, F.lit(1), n - 1))
    after = F.concat(F.slice(points, F.lit(2), n - 1), F.slice(points, F.lit(1), F.lit(1)))
    near = F.arrays_zip(before.alias("o"), points.alias("p"), after.alias("q"))
    bends = F.filter(near, lambda t: (t["p"]["x"] - t["o"]["x"]) * (t["q"]["y"] - t["p"]["y"]) != (t["p"]["y"] - t["o"]["y"]) * (t["q"]["x"] - t["p"]["x"]))
    return F.transform(bends, lambda t: t["p"])


def turned(points: Column) -> Column:
    """A ring from its smallest point on."""
    at = F.array_position(points, F.array_min(points)).cast("int")
    return F.concat(F.slice(points, at, F.size(points) - at + 1), F.slice(points, F.lit(1), at - 1))


def merged(sides: DataFrame, size: int = TILE) -> DataFrame:
    """(key, part, shell, holes, area2) of directed sides (key, ax, ay, bx, by, part): one row for each part.

    shell and holes are without their closing points and without points on straight ways; area2 is twice the area.
    Sides that two areas meet in the same direction, which only overlapping ones have, count once.
    """
    c = F.col
    left, shared = cancel(sides)
    roots = components(shared)
    rooted = left.join(roots, c("part") == c("node"), "left").withColumn("root", F.coalesce("root", "part"))
    rings = chain(rooted.select("key", "root", "ax", "ay", "bx", "by"), size).withColumn("points", corners(c("points"))).withColumn("points", turned(c("points")))
    each = rings.withColumn("a", twice_area(c("points")))
    holes = F.array_sort(F.collect_list(F.when(c("a") < 0, c("points"))))
    return each.groupBy("key", c("root").alias("part")).agg(F.max_by("points", "a").alias("shell"), holes.alias("holes"), F.sum("a").alias("area2"))


def polygonize(cells: DataFrame, size: int = TILE) -> DataFrame:
    """(label, part, shell, holes, area2) of cells (r, c, label): a polygon for each set of cells of one label that are
    connected by sides, in units of cells; cell (r, c) spans c to c + 1 in x and r to r + 1 in y. part is the id of its smallest cell."""
    return merged(cell_sides(cells, size), size).withColumnRenamed("key", "label")


def outline(cells: DataFrame) -> DataFrame:
    """The largest polygon of each label, as from ``polygonize``: a catchment's boundary from its cells. Ties go to the smallest cell."""
    each = polygonize(cells)
    best = F.max_by(F.struct("part", "shell", "holes", "area2"), F.struct("area2", -F.col("part")))
    return each.groupBy("label").agg(best.alias("b")).select("label", "b.*")


def ring_sides(polygons: DataFrame, order: bool = False) -> DataFrame:
    """(key, part, ax, ay, bx, by) of polygons (key, part, shell, holes), whose rings may turn either way; with ``order`` ring (0 the shell) and pos, too."""
    c = F.col
    turn = lambda p, left: F.when((twice_area(p) > 0) == F.lit(left), p).otherwise(F.reverse(p))
    rings = F.concat(F.array(turn(c("shell"), True)), F.transform("holes", lambda h: turn(h, False)))
    each = polygons.select("key", "part", F.posexplode(rings).alias("ring", "p"))
    after = F.concat(F.slice("p", F.lit(2), F.size("p") - 1), F.slice("p", 1, 1))
    pairs = each.select("key", "part", "ring", F.posexplode(F.arrays_zip(c("p").alias("a"), after.alias("b"))).alias("pos", "s"))
    return pairs.select("key", "part", *(("ring", "pos") if order else ()), c("s.a.x").alias("ax"), c("s.a.y").alias("ay"), c("s.b.x").alias("bx"), c("s.b.y").alias("by")).where("ax <> bx or ay <> by")


def noded(sides: DataFrame, size: int = TILE, more: tuple[str, ...] = ()) -> DataFrame:
    """``sides`` (key, part, ax, ay, bx, by, more) cut at the end points of the key's other sides that lie on them, so that neighbours share whole sides; with ``more``, nth tells the pieces of a side in order.

    Points meet sides in grid cells of ``size``; long sides pass many cells, so the size should follow their length.
    """
    from rillflow.operators.spatial import segment_cells

    c = F.col
    ends = sides.select("key", c("ax").alias("x"), c("ay").alias("y")).distinct().withColumns({"gx": F.floor(c("x") / size), "gy": F.floor(c("y") / size)})
    whole = saved(sides.withColumn("side", F.monotonically_increasing_id()))
    laid = segment_cells(whole.select("key", "side", c("ax").alias("x1"), c("ay").alias("y1"), c("bx").alias("x2"), c("by").alias("y2")), size)
    across = (c("x2") - c("x1")) * (c("y") - c("y1")) == (c("y2") - c("y1")) * (c("x") - c("x1"))
    along = (c("x") - c("x1")) * (c("x") - c("x2")) + (c("y") - c("y1")) * (c("y") - c("y2"))
    on = laid.join(ends, ["key", "gx", "gy"]).where(across & (along < 0))
    cuts = on.groupBy("side").agg(F.collect_set(F.struct("x", "y")).alias("cuts"))
    a, b = F.struct(c("ax").alias("x"), c("ay").alias("y")), F.struct(c("bx").alias("x"), c("by").alias("y"))
    # points on one side are in order of either coordinate
    inner = F.array_sort(F.coalesce("cuts", F.array().cast(POINTS)))
    way = F.concat(F.array(a), F.when(a < b, inner).otherwise(F.reverse(inner)), F.array(b))
    each = whole.join(cuts, "side", "left").withColumn("way", way)
    steps = F.arrays_zip(F.slice("way", F.lit(1), F.size("way") - 1).alias("a"), F.slice("way", F.lit(2), F.size("way") - 1).alias("b"))
    nth = ["nth"] if more else []
    return each.select("key", "part", *more, F.posexplode(steps).alias("nth", "s")).select("key", "part", *more, *nth, c("s.a.x").alias("ax"), c("s.a.y").alias("ay"), c("s.b.x").alias("bx"), c("s.b.y").alias("by"))


def dissolve(polygons: DataFrame, size: int = TILE) -> DataFrame:
    """(key, part, shell, holes, area2): the union of each key's polygons (key, shell, holes), one row for each part.

    Polygons have whole coordinates (``snapped`` makes them so, which also closes slivers below its step) and must not overlap but
    in the same sides; rings may repeat their first point, turn either way and have points on each other's sides.
    Empty shells are left out; a key without any polygon has no row.
    """
    open_ring = lambda p: F.when(F.element_at(p, 1) == F.element_at(p, -1), F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    given = polygons.where("size(shell) > 2").select("key", open_ring(F.col("shell")).alias("shell"), F.transform(F.coalesce("holes", F.array().cast(f"array<{POINTS}>")), open_ring).alias("holes"))
    given = saved(given.withColumn("part", F.monotonically_increasing_id()))
    return merged(noded(ring_sides(given), size), size)


def snapped(points: Column, step: float = 0.1) -> Column:
    """Points in whole numbers of ``step``."""
    return F.transform(points, lambda p: F.struct(F.round(p["x"] / step).cast("long").alias("x"), F.round(p["y"] / step).cast("long").alias("y")))


def perimeter(shell: Column, holes: Column) -> Column:
    """Length of all rings, which are without their closing points."""
    from rillflow.functions.geometry import length

    closed = lambda p: length(F.concat(p, F.slice(p, 1, 1)))
    return closed(shell) + F.aggregate(F.transform(holes, closed), F.lit(0.0), lambda t, v: t + v)
