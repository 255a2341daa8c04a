"""Rasters as tiles with a halo: filling, drainage over flats and accumulation.

Cells are dealt to square tiles once, with a ring of their neighbours' cells, and stay packed as arrays. A kernel does
all the work inside a tile; between tiles go only border cells:

* filling: a priority flood inside each tile ends in labels, one for each border cell it starts from, and
  in passes between labels. Passes of blocks of tiles are merged by minimum spanning trees that keep what the block's
  border needs, level by level, until one block is left; then water levels go back down the same way.
* flats: distances to the nearest way down are found in each tile and exchanged over borders until none changes.
* accumulation: a tile's flow ends in border cells that drain into another tile; only these form the forest that
  pointer doubling sums up.

Cells are (r, c, z), z null for no data; every cell has one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.checkpoint import saved
from rillflow.operators import forest
from rillflow.operators.raster import DIAGONAL, DIRECTIONS, ROW

#: Cells on a side of a tile, and tiles (or blocks) on a side of a block.
TILE, FAN = 512, 8
#: Ids of cells have room for 2^31 columns, from -HALF on.
HALF = ROW // 2
#: The outside as a label, below the id of every cell, and a cell without a label yet.
OUTSIDE = -(1 << 62)
UNSEEN = OUTSIDE - 1

_TILE = "tr long, tc long, r0 long, c0 long, h int, w int, z binary"


def _id(r, c):
    return r * ROW + c + HALF


def _row(label: str):
    return F.shiftright(label, 31)


def _col(label: str):
    return F.col(label).bitwiseAND(F.lit(ROW - 1)) - HALF


def _place(t: dict, cell: int) -> tuple[int, int]:
    """Where a cell lies in a tile's arrays."""
    return (cell >> 31) - t["r0"] + 1, (cell & (ROW - 1)) - HALF - t["c0"] + 1


def _grid(raw: bytes, h: int, w: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(h, w)


def _shifted(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The values around the inner part of an array with a halo."""
    h, w = a.shape
    return a[1 + dr : h - 1 + dr, 1 + dc : w - 1 + dc]


def _pack(size: int):
    """Cells of one tile and its halo to one row: z with the halo, nan for no data."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tr, tc = (k.as_py() for k in key)
        r, c, z = table.column("r").to_numpy(), table.column("c").to_numpy(), table.column("z").to_numpy()
        own = (r // size == tr) & (c // size == tc)
        if not own.any():
            return pa.Table.from_pylist([], pa.schema([("tr", pa.int64()), ("tc", pa.int64()), ("r0", pa.int64()), ("c0", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("z", pa.binary())]))
        r0, c0, r1, c1 = r[own].min(), c[own].min(), r[own].max(), c[own].max()
        h, w = int(r1 - r0) + 3, int(c1 - c0) + 3
        grid = np.full((h, w), np.nan)
        near = (r >= r0 - 1) & (r <= r1 + 1) & (c >= c0 - 1) & (c <= c1 + 1)
        grid[r[near] - r0 + 1, c[near] - c0 + 1] = z[near]
        return pa.Table.from_pydict({"tr": [tr], "tc": [tc], "r0": [r0], "c0": [c0], "h": pa.array([h], pa.int32()), "w": pa.array([w], pa.int32()), "z": [grid.tobytes()]})

    return run


def tiled(cells: DataFrame, size: int = TILE) -> DataFrame:
    """(tr, tc, r0, c0, h, w, z): one row for each tile with cells that have a value; z is a packed array of h x w doubles with a halo of one cell, whose
    second row and column are r0 and c0. A halo holds only what touches the tile's own cells."""
    c = F.col
    at = lambda k, d: F.floor((c(k) + d) / size)
    valid = cells.where("z is not null and not isnan(cast(z as double))").select(c("r").cast("long").alias("r"), c("c").cast("long").alias("c"), c("z").cast("double").alias("z"))
    to = F.array_distinct(F.array(*(F.struct(at("r", dr).alias("tr"), at("c", dc).alias("tc")) for dr in (0, -1, 1) for dc in (0, -1, 1))))
    dealt = valid.withColumn("t", F.explode(to)).select("t.tr", "t.tc", "r", "c", "z")
    return saved(dealt.groupBy("tr", "tc").applyInArrow(_pack(size), _TILE))


def _flood(z: np.ndarray, r0: int, c0: int, size: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """(water level, label) of the cells of a tile with halo, and the passes {(label, label): level}.

    The flood starts from open cells (label OUTSIDE) and from cells on the tile's border, each of which is its own label
    unless a lower one reaches it first.
    """
    h, w = z.shape
    inner = ~np.isnan(z)
    own = np.zeros_like(inner)
    own[1:-1, 1:-1] = inner[1:-1, 1:-1]
    closed = np.logical_and.reduce([_shifted(inner, dr, dc) for dr, dc in DIRECTIONS])
    border = np.zeros_like(own)
    rows, cols = np.arange(h) + r0 - 1, np.arange(w) + c0 - 1
    border[(rows % size == 0) | (rows % size == size - 1), :] = True
    border[:, (cols % size == 0) | (cols % size == size - 1)] = True
    border &= own
    opened = own.copy()
    opened[1:-1, 1:-1] &= ~closed
    ids = _id(rows[:, None], cols[None, :]).ravel().tolist()
    level, flat_own = z.ravel().tolist(), own.ravel().tolist()
    label = [UNSEEN] * (h * w)
    heap, queued = [], (opened | border).ravel().tolist()
    for i in np.flatnonzero((opened | border).ravel()).tolist():
        heap.append((level[i], i))
    for i in np.flatnonzero(opened.ravel()).tolist():
        label[i] = OUTSIDE
    heapq.heapify(heap)
    steps = [dr * w + dc for dr, dc in DIRECTIONS]
    passes: dict[tuple[int, int], float] = {}
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        at, i = pop(heap)
        mine = label[i]
        if mine == UNSEEN:
            mine = label[i] = ids[i]
        for s in steps:
            j = i + s
            if not flat_own[j]:
                continue
            if not queued[j]:
                queued[j] = True
                label[j] = mine
                if level[j] < at:
                    level[j] = at
                push(heap, (level[j], j))
            else:
                other = label[j]
                if other != mine and other != UNSEEN:
                    key = (mine, other) if mine < other else (other, mine)
                    high = at if at > level[j] else level[j]
                    if high < passes.get(key, float("inf")):
                        passes[key] = high
    return np.array(level).reshape(h, w), np.array(label, np.int64).reshape(h, w), passes


def _flooded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                z = _grid(t["z"], t["h"], t["w"])
                level, label, passes = _flood(z, t["r0"], t["c0"], size)
                rows, cols = np.arange(t["h"]) + t["r0"] - 1, np.arange(t["w"]) + t["c0"] - 1
                edge = np.zeros(z.shape, bool)
                edge[1:-1, 1:-1] = ~np.isnan(z[1:-1, 1:-1])
                edge &= ((rows % size == 0) | (rows % size == size - 1))[:, None] | ((cols % size == 0) | (cols % size == size - 1))[None, :]
                i, j = np.nonzero(edge)
                border = [{"id": int(_id(rows[a], cols[b])), "label": int(label[a, b]), "z": float(z[a, b])} for a, b in zip(i, j, strict=True)]
                found = [{"a": a, "b": b, "level": v} for (a, b), v in passes.items()]
                yield pa.RecordBatch.from_pylist([{**t, "level": level.tobytes(), "label": label.tobytes(), "passes": found, "border": border}], _FLOODED_ARROW)

    return run


_PASSES = "array<struct<a: long, b: long, level: double>>"
_BORDER = "array<struct<id: long, label: long, z: double>>"
_FLOODED = f"{_TILE}, level binary, label binary, passes {_PASSES}, border {_BORDER}"
_FLOODED_ARROW = pa.schema([
    ("tr", pa.int64()), ("tc", pa.int64()), ("r0", pa.int64()), ("c0", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("z", pa.binary()), ("level", pa.binary()), ("label", pa.binary()),
    ("passes", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("level", pa.float64())]))), ("border", pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int64()), ("z", pa.float64())]))),
])


def _around(border: DataFrame, size: int, *more) -> DataFrame:
    """Border cells (id, ...) by the other tiles they touch: (tr, tc, id, more)."""
    c = F.col
    r, k = _row("id"), _col("id")
    at = lambda v, d: F.floor((v + d) / size)
    to = F.array_distinct(F.array(*(F.struct(at(r, dr).alias("tr"), at(k, dc).alias("tc")) for dr, dc in DIRECTIONS)))
    each = border.withColumns({"own_r": F.floor(r / size), "own_c": F.floor(k / size)}).withColumn("t", F.explode(to)).where("t.tr <> own_r or t.tc <> own_c")
    return each.select(c("t.tr").alias("tr"), c("t.tc").alias("tc"), "id", *more)


def spanning(edges: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """A minimum spanning forest: between any two nodes its largest edge is the least there is."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    tree = []
    for level, a, b in sorted(edges):
        p, q = find(a), find(b)
        if p != q:
            up[p] = q
            tree.append((level, a, b))
    return tree


def contracted(tree: list[tuple[float, int, int]], kept: set[int]) -> list[tuple[float, int, int]]:
    """The forest without nodes that are not ``kept`` and have two edges or fewer: largest edges between kept ones stay the same."""
    near: dict[int, dict[int, float]] = {}
    for level, a, b in tree:
        near.setdefault(a, {})[b] = level
        near.setdefault(b, {})[a] = level
    todo = [n for n in near if n not in kept and len(near[n]) <= 2]
    while todo:
        n = todo.pop()
        if n not in near or len(near[n]) > 2:
            continue
        ends = list(near.pop(n).items())
        for m, _ in ends:
            del near[m][n]
        if len(ends) == 2:
            (a, x), (b, y) = ends
            near[a][b] = near[b][a] = max(x, y)
        todo += [m for m, _ in ends if m not in kept and len(near[m]) <= 2]
    return [(level, a, b) for a, ends in near.items() for b, level in ends.items() if a < b]


def _merge(table: pa.Table) -> pa.Table:
    """Passes of one block (kind 0: a, b, level) and labels its border needs (kind 1: a) to its forest (kind 0) and the contracted one (kind 1)."""
    kind, a, b, level = (table.column(k).to_pylist() for k in ("kind", "a", "b", "level"))
    tree = spanning([(v, x, y) for k, x, y, v in zip(kind, a, b, level, strict=True) if k == 0])
    less = contracted(tree, {OUTSIDE, *(x for k, x in zip(kind, a, strict=True) if k == 1)})
    rows = [(0, *e) for e in tree] + [(1, *e) for e in less]
    p = table.column("p").to_pylist()[0]
    return pa.Table.from_pydict({"p": pa.array([p] * len(rows), pa.string()), "kind": pa.array([r[0] for r in rows], pa.int32()), "a": pa.array([r[2] for r in rows], pa.int64()), "b": pa.array([r[3] for r in rows], pa.int64()), "level": pa.array([r[1] for r in rows], pa.float64())})


def _settle(table: pa.Table) -> pa.Table:
    """Levels of all labels of a block's forest (kind 0) from those known (kind 1: a, level): the least way's highest pass."""
    kind, a, b, level = (table.column(k).to_pylist() for k in ("kind", "a", "b", "level"))
    near: dict[int, list[tuple[int, float]]] = {}
    heap = [(float("-inf"), OUTSIDE)]
    for k, x, y, v in zip(kind, a, b, level, strict=True):
        if k == 0:
            near.setdefault(x, []).append((y, v))
            near.setdefault(y, []).append((x, v))
        else:
            heap.append((v, x))
    heapq.heapify(heap)
    done: dict[int, float] = {}
    while heap:
        v, x = heapq.heappop(heap)
        if x in done:
            continue
        done[x] = v
        for y, e in near.get(x, ()):
            if y not in done:
                heapq.heappush(heap, (max(v, e), y))
    rows = [(x, v) for x, v in done.items() if x != OUTSIDE]
    return pa.Table.from_pydict({"a": pa.array([x for x, _ in rows], pa.int64()), "level": pa.array([v for _, v in rows], pa.float64())})


_EDGE = "p string, kind int, a long, b long, level double"


def water_levels(passes: DataFrame, across: DataFrame, tiles: DataFrame, size: int = TILE, fan: int = FAN) -> DataFrame:
    """(label, level): the least height over which each label reaches the outside.

    passes: (a, b, level) inside tiles, across: (a, b, level) between labels of different tiles. Blocks grow by ``fan`` tiles a side each round;
    what a block keeps is in proportion to its border.
    """
    c = F.col
    box = tiles.agg(F.min("tr"), F.max("tr"), F.min("tc"), F.max("tc")).first()
    if box[0] is None:
        return passes.select(c("a").alias("label"), "level")
    # a label is a cell's id, so its block follows from it; the outside is in every block
    part = lambda at, low, width: F.floor((at - low * size) / width).cast("string")
    block = lambda k, width: F.concat_ws(",", part(_row(k), box[0], width), part(_col(k), box[2], width))
    inner, outer, rounds, width = passes, saved(across), [], size
    while True:
        width *= fan
        # the outside has the smallest id and comes first
        laid = inner.withColumn("p", block("b", width))
        joined = outer.withColumns({"p": block("a", width), "q": block("b", width)})
        mine = laid.select("p", F.lit(0).alias("kind"), "a", "b", "level").union(joined.where("p = q").select("p", F.lit(0), "a", "b", "level"))
        left = saved(joined.where("p <> q"))
        ends = left.select("p", c("a").alias("a")).union(left.select("q", "b")).distinct().select("p", F.lit(1).alias("kind"), "a", F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("level"))
        trees = saved(mine.union(ends).groupBy("p").applyInArrow(_merge, _EDGE))
        rounds.append(trees)
        inner, outer = trees.where("kind = 1").select("a", "b", "level"), left.select("a", "b", "level")
        if all((box[i + 1] - box[i] + 1) * size <= width for i in (0, 2)):
            break
    levels = None
    for trees in reversed(rounds):
        rows = trees.where("kind = 0")
        if levels is not None:
            nodes = rows.select("p", "a").union(rows.select("p", "b")).where(c("a") != OUTSIDE).distinct()
            rows = rows.union(nodes.join(levels, "a").select("p", F.lit(1), "a", F.lit(None).cast("long"), "level"))
        levels = saved(rows.groupBy("p").applyInArrow(_settle, "a long, level double"))
    return levels.select(c("a").alias("label"), "level")


def flooded(cells: DataFrame, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Tiles after their own flood, and (label, level) of all labels."""
    c = F.col
    tiles = saved(tiled(cells, size).mapInArrow(_flooded(size), _FLOODED))
    border = tiles.select(F.explode("border").alias("k")).select("k.*")
    passes = tiles.select(F.explode("passes").alias("k")).select("k.*")
    # neighbours across the tiles' borders: each pair once, by half of the directions
    ahead = F.explode(F.array(*((c("id") + dr * ROW + dc).alias("id") for dr, dc in DIRECTIONS[:4])))
    looks = border.select("label", c("z").alias("z0"), ahead.alias("id"))
    met = looks.join(border.select("id", c("label").alias("other"), "z"), "id").where("label <> other").select(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b"), F.greatest("z0", "z").alias("level"))
    across = met.groupBy("a", "b").agg(F.min("level").alias("level"))
    # labels that meet the outside across a border are in its block, and so are those of one tile
    same = c("a") == OUTSIDE
    inside = passes.union(across.where(same))
    return tiles, water_levels(inside, across.where(~same), tiles, size)


def _with_lists(tiles: DataFrame, levels: DataFrame | None, halo: DataFrame) -> DataFrame:
    """Tiles with the levels of their labels and what their halo's cells hold, as lists."""
    c = F.col
    if levels is not None:
        own = tiles.select("tr", "tc", F.explode(F.array_distinct(F.transform("border", lambda b: b["label"]))).alias("label"))
        held = own.join(levels, "label").groupBy("tr", "tc").agg(F.collect_list(F.struct("label", "level")).alias("levels"))
        tiles = tiles.join(held, ["tr", "tc"], "left")
    held = halo.groupBy("tr", "tc").agg(F.collect_list(F.struct(*(c(k) for k in halo.columns if k not in ("tr", "tc")))).alias("halo"))
    return tiles.join(held, ["tr", "tc"], "left")


def _raise(t: dict) -> np.ndarray:
    """Filled heights of a tile with its halo."""
    level, label = _grid(t["level"], t["h"], t["w"]).copy(), _grid(t["label"], t["h"], t["w"], np.int64)
    known = t["levels"] or []
    if known:
        ids = np.array([k["label"] for k in known], np.int64)
        order = np.argsort(ids)
        ids, values = ids[order], np.array([k["level"] for k in known])[order]
        at = np.minimum(np.searchsorted(ids, label), len(ids) - 1)
        level = np.where(ids[at] == label, np.fmax(level, values[at]), level)
    for k in t["halo"] or []:
        i, j = _place(t, k["id"])
        if 0 <= i < t["h"] and 0 <= j < t["w"] and not (0 < i < t["h"] - 1 and 0 < j < t["w"] - 1):
            level[i, j] = k["filled"]
    return level


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*(f for f in _FLOODED_ARROW if f.name in ("tr", "tc", "r0", "c0", "h", "w", "z")), ("filled", pa.binary())])
    for batch in batches:
        for t in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([{**{k: t[k] for k in schema.names if k != "filled"}, "filled": _raise(t).tobytes()}], schema)


def filled_tiles(cells: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles (tr, tc, r0, c0, h, w, z, filled) with halos: the terrain and its water levels."""
    c = F.col
    tiles, levels = flooded(cells, size)
    border = tiles.select(F.explode("border").alias("k")).select("k.*").join(levels, "label", "left").select("id", F.greatest("z", "level").alias("filled"))
    return saved(_with_lists(tiles, levels, _around(border, size, c("filled"))).select("tr", "tc", "r0", "c0", "h", "w", "z", "level", "label", "levels", "halo").mapInArrow(_filled, f"{_TILE}, filled binary"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch.to_pylist():
            i, j = np.nonzero(_own(t))
            z, filled = (_grid(t[k], t["h"], t["w"])[i, j] for k in ("z", "filled"))
            yield pa.RecordBatch.from_arrays([pa.array(i + t["r0"] - 1), pa.array(j + t["c0"] - 1), pa.array(z), pa.array(filled)], ["r", "c", "z", "filled"])


def fill(cells: DataFrame, size: int = TILE) -> DataFrame:
    """(r, c, z, filled) of cells with a value: the least height that water must climb on some way from the cell to an open one."""
    return filled_tiles(cells, size).mapInArrow(_unpacked, "r long, c long, z double, filled double")


def unfilled_tiles(cells: DataFrame, size: int = TILE) -> DataFrame:
    """The same tiles with the terrain itself instead of water levels: its pits stay."""
    return tiled(cells, size).withColumn("filled", F.col("z"))


def _steepest(z: np.ndarray) -> np.ndarray:
    """Direction of steepest descent of the inner cells, -1 without one."""
    inner = z[1:-1, 1:-1]
    best, at = np.zeros(inner.shape), np.full(inner.shape, -1, np.int8)
    for k, (dr, dc) in enumerate(DIRECTIONS):
        fall = (inner - _shifted(z, dr, dc)) / (DIAGONAL if dr and dc else 1.0)
        better = fall > best  # nan is never better
        best, at = np.where(better, fall, best), np.where(better, k, at)
    return at


def _flat(z: np.ndarray, near: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """(direction, distance) of a tile's cells: steepest descent, and in flats the way to the nearest cell with a way down or out.

    near: distances known of halo cells by place. Open cells have direction -1 and distance 0; cells that don't know a way yet have distance -1.
    """
    h, w = z.shape
    way = np.full((h, w), -1, np.int8)
    way[1:-1, 1:-1] = _steepest(z)
    own = np.zeros((h, w), bool)
    own[1:-1, 1:-1] = ~np.isnan(z[1:-1, 1:-1])
    opened = np.zeros((h, w), bool)
    opened[1:-1, 1:-1] = np.logical_or.reduce([np.isnan(_shifted(z, dr, dc)) for dr, dc in DIRECTIONS])
    dist = np.where(own & ((way >= 0) | opened), 0, -1)
    flat = (own & (dist < 0)).ravel()
    if flat.any():
        height, d, on = z.ravel(), dist.ravel().tolist(), flat.tolist()
        steps = [dr * w + dc for dr, dc in DIRECTIONS]
        heap = []
        touching = np.zeros(len(flat), bool)
        for s in steps:
            at = np.flatnonzero(flat) + s
            touching[at[~flat[at]]] = True
        start = {i: 0 for i in np.flatnonzero(touching & (dist.ravel() == 0)).tolist()} | {i * w + j: v for (i, j), v in near.items()}
        for i, v in start.items():
            heap.append((v, i))
        heapq.heapify(heap)
        level = height.tolist()
        while heap:
            v, i = heapq.heappop(heap)
            if on[i] and d[i] != v:
                continue
            for s in steps:
                j = i + s
                if 0 <= j < len(on) and on[j] and level[j] == level[i] and (d[j] < 0 or d[j] > v + 1):
                    d[j] = v + 1
                    heapq.heappush(heap, (v + 1, j))
        dist = np.array(d).reshape(h, w)
        seen = dist.copy()
        for (i, j), v in near.items():
            seen[i, j] = v
        lost = (own & flat.reshape(h, w))[1:-1, 1:-1] & (dist[1:-1, 1:-1] > 0)
        for k, (dr, dc) in reversed(list(enumerate(DIRECTIONS))):
            to = lost & (_shifted(z, dr, dc) == z[1:-1, 1:-1]) & (_shifted(seen, dr, dc) == dist[1:-1, 1:-1] - 1) & (_shifted(seen, dr, dc) >= 0)
            way[1:-1, 1:-1] = np.where(to, k, way[1:-1, 1:-1])
    return way, dist


def _known(t: dict) -> dict[tuple[int, int], int]:
    """Distances of halo cells by place."""
    out = {}
    for k in t["halo"] or []:
        i, j = _place(t, k["id"])
        if 0 <= i < t["h"] and 0 <= j < t["w"] and not (0 < i < t["h"] - 1 and 0 < j < t["w"] - 1):
            out[i, j] = k["dist"]
    return out


def _edge_cells(t: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols = np.arange(1, t["h"] - 1), np.arange(1, t["w"] - 1)
    r, c = rows + t["r0"] - 1, cols + t["c0"] - 1
    edge = ((r % size == 0) | (r % size == size - 1))[:, None] | ((c % size == 0) | (c % size == size - 1))[None, :]
    i, j = np.nonzero(edge)
    return rows[i], cols[j], _id(r[i], c[j])


def _distances(size: int):
    """(id, dist) of the border cells of tiles whose flats may go on over the border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                z = _grid(t["filled"], t["h"], t["w"])
                _, dist = _flat(z, _known(t))
                i, j, ids = _edge_cells(t, size)
                d = dist[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(ids[d >= 0]), pa.array(d[d >= 0].astype(np.int64))], ["id", "dist"])

    return run


def flat_distances(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """(id, dist) of border cells: steps over a flat to its nearest way down. Tiles are looked at again until none changes,
    which takes as many rounds as tiles that a flat's shortest ways pass; a distance is only ever made shorter."""
    c, known = F.col, None
    while True:
        halo = tiles.select("tr", "tc", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("dist")).limit(0) if known is None else _around(known, size, c("dist"))
        new = saved(_with_lists(tiles, None, halo).mapInArrow(_distances(size), "id long, dist long"))
        if known is not None and new.join(known.select("id", c("dist").alias("old")), "id", "left").where("old is null or old <> dist").isEmpty():
            return new
        known = new


_FLOWING = f"{_TILE}, filled binary, way binary, exits array<struct<id: long, down: long, acc: long>>, ends array<struct<id: long, exit: long>>"
_FLOWING_ARROW = pa.schema([
    *(f for f in _FLOODED_ARROW if f.name in ("tr", "tc", "r0", "c0", "h", "w", "z")), ("filled", pa.binary()), ("way", pa.binary()),
    ("exits", pa.list_(pa.struct([("id", pa.int64()), ("down", pa.int64()), ("acc", pa.int64())]))), ("ends", pa.list_(pa.struct([("id", pa.int64()), ("exit", pa.int64())]))),
])


def _order(way: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells from sources on, cell each drains to or -1) of a tile, as flat places; cells that drain into the halo have -2."""
    h, w = own.shape
    step = np.array([dr * w + dc for dr, dc in DIRECTIONS] + [0])
    at = np.flatnonzero(own.ravel())
    to = np.where(way.ravel()[at] >= 0, at + step[way.ravel()[at]], -1)
    down = np.full(h * w, -1)
    down[at] = np.where((to >= 0) & ~own.ravel()[to], -2, to)
    # rounds of cells that have no cell above them left
    above = np.bincount(down[down >= 0], minlength=h * w)
    ready, out = at[above[at] == 0], []
    while len(ready):
        out.append(ready)
        then = down[ready]
        then = then[then >= 0]
        np.subtract.at(above, then, 1)
        ready = np.unique(then[above[then] == 0])
    return np.concatenate(out) if out else np.zeros(0, np.int64), down


def _gather(order: np.ndarray, down: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``start`` summed downstream."""
    acc, to = start.tolist(), down.tolist()
    for i in order.tolist():
        if to[i] >= 0:
            acc[to[i]] += acc[i]
    return np.array(acc, np.int64)


def _own(t: dict) -> np.ndarray:
    own = np.zeros((t["h"], t["w"]), bool)
    own[1:-1, 1:-1] = ~np.isnan(_grid(t["z"], t["h"], t["w"])[1:-1, 1:-1])
    return own


def _flowing(size: int, flats: bool):
    """Tiles with their directions, the border cells that drain into other tiles with what their own tile brings, and for each border cell where its flow leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                z, own = _grid(t["filled"], t["h"], t["w"]), _own(t)
                if flats:
                    way, _ = _flat(z, _known(t))
                else:
                    way = np.full(z.shape, -1, np.int8)
                    way[1:-1, 1:-1] = np.where(own[1:-1, 1:-1], _steepest(z), -1)
                order, down = _order(way, own)
                acc = _gather(order, down, own.ravel().astype(np.int64))
                ids = _id((np.arange(t["h"]) + t["r0"] - 1)[:, None], (np.arange(t["w"]) + t["c0"] - 1)[None, :]).ravel()
                out = np.flatnonzero(down == -2)
                step = np.array([dr * ROW + dc for dr, dc in DIRECTIONS])
                exits = [{"id": int(ids[i]), "down": int(ids[i] + step[way.ravel()[i]]), "acc": int(acc[i])} for i in out]
                # where each cell's flow leaves the tile, from the ends up
                leaves = np.where(down == -2, ids, UNSEEN).tolist()
                to = down.tolist()
                for i in order[::-1].tolist():
                    if to[i] >= 0:
                        leaves[i] = leaves[to[i]]
                i, j, cell = _edge_cells(t, size)
                on = own[i, j]
                ends = [{"id": int(k), "exit": leaves[a * t["w"] + b]} for a, b, k in zip(i[on].tolist(), j[on].tolist(), cell[on].tolist(), strict=True) if leaves[a * t["w"] + b] != UNSEEN]
                yield pa.RecordBatch.from_pylist([{**{k: t[k] for k in ("tr", "tc", "r0", "c0", "h", "w", "z", "filled")}, "way": way.tobytes(), "exits": exits, "ends": ends}], _FLOWING_ARROW)

    return run


_CELLS = "r long, c long, z double, filled double, down_r long, down_c long, acc long"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles and what flows into their border cells, back to cells."""
    for batch in batches:
        for t in batch.to_pylist():
            z, filled, way, own = _grid(t["z"], t["h"], t["w"]), _grid(t["filled"], t["h"], t["w"]), _grid(t["way"], t["h"], t["w"], np.int8), _own(t)
            order, down = _order(way, own)
            start = own.ravel().astype(np.int64)
            for k in t["halo"] or []:
                a, b = _place(t, k["id"])
                start[a * t["w"] + b] += k["flow"]
            acc = _gather(order, down, start)
            i, j = np.nonzero(own)
            r, c, d = i + t["r0"] - 1, j + t["c0"] - 1, way[i, j]
            dr, dc = np.array([x for x, _ in DIRECTIONS] + [0])[d], np.array([y for _, y in DIRECTIONS] + [0])[d]
            none = d < 0
            columns = [pa.array(r), pa.array(c), pa.array(z[i, j]), pa.array(filled[i, j]), pa.array(r + dr, mask=none), pa.array(c + dc, mask=none), pa.array(acc[i * t["w"] + j])]
            yield pa.RecordBatch.from_arrays(columns, ["r", "c", "z", "filled", "down_r", "down_c", "acc"])


def flow(cells: DataFrame, filling: bool = True, drains: DataFrame | None = None, size: int = TILE) -> DataFrame:
    """(r, c, z, filled, down_r, down_c, acc) of cells with a value: water level, the cell each drains to, and how many drain through it, itself included.

    With ``filling`` depressions are filled to their pass, so that every cell drains to an open one (on the grid's edge or beside a cell without a
    value), which has no down unless a neighbour is lower; flats drain by the fewest steps to a way down. Without it, filled is z and pits keep what they get. ``drains`` (r, c)
    are cells taken out as if they had no value: water may leave there. Ties go to the first of E, SE, S, SW, W, NW, N, NE.
    """
    c = F.col
    if drains is not None:
        cells = cells.join(drains.select("r", "c").distinct(), ["r", "c"], "left_anti")
    tiles = filled_tiles(cells, size) if filling else unfilled_tiles(cells, size)
    none = tiles.select("tr", "tc", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("dist")).limit(0)
    halo = _around(flat_distances(tiles, size), size, c("dist")) if filling else none
    moving = saved(_with_lists(tiles, None, halo).select("tr", "tc", "r0", "c0", "h", "w", "z", "filled", "halo").mapInArrow(_flowing(size, filling), _FLOWING))
    exits = moving.select(F.explode("exits").alias("k")).select("k.*")
    ends = moving.select(F.explode("ends").alias("k")).select("k.*")
    nodes = saved(exits.join(ends.select(c("id").alias("down"), "exit"), "down", "left").select("id", "down", "exit", "acc"))
    if nodes.isEmpty():
        flows = none.withColumnRenamed("dist", "flow")
    else:
        total = forest.subtree(nodes.select("id", "acc"), nodes.select("id", c("exit").alias("down")), {"acc": "sum"})
        into = total.join(nodes.select("id", "down"), "id").groupBy(c("down").alias("id")).agg(F.sum("acc").alias("flow"))
        flows = into.select(F.floor(_row("id") / size).alias("tr"), F.floor(_col("id") / size).alias("tc"), "id", "flow")
    return _with_lists(moving.drop("exits", "ends"), None, flows).mapInArrow(_cells, _CELLS)
