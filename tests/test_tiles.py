"""Tiled filling, flats and accumulation against a priority flood and walks over whole grids."""

import heapq
import random
from collections import deque

import pytest
from rillflow.operators import tiles
from rillflow.operators.raster import DIAGONAL, DIRECTIONS


def neighbours(p):
    return [(p[0] + dr, p[1] + dc) for dr, dc in DIRECTIONS]


def brute_fill(grid):
    opened = {p for p in grid if any(n not in grid for n in neighbours(p))}
    level = {p: grid[p] for p in opened}
    heap = [(z, p) for p, z in level.items()]
    heapq.heapify(heap)
    while heap:
        z, p = heapq.heappop(heap)
        for n in neighbours(p):
            if n in grid and n not in level:
                level[n] = max(z, grid[n])
                heapq.heappush(heap, (level[n], n))
    return level, opened


def brute_flow(level, opened):
    """Steepest descent, then flats by the fewest steps to a cell with a way down or an open one."""
    down = {}
    for p, z in level.items():
        best = None
        for k, n in enumerate(neighbours(p)):
            if n in level and level[n] < z:
                fall = (z - level[n]) / (DIAGONAL if k % 2 else 1.0)
                if best is None or fall > best[0]:
                    best = (fall, n)
        down[p] = best[1] if best else None
    dist = {p: 0 for p in level if down[p] is not None or p in opened}
    todo = deque(sorted(dist))
    while todo:
        p = todo.popleft()
        for n in neighbours(p):
            if n in level and n not in dist and level[n] == level[p]:
                dist[n] = dist[p] + 1
                todo.append(n)
    for p in level:
        if down[p] is None and p not in opened:
            down[p] = next(n for n in neighbours(p) if level.get(n) == level[p] and dist[n] == dist[p] - 1)
    return down


def brute_acc(down):
    acc = dict.fromkeys(down, 0)
    for p in down:
        while p is not None:
            acc[p] += 1
            p = down[p]
    return acc


def check(spark, grid, size, filling=True, drains=()):
    cells = spark.createDataFrame([(r, c, z) for (r, c), z in grid.items()], "r long, c long, z double")
    out = spark.createDataFrame([*drains], "r long, c long") if drains else None
    rows = tiles.flow(cells, filling, out, size).collect()
    valid = {p: z for p, z in grid.items() if z is not None and p not in drains}
    level, opened = brute_fill(valid)
    if not filling:
        level, opened = valid, set(valid)
    down = brute_flow(level, opened)
    acc = brute_acc(down)
    assert len(rows) == len(valid)
    for r in rows:
        p = (r.r, r.c)
        assert (r.z, r.filled) == (valid[p], level[p])
        assert (None if r.down_r is None else (r.down_r, r.down_c)) == down[p]
        assert r.acc == acc[p]


def rough(rng, rows, cols, top, gaps=0.03):
    return {(r, c): None if rng.random() < gaps else float(rng.randrange(top)) for r in range(-3, rows) for c in range(-4, cols)}


@pytest.mark.parametrize(("size", "top"), [(4, 1000), (5, 6)])
def test_flow_matches_whole_grid(spark, size, top):
    check(spark, rough(random.Random(size), 17, 23, top), size)


def test_flow_over_lakes_of_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "FAN", 2)
    grid = {(r, c): 9.0 if 0 < r < 20 and 0 < c < 30 else 20.0 for r in range(21) for c in range(31)}
    grid |= {(r, 15): 19.0 for r in range(1, 20)}  # a sill between two lakes
    grid[0, 3] = 11.0  # the only way out
    grid[10, 20] = 3.0
    check(spark, grid, 4)


def test_flow_with_drains_and_without_filling(spark):
    rng = random.Random(4)
    grid = {(r, c): 50.0 + abs(r - 10) + abs(c - 10) + rng.random() for r in range(21) for c in range(21)}
    check(spark, grid, 6, drains=[(10, 10), (40, 40)])
    check(spark, rough(rng, 12, 14, 30), 5, filling=False)


def test_flow_of_odd_grids(spark):
    check(spark, {(0, 0): 5.0}, 4)
    check(spark, {(0, c): float(c % 3) for c in range(9)} | {(50, 50): 1.0, (51, 51): 0.0}, 4)
    empty = spark.createDataFrame([(0, 0, None)], "r long, c long, z double")
    assert tiles.flow(empty).count() == 0
    assert tiles.fill(empty).count() == 0


def test_fill_gives_the_same_levels(spark):
    grid = rough(random.Random(6), 12, 14, 9)
    cells = spark.createDataFrame([(r, c, z) for (r, c), z in grid.items()], "r long, c long, z double")
    level, _ = brute_fill({p: z for p, z in grid.items() if z is not None})
    assert {(r.r, r.c): r.filled for r in tiles.fill(cells, 5).collect()} == level


def test_forests_keep_largest_edges():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randrange(2, 14)
        edges = [(rng.randrange(9), a, b) for a in range(n) for b in range(a) if rng.random() < 0.5]
        kept = {k for k in range(n) if rng.random() < 0.4}
        less = tiles.contracted(tiles.spanning(edges), kept)

        def widest(edges, a, b):
            for level in range(10):
                seen, todo = {a}, [a]
                while todo:
                    x = todo.pop()
                    for v, p, q in edges:
                        for s, t in ((p, q), (q, p)):
                            if s == x and v <= level and t not in seen:
                                seen.add(t)
                                todo.append(t)
                if b in seen:
                    return level
            return None

        for a in kept:
            for b in kept:
                assert widest(edges, a, b) == widest(less, a, b)
        assert all(len([e for e in less if k in e[1:]]) > 2 for k in {x for e in less for x in e[1:]} - kept)
