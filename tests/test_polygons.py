"""Polygons from cells, unions and rings, against flood fills, counts of sides and brute force."""

import random

import pytest
from pyspark.sql import functions as F
from rillflow.operators import polygons


def grid_parts(grid):
    """(label, smallest cell) -> cells of each set that sides connect."""
    seen, out = set(), {}
    for cell in sorted(grid):
        if cell in seen:
            continue
        todo, cells = [cell], []
        seen.add(cell)
        while todo:
            r, c = todo.pop()
            cells.append((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n not in seen and grid.get(n) == grid[cell]:
                    seen.add(n)
                    todo.append(n)
        out[grid[cell], cell] = set(cells)
    return out


def area2(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))


def inside(x, y, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                n += 1
    return n % 2 == 1


def plain(ring):
    return [(p["x"], p["y"]) for p in ring]


def check_parts(rows, parts, key="label"):
    """Each row's rings hold exactly the cells of its part: by area, by their centres, and without points on straight ways."""
    assert len(rows) == len(parts)
    left = dict(parts)
    for row in rows:
        shell, holes = plain(row.shell), [plain(h) for h in row.holes]
        found = [k for k, cells in left.items() if k[0] == row[key] and all(inside(c + 0.5, r + 0.5, [shell, *holes]) for r, c in list(cells)[:3])]
        assert len(found) == 1
        cells = left.pop(found[0])
        assert row.area2 == 2 * len(cells) == area2(shell) + sum(area2(h) for h in holes)
        assert area2(shell) > 0 and all(area2(h) < 0 for h in holes)
        assert all(inside(c + 0.5, r + 0.5, [shell, *holes]) for r, c in cells)
        for ring in (shell, *holes):
            assert ring[0] == min(ring) and len(set(ring)) >= len(ring) - 1 - len(ring) // 4
            for o, p, q in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True):
                assert (p[0] - o[0]) * (q[1] - p[1]) != (p[1] - o[1]) * (q[0] - p[0])
        holes_at = [min(h) for h in holes]
        assert holes_at == sorted(holes_at)


def cells_of(spark, grid):
    return spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "r long, c long, label long")


@pytest.mark.parametrize("size", [4])
def test_polygonize_matches_flood_fill(spark, size):
    rng = random.Random(size)
    grid = {(r, c): rng.choice([1, 1, 1, 2]) for r in range(-7, 14) for c in range(-5, 17) if rng.random() > 0.05}
    grid |= {(r + 40, c): 9 if 0 < r < 20 and 0 < c < 20 else 5 for r in range(21) for c in range(21)}
    grid |= {(r + 40, c + 30): 7 for r in range(30) for c in range(30) if (r * c) % 5 or r > 20}
    rows = polygons.polygonize(cells_of(spark, grid), size).collect()
    check_parts(rows, grid_parts(grid))
    assert {(r.label, r.part) for r in rows} == {(k, r * (1 << 31) + c) for k, (r, c) in grid_parts(grid)}


def test_polygonize_of_touching_corners_and_nothing(spark):
    grid = {(0, 0): 1, (1, 1): 1, (2, 0): 1, (2, 1): 1, (2, 2): 1, (0, 1): 2, (1, 0): None}
    rows = polygons.polygonize(cells_of(spark, grid)).collect()
    check_parts(rows, grid_parts({k: v for k, v in grid.items() if v is not None}))
    pocket = {(r, c): 1 for r in range(4) for c in range(4) if (r, c) not in ((1, 1), (2, 2))}
    one = polygons.polygonize(cells_of(spark, pocket)).collect()
    assert len(one) == 1 and len(one[0].holes) == 2  # pockets that touch at a corner stay two holes
    assert polygons.polygonize(cells_of(spark, grid).limit(0)).count() == 0
    assert [r.area2 for r in polygons.outline(cells_of(spark, grid)).orderBy("label").collect()] == [8, 2]


@pytest.mark.parametrize("size", [3])
def test_dissolve_of_labels_with_holes_and_split_sides(spark, size):
    rng = random.Random(3 + size)
    grid = {(r, c): (r // 3) * 5 + (c // 4) + (100 if rng.random() < 0.1 else 0) for r in range(15) for c in range(17)}
    parts = polygons.polygonize(cells_of(spark, grid), 5)
    # rings turned round and with their first point repeated mean the same
    odd = F.col("part") % 2 == 0
    rings = parts.select("label", F.when(odd, F.reverse("shell")).otherwise(F.concat("shell", F.slice("shell", 1, 1))).alias("shell"), F.when(odd, F.col("holes")).otherwise(F.transform("holes", F.reverse)).alias("holes"))
    keyed = rings.withColumn("key", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(4).cast("long")))).where("label % key < 2")
    rows = polygons.dissolve(keyed.select("key", "shell", "holes"), size).collect()
    for k in (2, 3, 4):
        check_parts([r for r in rows if r.key == k], grid_parts({p: k for p, v in grid.items() if v % k < 2}), "key")


def test_dissolve_of_slanted_polygons(spark):
    P = polygons.POINTS
    rows = [
        (1, [(0, 0), (10, 0), (0, 10)], []), (1, [(10, 0), (10, 10), (0, 10), (5, 5)], []),  # a shared slope, split at its middle
        (1, [(50, 50), (60, 50), (55, 60), (50, 50)], []), (2, [(0, 0), (9, 0), (9, 9), (0, 9)], [[(3, 3), (6, 3), (6, 6), (3, 6)]]),
        (2, [(3, 3), (6, 3), (6, 6)], []), (3, [], []), (3, None, None),
    ]
    given = spark.createDataFrame(rows, f"key long, shell {P}, holes array<{P}>")
    got = {(r.key, tuple(plain(r.shell)), tuple(tuple(plain(h)) for h in r.holes), r.area2) for r in polygons.dissolve(given).collect()}
    assert got == {
        (1, ((0, 0), (10, 0), (10, 10), (0, 10)), (), 200), (1, ((50, 50), (60, 50), (55, 60)), (), 100),
        (2, ((0, 0), (9, 0), (9, 9), (0, 9)), (((3, 3), (3, 6), (6, 6)),), 153),
    }
    assert polygons.dissolve(given.limit(0)).count() == 0
