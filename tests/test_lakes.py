"""Water bodies, inner points, hulls and flat zones on small hand-made rows."""

import random

from pyspark.sql import functions as F
from rillflow.operators import hulls, lakes, overlay, stats

P = "array<struct<x: double, y: double>>"


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]


def test_lakes_by_what_their_streams_do(spark):
    rows = [(1, square(0.0, 0.0, 100.0), []), (2, square(135.0, 0.0, 50.0), []), (3, square(1000.0, 0.0, 100.0), []), (4, square(3000.0, 0.0, 100.0), [square(3020.0, 20.0, 60.0)]), (5, square(3040.0, 40.0, 10.0), []), (6, square(5000.0, 0.0, 9.0), [])]
    water = spark.createDataFrame(rows, f"id long, shell {P}, holes array<{P}>")
    streams = [(10, 110.0, 10.0, 500.0, 10.0), (11, 700.0, 50.0, 990.0, 50.0), (12, 1050.0, 50.0, 1400.0, 50.0), (13, 3100.0, 50.0, 3900.0, 50.0), (14, 5035.0, 5.0, 6000.0, 5.0)]
    heights = [(10, 50.0, 40.0), (11, 60.0, 55.0), (12, 55.0, 54.95), (13, 10.0, None)]
    found = {r.id: tuple(r)[1:] for r in lakes.classify(water, spark.createDataFrame(streams, "id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(heights, "id long, z1 double, z2 double")).collect()}
    # 10 leaves 1 and 2, which are one; 11 comes in and 12 hardly falls; 13 has no height; 14 is too far away
    assert found == {1: (1, False, 1, 0), 2: (1, False, 1, 0), 3: (3, True, 2, 0), 4: (4, True, 1, 1), 5: (4, True, 1, 1), 6: (6, True, 0, 0)}


def test_inner_points_lie_inside(spark):
    rng = random.Random(1)
    rows = [(i, [(i * 100 + x, y) for x, y in [(0.0, 0.0), (rng.uniform(40, 90), rng.uniform(0, 20)), (50.0, 90.0), (rng.uniform(0, 30), 60.0)]], []) for i in range(20)]
    rows += [(50, square(0.0, 500.0, 90.0), [square(10.0, 510.0, 70.0)]), (51, None, None)]
    shapes = spark.createDataFrame(rows, f"id long, shell {P}, holes array<{P}>")
    points = lakes.inner_points(shapes)
    held = overlay.points_inside(points.withColumnRenamed("id", "aid"), shapes.withColumnRenamed("id", "bid")).where("aid = bid")
    assert held.count() == points.count() == 21


def test_hulls_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.randrange(20)), float(rng.randrange(20))) for k in range(6) for _ in range(rng.choice([3, 8, 60]))]
    rows += [(10, 1.0, 1.0), (10, 1.0, 1.0), (11, 0.0, 0.0), (11, 2.0, 2.0), (11, 1.0, 1.0), (12, None, 1.0), (13, 4.0, 4.0)]
    got = {r.key: [tuple(p) for p in r.shell] for r in hulls.convex_hulls(spark.createDataFrame(rows, "key long, x double, y double").repartition(5)).collect()}
    assert got[10] == [(1, 1)] and got[11] == [(0, 0), (2, 2)] and 12 not in got and got[13] == [(4, 4)]
    for k in range(6):
        points = {(x, y) for key, x, y in rows if key == k}
        ring = got[k]
        assert ring[0] == min(points)
        for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True):
            cross = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
            assert cross(c) > 0 and all(cross(p) >= 0 for p in points)


def test_curve_of_a_flat_zone(spark):
    cells = spark.createDataFrame([(1, 5), (1, 5), (2, 0), (2, 10), (2, None)], "label long, z long")
    curve = stats.hypsometric_cells(cells, ["label"])
    assert [(r.height, r.fraction) for r in curve.where("label = 1").orderBy("step").collect()] == [(0, 1), (1, 0)]
    assert curve.where(F.col("label") == 2).count() == 21
