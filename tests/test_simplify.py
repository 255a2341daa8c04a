"""Simplified borders: no crossings, shared sides stay shared, points stay within the tolerance."""

import math
import random

import pytest
from rillflow.operators import polygons, simplify

from tests.test_polygons import area2, cells_of, plain


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.dist(p, (a[0] + t * dx, a[1] + t * dy))


def side(o, p, q):
    v = (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    return (v > 0) - (v < 0)


def cross(a, b, s, t):
    """Whether two sides meet elsewhere than in a common end."""
    both = {a, b} & {s, t}
    if both:
        o = both.pop()
        p, q = b if a == o else a, t if s == o else s
        return side(o, p, q) == 0 and (p[0] - o[0]) * (q[0] - o[0]) + (p[1] - o[1]) * (q[1] - o[1]) > 0
    lo = lambda k: max(min(a[k], b[k]), min(s[k], t[k]))
    hi = lambda k: min(max(a[k], b[k]), max(s[k], t[k]))
    return lo(0) <= hi(0) and lo(1) <= hi(1) and side(a, b, s) * side(a, b, t) <= 0 and side(s, t, a) * side(s, t, b) <= 0


def rings_of(row):
    return [plain(row.shell), *(plain(h) for h in row.holes)]


@pytest.mark.parametrize("tolerance", [2.5])
def test_simplified_labels_keep_their_borders(spark, tolerance):
    rng = random.Random(2)
    seeds = [(rng.uniform(0, 40), rng.uniform(0, 40), k) for k in range(14)]
    grid = {(r, c): min(seeds, key=lambda s: (s[0] - r) ** 2 + (s[1] - c) ** 2 + rng.uniform(0, 30))[2] for r in range(40) for c in range(40)}
    # an island, a thin bridge, and two areas that touch in a corner only
    grid |= {(r, c): 50 for r in range(10, 13) for c in range(10, 13)} | {(r, 20): 51 for r in range(5, 35)} | {(30, 30): 52, (31, 31): 52}
    parts = polygons.polygonize(cells_of(spark, grid), 16).selectExpr("1L AS key", "part", "shell", "holes")
    before = {r.part: r for r in parts.collect()}
    after = {r.part: r for r in simplify.simplify(parts, tolerance, 16).collect()}
    assert before.keys() == after.keys()
    sides = {}
    for part, row in after.items():
        rings = rings_of(row)
        assert len(rings) == len(before[part].holes) + 1
        for ring in rings:
            assert len(ring) >= 3
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                assert (a, b) not in sides
                sides[a, b] = part
    once = {tuple(sorted(s)) for s in sides}
    # what isn't shared lies around the whole: its sides enclose all cells but what the tolerance takes
    outer = [(a, b) for a, b in sides if (b, a) not in sides]
    assert abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in outer) - 2 * 1600) <= 2 * 160 * tolerance
    assert sum(area2(r) for row in after.values() for r in rings_of(row)) == sum(a[0] * b[1] - b[0] * a[1] for a, b in outer)
    once = sorted(once)
    for i, (a, b) in enumerate(once):
        for s, t in once[:i]:
            assert not cross(a, b, s, t), (a, b, s, t)
    for part, row in before.items():
        new = [(a, b) for ring in rings_of(after[part]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        for p in (p for ring in rings_of(row) for p in ring):
            assert min(distance(p, a, b) for a, b in new) <= tolerance + 1e-9
    assert sum(len(r) for row in after.values() for r in rings_of(row)) < sum(len(r) for row in before.values() for r in rings_of(row))


def test_simplify_nothing(spark):
    parts = polygons.polygonize(cells_of(spark, {(0, 0): 1}).limit(0)).selectExpr("1L AS key", "part", "shell", "holes")
    assert simplify.simplify(parts, 2.0).count() == 0
