import random

from rillflow.operators import spatial


def _distance2(x, y, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    t = 0 if dx == dy == 0 else min(max(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0), 1)
    return (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2


def test_nearest_segments_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    ends = lambda n, far: [(i, x, y, x + rng.randint(-far, far), y + rng.randint(-far, far)) for i in range(n) for x, y in [(rng.randint(0, 6000), rng.randint(0, 6000))]]
    # many in one corner, few elsewhere, and points far from all
    segments = ends(600, 900) + [(1000 + i, x // 10, y // 10, u // 10, v // 10) for i, x, y, u, v in ends(900, 900)]
    asks = [(i, rng.randint(-1500, 8000), rng.randint(-1500, 8000)) for i in range(120)]
    monkeypatch.setattr(spatial, "ASKS", 4000)
    found = spatial.nearest_segment(spark.createDataFrame(asks, "qid long, x long, y long"), spark.createDataFrame(segments, "id long, x1 long, y1 long, x2 long, y2 long"), 700)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(gx" not in plan  # cells of segments stay where they are
    got = {r["qid"]: (r["id"], r["distance"]) for r in found.collect()}
    want = {}
    for q, x, y in asks:
        d, k = min((_distance2(x, y, *s[1:]), s[0]) for s in segments)
        if d <= 700**2:
            want[q] = (k, d**0.5)
    assert {q: k for q, (k, _) in got.items()} == {q: k for q, (k, _) in want.items()}
    assert all(abs(got[q][1] - want[q][1]) < 1e-6 for q in want)
