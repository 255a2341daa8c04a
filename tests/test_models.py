import math

import pytest
from pyspark.sql import functions as F
from rillflow.functions.sheets import sheet_bounds, sheet_code
from rillflow.operators import hydrograph, landcover, rain, raster, spatial


def test_weighted_cn(spark):
    rows = spark.createDataFrame([("a", 60, 600000), ("a", 78, 400000), ("b", 98, 10), ("c", 60, 0)], "k string, cn int, area long")
    assert {r.k: r.cn for r in landcover.weighted_cn(rows, ["k"]).collect()} == {"a": 67, "b": 98, "c": 75}


def test_lookup_defaults(spark):
    rows = spark.createDataFrame([("las", "A"), ("nothing", "D"), ("droga", "Z"), (None, None)], "cover string, hsg string")
    got = {(r.cover, r.hsg): r.cn for r in landcover.lookup_cn(rows, "cover", "hsg").collect()}
    assert got == {("las", "A"): 30, ("nothing", "D"): 85, ("droga", "Z"): 98, (None, None): 70}


def test_hydrograph_keeps_volume(spark):
    basins = spark.createDataFrame([(1, 12.0, 90.0)], "qid long, area_km2 double, tc_min double")
    storms = spark.createDataFrame([(1, 45.0, 12, 75)], "qid long, total double, steps int, cn int")
    rainfall = hydrograph.hyetograph(storms, "beta", ["qid"]).join(storms.select("qid", "cn"), "qid")
    assert rainfall.agg(F.sum("depth")).first()[0] == pytest.approx(45.0)
    excess = hydrograph.effective_rain(rainfall, ["qid"])
    s = 25.4 * (1000 / 75 - 10)
    runoff = (45 - 0.2 * s) ** 2 / (45 + 0.8 * s)
    assert excess.agg(F.sum("excess")).first()[0] == pytest.approx(runoff)
    flow = hydrograph.convolve(excess, hydrograph.unit_hydrograph(basins, ["qid"], 15), ["qid"], ["qid"])
    assert hydrograph.balance(flow, ["qid"], 15).first().volume_m3 == pytest.approx(runoff * 12000)


def test_validators(spark):
    rows = spark.createDataFrame([(60, 10), (45, 10), (60, 3), (None, 1)], "d int, p int")
    assert [r[0] for r in rows.select(rain.valid(F.col("d"), F.col("p"))).collect()] == [True, False, False, False]


def test_upsert_keeps_newest(spark):
    old = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "id long, mm_x10 long, version long")
    new = spark.createDataFrame([(1, 11, 1), (2, 21, 0), (3, None, 5), (4, 40, 1)], "id long, mm_x10 long, version long")
    got = {r.id: r.mm_x10 for r in rain.upsert(old, new, ["id"], "version").collect()}
    assert got == {1: 11, 2: 20, 4: 40}


def test_sheet_codes(spark):
    row = spark.createDataFrame([(52.23, 21.01)], "lat double, lon double")
    code = row.select(sheet_code(F.col("lat"), F.col("lon")).alias("c")).first().c
    assert code == "N-34-139-A-c-1-1"
    b = row.select(sheet_bounds(F.lit(code)).alias("b")).first().b
    assert b.south <= 52.23 <= b.north and b.west <= 21.01 <= b.east
    assert row.select(sheet_code(F.lit(40.0), F.col("lon"))).first()[0] is None


def test_nearest_points_match_brute_force(spark):
    points = [(i, (i * 7919) % 20011, (i * 104729) % 20021) for i in range(60)]
    asks = [(i, (i * 3571) % 40000 - 9000, (i * 6869) % 40000 - 9000) for i in range(25)]
    got = spatial.nearest_points(spark.createDataFrame(asks, "qid long, qx long, qy long"), spark.createDataFrame(points, "id long, x long, y long"), 4, [], 1500)
    expect = {(q, p[0]) for q, x, y in asks for p in sorted(points, key=lambda p: ((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]))[:4]}
    assert {(r.qid, r.id) for r in got.collect()} == expect


def test_point_in_polygon(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0))))
    rows = spark.createDataFrame([(1.0, 1.0), (5.0, 8.0), (9.0, 8.5), (11.0, 1.0)], "x double, y double")
    assert [r[0] for r in rows.select(spatial.polygon_contains(F.col("x"), F.col("y"), ring)).collect()] == [True, False, True, False]


def test_depression_components(spark):
    cells = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (1, 1, 3), (3, 3, 1), (4, 4, 1), (2, 2, 0)], "r long, c long, depth long")
    got = sorted((r.n_cells, r.volume, r.max_depth) for r in raster.depressions(cells, 1, 25).collect())
    assert got == [(1, 25, 1), (1, 25, 1), (3, 150, 3)]


def test_slope_of_a_plane(spark):
    cells = spark.createDataFrame([(r, c, float(100 - 3 * c)) for r in range(5) for c in range(5)], "r long, c long, z double")
    g = raster.gradients(cells, 5.0)
    row = g.where("r = 2 and c = 2").select(*(v.alias(k) for k, v in raster.slope_aspect(F.col("gx"), F.col("gy")).items())).first()
    assert row.slope == pytest.approx(60.0) and row.aspect == pytest.approx(math.degrees(math.atan2(0.6, 0)))
    assert g.where("r = 0").where("gx is not null").count() == 0


def test_stream_segments_end_where_streams_meet(spark):
    # 1 -> 2 -> 5, 3 -> 4 -> 5, 5 -> 6 -> 7
    flow = spark.createDataFrame([(1, 2), (2, 5), (3, 4), (4, 5), (5, 6), (6, 7), (7, None)], "id long, down long")
    streams = flow.select("id")
    order = spark.createDataFrame([(i, 1 if i < 5 else 2) for i in range(1, 8)], "id long, strahler_order long")
    got = {r.id: r.segment for r in raster.stream_segments(flow, streams, order).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 5}
