import pytest
from pyspark.sql import functions as F
from rillflow.functions import crs, geometry
from rillflow.sources import ascii_grid, tables
from rillflow.streaming import rain as stream

GRID = "NCOLS 3\nnrows 2\nxllcenter 502.5\nyllcenter 302.5\ncellsize 5\nNODATA_value -1\n1 2 3\n4 -1 6.5\n"


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "a.asc").write_text(GRID)
    (tmp_path / "b.asc").write_text("")
    head = ascii_grid.headers(spark, str(tmp_path)).collect()
    assert [(h.ncols, h.nrows, h.x0, h.y0, h.nodata, h.xmax, h.ymax) for h in head] == [(3, 2, 500.0, 300.0, -1.0, 515.0, 310.0)]
    got = {(r.r, r.c): (r.x, r.y, r.z) for r in ascii_grid.read(spark, str(tmp_path)).collect()}
    assert got[0, 0] == (502.5, 307.5, 1.0) and got[1, 1] == (507.5, 302.5, None) and got[1, 2][2] == 6.5 and len(got) == 6
    assert ascii_grid.discover(spark, str(tmp_path), (0, 0, 499, 999)).count() == 0
    assert ascii_grid.compatible(ascii_grid.headers(spark, str(tmp_path))).first().same_zone
    assert ascii_grid.mosaic_info(ascii_grid.headers(spark, str(tmp_path))).first().n_bytes == 24
    (tmp_path / "c.asc").write_text(GRID.replace("4 -1 6.5", "4 -1"))
    with pytest.raises(Exception, match="shape differs"):
        ascii_grid.read(spark, str(tmp_path)).collect()


def test_short_grid_and_nan_rows(spark, tmp_path):
    head = "ncols 2\nnrows {}\nxllcorner 0\nyllcorner 0\ncellsize 1\n"
    (tmp_path / "whole.asc").write_text(head.format(2) + "nan 1\n2 3\n")
    got = {(r.r, r.c): r.z for r in ascii_grid.read(spark, str(tmp_path)).collect()}
    assert got[(0, 1)] == 1 and got[(1, 0)] == 2 and len(got) == 4
    (tmp_path / "whole.asc").write_text(head.format(4) + "0 1\n2 3\n")
    with pytest.raises(Exception, match="shape differs"):
        ascii_grid.read(spark, str(tmp_path)).collect()


def test_projection_round_trip(spark):
    rows = spark.createDataFrame([(19.0, 52.0), (14.2, 49.1), (24.1, 54.9)], "lon double, lat double")
    x, y = crs.to_grid(F.col("lon"), F.col("lat"))
    there = rows.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = crs.to_degrees(F.col("x"), F.col("y"))
    for r in there.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9
    assert there.first().x == pytest.approx(500000.0) and 400_000 < there.first().y < 500_000


def test_geometry(spark):
    square = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))))
    row = spark.range(1).select(geometry.length(square).alias("l"), geometry.ring_area(square).alias("a"), geometry.ring_area(geometry.chaikin(square, 3)).alias("c"), geometry.resample(square, 5).alias("r"), geometry.from_wkt(geometry.to_wkt(square)).alias("w"), geometry.farthest(square, F.lit(0.0), F.lit(0.0)).alias("f")).first()
    assert row.l == 16 and row.a == 16 and 12 < row.c < 16 and row.f == pytest.approx(32**0.5)
    assert [(p.x, p.y) for p in row.r] == [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)] == [(p.x, p.y) for p in row.w]


def test_tables(spark):
    parts = spark.createDataFrame([(1, 0, 10.0), (1, 1, 90.0), (1, 2, 60.0), (2, 0, 5.0), (2, 1, 7.0)], "id long, part int, area double")
    assert sorted((r.id, r.part) for r in tables.drop_small_parts(parts).collect()) == [(1, 1), (1, 2), (2, 1)]
    rows = spark.createDataFrame([(1.0, 1), (0.0, 0), (None, None)], "length_m double, strahler_order int")
    assert tuple(tables.violations(rows, tables.segment_checks()).first()) == (1, 1)
    assert tables.merge_layers({"a": parts, "b": rows}).count() == 8


def test_streamed_upsert(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(([(1, 60, 10, 5, 1), (2, 60, 10, 6, 1)], [(1, 60, 10, 7, 2), (2, 60, 10, 9, 0)])):
        spark.createDataFrame(rows, stream.SCHEMA).write.mode("append").parquet(src)
        stream.upsert_stream(stream.readings(spark, src), out, str(tmp_path / "ck")).awaitTermination()
    got = {r.id: r.mm_x10 for r in spark.read.parquet(f"{out}/v=1").collect()}
    assert got == {1: 7, 2: 6}
