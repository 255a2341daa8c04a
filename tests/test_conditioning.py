"""Conditioning of cells by hand-made cases."""

from rillflow.functions import sheets
from rillflow.operators import conditioning, landcover, spatial
from rillflow.operators.raster import cell_id
from pyspark.sql import functions as F


def _grid(spark, rows):
    return spark.createDataFrame([(r, c, None if z is None else float(z)) for r, row in enumerate(rows) for c, z in enumerate(row)], "r long, c long, z double")


def _map(df):
    return {(r.r, r.c): r.z for r in df.collect()}


def test_buildings_raise_cells_with_their_centre_inside_once(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(square,), (square,)], "ring array<struct<x: double, y: double>>")
    assert _map(conditioning.raise_buildings(_grid(spark, [[1, None, 1], [1, 1, 1]]), rings)) == {(0, 0): 6.0, (0, 1): None, (0, 2): 1.0, (1, 0): 1.0, (1, 1): 1.0, (1, 2): 1.0}


def test_streams_burn_every_cell_they_touch(spark):
    line = spark.createDataFrame([(0.5, 0.5, 2.5, 1.5), (0.2, 2.5, 0.8, 2.5)], "x1 double, y1 double, x2 double, y2 double")
    burnt = _map(conditioning.burn_streams(_grid(spark, [[0] * 3] * 3), line))
    assert {k for k, z in burnt.items() if z == -10.0} == {(0, 0), (0, 1), (1, 1), (1, 2), (2, 0)}


def test_samples_look_three_cells_around(spark):
    cells = _grid(spark, [[7, None, None, None, None, None, 9]])
    points = spark.createDataFrame([(1, 0, 0), (2, 0, 3), (3, 0, 4), (4, 50, 50)], "qid long, r long, c long")
    assert {r.qid: r.z for r in conditioning.sample_near(cells, points).collect()} == {1: 7.0, 2: 7.0, 3: 9.0, 4: None}


def test_nearest_fill_has_no_reach(spark):
    cells = _grid(spark, [[3] + [None] * 40])
    assert set(_map(conditioning.fill_nearest(cells)).values()) == {3.0}
    assert set(_map(conditioning.fill_nearest(_grid(spark, [[None, None]]))).values()) <= {None}


def test_sinks_turn_by_fall_then_accumulation_then_any(spark):
    def run(rows, acc):
        cells = _grid(spark, rows).withColumn("acc", F.lit(acc).cast("long") + F.col("c"))
        flow = cells.where("z is not null").select(cell_id(F.col("r"), F.col("c")).alias("id"), F.lit(None).cast("long").alias("down"), "r", "c")
        return {(r.r, r.c): (r.down, r.how) for r in conditioning.repair_sinks(flow, cells).collect() if r.how}

    row = 1 << 31
    assert run([[9, 9, 9], [9, 5, 9], [9, 4, 9]], 0) == {(1, 1): (2 * row + 1, "steepest")}
    assert run([[9, 9, 9], [9, 5, 9], [9, 9, 9]], 0) == {(1, 1): (row + 2, "max_acc")}
    assert run([[9, 9, 9], [9, 5, None], [9, 9, 9]], -9) == {(1, 1): (2 * row + 2, "any_valid")}
    assert run([[None] * 3, [None, 5, None], [None] * 3], 0) == {}


def test_lengths_inside_a_box(spark):
    lines = spark.createDataFrame([(1, -5, 5, 15, 5), (2, 5, 0, 5, 10), (3, 20, 0, 20, 9), (4, -3, 0, 0, -3)], "id long, x1 long, y1 long, x2 long, y2 long")
    box = spark.createDataFrame([(0, 0, 10, 10)], "bx0 long, by0 long, bw long, bh long")
    assert {r.id: r.inside for r in spatial.segments_in_rects(lines, box, 4).collect()} == {1: 10.0, 2: 10.0}


def test_breakdown_counts_unknown_imperviousness_as_none(spark):
    rows = spark.createDataFrame([(1, "a", 120, None, 300.0), (1, "b", 60, 0.5, 100.0), (2, "c", 50, 0.1, 0.0)], "k int, category string, cn int, imperviousness double, area double")
    found = {r.rank: r for r in landcover.breakdown(rows, ["k"]).collect()}
    assert set(found) == {1, 2} and found[1].pct == 75.0 and found[1].weighted_cn == 105 and found[2].weighted_imperviousness == 0.125


def test_neighbours_of_a_sheet(spark):
    code = spark.createDataFrame([("N-34-131-C-c-2-2",)], "code string")
    assert sheets.neighbour_sheets(code, "1:10000").count() == 8
    assert sheets.neighbour_sheets(code, "1:10000", corners=False).count() == 4
