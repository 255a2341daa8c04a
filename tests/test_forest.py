"""The small forest of four catchments: 1 and 2 flow to 3, 3 to 4."""

import functools

import pytest
from pyspark.sql import functions as F
from rillflow.operators import forest, stats, streams


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, 3, 5, 150, 200, 175, 5, 2000, 1), (2, 3, 3, 160, 210, 185, 6, 1500, 1), (3, 4, 8, 140, 195, 168, 4, 3000, 2), (4, None, 10, 120, 180, 150, 3, 4000, 3)]
    return spark.createDataFrame(rows, "id long, down long, area long, low long, high long, mean long, slope long, length long, strahler long").cache()


def test_closure(spark, nodes):
    got = {(r.start, r.id) for r in forest.closure(nodes.select("id", "down"), spark.createDataFrame([(4,), (3,)], "id long")).collect()}
    assert got == {(4, 1), (4, 2), (4, 3), (4, 4), (3, 1), (3, 2), (3, 3)}


def test_roll_up(nodes):
    c = F.col
    parts = stats.roll_up_parts(nodes, c("area"), c("low"), c("high"), c("mean"), c("slope"), c("length"), c("strahler"))
    edges = nodes.select("id", "down")
    all_nodes = {r.id: r for r in forest.subtree(parts, edges, stats.PARTS).collect()}
    assert (all_nodes[4].area, all_nodes[4].low, all_nodes[4].high, all_nodes[4].length, all_nodes[4].n) == (26, 120, 210, 10500, 4)
    assert all_nodes[3].area == 16 and all_nodes[1].area == 5


def test_main_channel_prefers_the_longer_tributary(spark, nodes):
    order = [F.col("strahler"), F.coalesce("length", F.lit(0)), F.col("area")]
    best = forest.best_children(nodes.drop("down"), nodes.select("id", "down").where("down is not null"), order)
    path = forest.closure(best, spark.createDataFrame([(4,)], "id long")).join(nodes, "id")
    assert path.agg(F.sum("length")).first()[0] == 9000


def test_to_confluence_stops_at_the_second_confluence(spark):
    # 7 <- 6 <- (4, 5); 4 <- (1, 2); 5 <- 3
    edges = spark.createDataFrame([(1, 4), (2, 4), (3, 5), (4, 6), (5, 6), (6, 7)], "id long, down long")
    got = {r.id for r in forest.to_confluence(edges, spark.createDataFrame([(7,)], "id long")).collect()}
    assert got == {7, 6}
    got = {r.id for r in forest.to_confluence(edges, spark.createDataFrame([(6,)], "id long")).collect()}
    assert got == {6, 4, 5, 3}


def test_strahler(spark):
    edges = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 6), (5, 7), (6, 7), (7, 8)], "id long, down long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    assert {r.id: r.strahler_order for r in forest.strahler(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3, 8: 3}


def test_cycle_is_an_error(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "id long, down long")
    with pytest.raises(ValueError):
        forest.closure(edges, spark.createDataFrame([(1,)], "id long"))
    nodes = spark.createDataFrame([(1, 2, False), (2, 1, False), (3, None, True)], "id long, down long, stop boolean")
    with pytest.raises(ValueError):
        forest.first_downstream(nodes)


def test_first_downstream(spark):
    rows = [(1, 2, False), (2, 3, False), (3, None, True), (4, 5, False), (5, None, False), (6, 3, False)]
    got = {r.id: r.label for r in forest.first_downstream(spark.createDataFrame(rows, "id long, down long, stop boolean")).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: None, 5: None, 6: 3}


def test_threshold_choice(spark):
    counts = spark.createDataFrame([(1, 1000, 600), (1, 10000, 50), (1, 100000, 5), (2, 1000, 9), (3, 1000, 900), (3, 10000, 800), (3, 100000, 700)], "id long, threshold int, n long")
    assert {r.id: r.threshold for r in forest.choose_threshold(counts).collect()} == {1: 10000, 2: 1000, 3: 100000}


def test_whole_queries_start_from_every_node(spark, sf_dir):
    from rillflow.plans import watersheds
    from rillflow.plans.adapters import levels, view

    run = {name: q(spark, sf_dir) for name, (q, _) in watersheds.QUERIES.items() if name in ("upstream_closure", "main_channel", "threshold_cascade")}
    ids = {r.id for r in view(spark, sf_dir, "a_catch").select("id").collect()}
    assert {r.start for r in run["upstream_closure"].collect()} == ids
    assert {r.start for r in run["main_channel"].collect()} == ids
    assert {r.id for r in run["threshold_cascade"].collect()} == {r.id for r in levels(spark, sf_dir).select("id").collect()}


def test_strahler_of_long_combs_and_cycles(spark, monkeypatch):
    # a chain of 300 cells with a tributary at every third, and tributaries of those near its end
    down = {i: i + 1 for i in range(300)} | {1000 + i: i for i in range(1, 300, 3)} | {2000 + i: 1000 + i for i in range(200, 300, 3)} | {3000 + i: 1000 + i for i in range(200, 300, 3)} | {5000: None}
    names = set(down) | {d for d in down.values() if d is not None}
    up = {n: [k for k, d in down.items() if d == n] for n in names}

    @functools.cache
    def order(n):
        below = sorted((order(k) for k in up[n]), reverse=True)
        return 1 if not below else below[0] + (below[:2] == [below[0]] * 2)

    edges = spark.createDataFrame([(k, d) for k, d in down.items() if d is not None], "id long, down long")
    nodes = spark.createDataFrame([(n,) for n in names], "id long")
    rows, save = [], streams.saved

    def counted(df):
        out = save(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(forest, "cut", counted)
    monkeypatch.setattr(streams, "saved", counted)
    assert {r["id"]: r["strahler_order"] for r in forest.strahler(edges, nodes).collect()} == {n: order(n) for n in sorted(names, reverse=True)}
    assert sum(rows) < 16 * len(names)  # the whole forest isn't doubled again for each order
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, down long")
    with pytest.raises(ValueError):
        forest.strahler(ring, spark.range(1, 5))
