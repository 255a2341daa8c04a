"""Queries over the terrain raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.checkpoint import saved as cut
from rillflow.functions.num import half_even
from rillflow.functions import crs
from rillflow.operators import polygons, raster, stats, streams, tiles, warp
from rillflow.operators.raster import DIRECTIONS, ROW
from rillflow.plans.adapters import sql, view
from rillflow.plans.shapes import _PARTS_END, _parts_sql

CELL = 5.0
#: Cells that drain through a stream cell, at least.
STREAM = 20


def _cells(spark, sf_dir):
    return view(spark, sf_dir, "a_cells")


def zonal_stats(spark, sf_dir):
    z = stats.zonal(_cells(spark, sf_dir), ["label"])
    return z.withColumn("z_mean", half_even(F.col("z_sum") / F.col("n_valid"), 4))


def zonal_histogram(spark, sf_dir):
    return stats.zonal_histogram(_cells(spark, sf_dir), "label", 100)


def hypsometric_cells(spark, sf_dir):
    curve = stats.hypsometric_cells(_cells(spark, sf_dir), ["label"])
    return curve.select("label", "step", half_even(F.col("height"), 4).alias("height"), half_even(F.col("fraction"), 6).alias("fraction"))


_CURVE = f"""{sql("a_cells")}, v AS MATERIALIZED (SELECT label, z FROM a_cells WHERE z IS NOT NULL), t AS (SELECT label, min(z) AS low, max(z) AS high, count(*) AS total FROM v GROUP BY label),
k AS (SELECT t.label, step, total, low, high FROM t, range(0, 21) AS r(step) WHERE low < high OR step IN (0, 20)),
n AS (SELECT k.label, step, total, count(*) FILTER ((z - low) * 20 >= step * (high - low) AND (low < high OR step = 0)) AS above FROM k JOIN v USING (label) GROUP BY ALL),
curve AS (SELECT label, step::INT AS step, step / 20 AS height, above / total AS fraction FROM n)"""


def hypsometric_integral_trapezoid(spark, sf_dir):
    curve = stats.hypsometric_cells(_cells(spark, sf_dir), ["label"])
    return stats.integral(curve, ["label"]).select("label", half_even(F.col("integral"), 4).alias("integral"))


def elevation_bands(spark, sf_dir):
    curve = stats.hypsometric_cells(_cells(spark, sf_dir), ["label"])
    return stats.elevation_bands(curve, ["label"], 12).select("label", "band", half_even(F.col("share"), 5).alias("share"))


_BANDS = f"""{_CURVE}, p AS (SELECT label, step, height AS h0, fraction AS f0, lead(height) OVER w AS h1, lead(fraction) OVER w AS f1 FROM curve WINDOW w AS (PARTITION BY label ORDER BY step)),
e AS (SELECT label, band, step, f0 + (f1 - f0) * (band / 12 - h0) / (h1 - h0) AS f FROM p, range(0, 13) AS b(band) WHERE h1 IS NOT NULL AND band / 12 >= h0 AND band / 12 <= h1),
g AS (SELECT label, band, arg_min(f, step) AS f FROM e GROUP BY ALL),
s AS (SELECT label, band, greatest(f - lead(f) OVER (PARTITION BY label ORDER BY band), 0.0) AS share, lead(f) OVER (PARTITION BY label ORDER BY band) AS next FROM g)
SELECT label, band::INT AS band, round_even(share * 100000, 0) / 100000 AS share FROM s WHERE next IS NOT NULL"""


def focal_hole_fill(spark, sf_dir):
    filled = raster.fill_holes(_cells(spark, sf_dir))
    return filled.select("r", "c", half_even(F.col("z"), 4).alias("z"))


_D = "d(ord, dr, dc) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(DIRECTIONS)) + ")"


def _fill(source: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.r, a.c, CASE WHEN a.z IS NULL AND m.n >= 5 THEN m.mean ELSE a.z END AS z FROM {source} a LEFT JOIN (SELECT a.r, a.c, count(*) AS n, sum(b.z) / count(*) AS mean FROM {source} a, d JOIN {source} b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NULL AND b.z IS NOT NULL GROUP BY ALL) m ON m.r = a.r AND m.c = a.c)"


_FILL = f"{sql('a_cells')}, {_D}, f0 AS (SELECT r, c, z::DOUBLE AS z FROM a_cells), {_fill('f0', 'f1')}, {_fill('f1', 'f2')}, {_fill('f2', 'f3')} SELECT r, c, round_even(z * 10000, 0) / 10000 AS z FROM f3"


def sobel_slope_aspect(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    g = raster.gradients(cells.withColumn("z", F.col("z") / 100), CELL)
    return g.select("r", "c", *(half_even(v, 3).alias(k) for k, v in raster.slope_aspect(F.col("gx"), F.col("gy")).items()))


_SOBEL = f"""{sql("a_cells")}, {_D}, w(ord, wx, wy) AS (VALUES (0, 2, 0), (1, 1, 1), (2, 0, 2), (3, -1, 1), (4, -2, 0), (5, -1, -1), (6, 0, -2), (7, 1, -1)),
s AS (SELECT a.r, a.c, count(*) AS n, sum(wx * b.z)::BIGINT / 4000 AS gx, sum(wy * b.z)::BIGINT / 4000 AS gy FROM a_cells a, d JOIN w USING (ord) JOIN a_cells b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY ALL),
g AS (SELECT a.r, a.c, CASE WHEN n = 8 THEN gx END AS gx, CASE WHEN n = 8 THEN gy END AS gy FROM a_cells a LEFT JOIN s ON s.r = a.r AND s.c = a.c)
SELECT r, c, coalesce(round_even(100 * sqrt(gx * gx + gy * gy) * 1000, 0) / 1000, 0.0)::DOUBLE AS slope,
  CASE WHEN gx IS NULL OR (gx = 0 AND gy = 0) THEN -1.0::DOUBLE ELSE round_even((CASE WHEN degrees(atan2(-gx, gy)) < 0 THEN degrees(atan2(-gx, gy)) + 360 ELSE degrees(atan2(-gx, gy)) END) * 1000, 0) / 1000 END AS aspect FROM g"""


def _flow(spark, sf_dir):
    return raster.steepest(_cells(spark, sf_dir))


def _rc(df, *columns, key="id"):
    """(r, c) of a cell id."""
    return df.select(F.expr(f"{key} div {ROW}").alias("r"), F.expr(f"{key} % {ROW}").alias("c"), *columns)


def d8_steepest(spark, sf_dir):
    return _flow(spark, sf_dir).select("r", "c", F.expr(f"down div {ROW}").alias("down_r"), F.expr(f"down % {ROW}").alias("down_c"))


_FLOW = f"""{sql("a_cells", recursive=True)}, {_D},
n AS (SELECT a.r, a.c, b.r AS dr, b.c AS dc, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.z - b.z) / CASE WHEN ord % 2 = 1 THEN 1.414::DOUBLE ELSE 1.0::DOUBLE END DESC, ord) AS k
  FROM a_cells a, d JOIN a_cells b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NOT NULL AND b.z IS NOT NULL AND a.z > b.z),
flow AS MATERIALIZED (SELECT a.r, a.c, n.dr AS down_r, n.dc AS down_c, a.r * 1000000 + a.c AS id, n.dr * 1000000 + n.dc AS down FROM a_cells a LEFT JOIN n ON n.r = a.r AND n.c = a.c AND k = 1 WHERE a.z IS NOT NULL)"""
_ACC = f"""{_FLOW}, up(start, id) AS (SELECT id, id FROM flow UNION ALL SELECT f.down, up.id FROM up JOIN flow f ON f.id = up.start WHERE f.down IS NOT NULL),
acc AS MATERIALIZED (SELECT start AS id, count(*) AS acc FROM up GROUP BY start)"""


def flow_accumulation(spark, sf_dir):
    return _drained(spark, sf_dir).select("r", "c", "acc")


def _drained(spark, sf_dir):
    return tiles.flow(_cells(spark, sf_dir), filling=False)


def twi(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    acc = _drained(spark, sf_dir).select("r", "c", "acc")
    slope = raster.gradients(cells.withColumn("z", F.col("z") / 100), CELL).select("r", "c", raster.slope_aspect(F.col("gx"), F.col("gy"))["slope"].alias("slope"))
    joined = acc.join(slope, ["r", "c"])
    return joined.select("r", "c", half_even(raster.twi(F.col("acc"), F.lit(CELL), F.col("slope")), 5).alias("twi"))


_TWI = _SOBEL.replace(sql("a_cells"), _ACC, 1).replace(f", {_D}, w(", ", w(", 1)
_TWI = _TWI[: _TWI.index("SELECT r, c, coalesce")] + "SELECT g.r, g.c, round_even(ln(acc * 5.0::DOUBLE / tan(atan(greatest(coalesce(100 * sqrt(gx * gx + gy * gy), 0), 0.1::DOUBLE) / 100))) * 100000, 0) / 100000 AS twi FROM g JOIN acc ON acc.id = g.r * 1000000 + g.c"


def _streams(spark, sf_dir):
    c = F.col
    flow = cut(_drained(spark, sf_dir).select(raster.cell_id(c("r"), c("c")).alias("id"), raster.cell_id(c("down_r"), c("down_c")).alias("down"), "acc"))
    return flow, cut(flow.where(c("acc") >= STREAM).select("id"))


def headwaters(spark, sf_dir):
    flow, found = _streams(spark, sf_dir)
    return _rc(raster.headwaters(flow.drop("acc"), found), "n_up", "head")


def _order(flow, found):
    from rillflow.operators import forest

    edges = flow.select("id", "down").join(found, "id").join(found.withColumnRenamed("id", "down"), "down").select("id", "down")
    return forest.strahler(edges, found)


def strahler_order(spark, sf_dir):
    return _rc(_order(*_streams(spark, sf_dir)), "strahler_order")


def subcatchment_labels(spark, sf_dir):
    from rillflow.operators import forest

    flow, found = _streams(spark, sf_dir)
    marked = flow.join(found.withColumn("stop", F.lit(True)), "id", "left").select("id", "down", F.coalesce("stop", F.lit(False)).alias("stop"))
    return _rc(forest.first_downstream(marked), F.expr(f"label div {ROW}").alias("label_r"), F.expr(f"label % {ROW}").alias("label_c"))


def _network(spark, sf_dir):
    """(flow, stream cells by segment, lines) of the streams."""
    cells, c = _cells(spark, sf_dir), F.col
    flow, found = _streams(spark, sf_dir)
    g = raster.gradients(cells.withColumn("z", c("z") / 100), CELL)
    slope = g.select(raster.cell_id(c("r"), c("c")).alias("id"), raster.slope_aspect(c("gx"), c("gy"))["slope"].alias("slope"))
    on = cut(streams.segment_cells(flow, _order(flow, found)))
    return flow, on, streams.stream_lines(on, flow.select("id", "acc").join(slope, "id"), CELL)


def _at(id, name):
    return [F.expr(f"{id} div {ROW}").alias(f"{name}_r"), F.expr(f"{id} % {ROW}").alias(f"{name}_c")]


def stream_lines(spark, sf_dir):
    """Streams as lines from heads and junctions on, with the junction's cell at the end."""
    _, _, lines = _network(spark, sf_dir)
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["r"].cast("string"), p["c"].cast("string"))), ",")
    return lines.select(*_at("segment", "head"), "strahler_order", F.size("points").alias("n_points"), half_even(F.col("length"), 1).alias("length"), "acc", half_even(F.col("slope"), 2).alias("slope"), text.alias("line"))


def downstream_links(spark, sf_dir):
    """Each segment by the one that lies a step past its outlet; null if none does."""
    _, _, lines = _network(spark, sf_dir)
    return lines.select(*_at("segment", "head"), *_at("next", "next"))


def subcatchment_polygons(spark, sf_dir):
    """The catchment of each segment: polygons of its cells, heights, and its line's figures."""
    flow, on, lines = _network(spark, sf_dir)
    c = F.col
    label = cut(streams.painted(flow, on, lines).where("segment is not null"))
    cells = _cells(spark, sf_dir).where("z is not null").select(raster.cell_id(c("r"), c("c")).alias("id"), "r", "c", "z").join(label, "id").select("r", "c", c("segment").alias("label"), "z")
    cells = cut(cells)
    rings = polygons.polygonize(cells).withColumn("perimeter", polygons.perimeter(c("shell"), c("holes")))
    parts = rings.groupBy("label").agg(F.count("*").alias("n_parts"), F.sum(F.size("holes")).alias("n_holes"), F.sum("perimeter").cast("long").alias("perimeter"))
    stats_of = cells.groupBy("label").agg(F.count("*").alias("n_cells"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), half_even(F.sum("z") / F.count("*"), 2).alias("z_mean"))
    line = lines.select(c("segment").alias("label"), "strahler_order", half_even(c("length"), 1).alias("length"))
    return parts.join(stats_of, "label").join(line, "label").select(*_at("label", "head"), "n_parts", "n_holes", "perimeter", "n_cells", "z_min", "z_max", "z_mean", "strahler_order", "length")


_ORDER = f"""sm AS MATERIALIZED (SELECT id, acc FROM acc WHERE acc >= {STREAM}),
e AS MATERIALIZED (SELECT f.id, f.down FROM flow f JOIN sm a ON a.id = f.id JOIN sm b ON b.id = f.down),
so(id, o) USING KEY (id) AS (SELECT id, 1::BIGINT FROM sm UNION
  SELECT id, o FROM (SELECT id, was, list_max(l) + (len(list_filter(l, lambda v: v = list_max(l))) > 1)::BIGINT AS o
    FROM (SELECT x.down AS id, any_value(q.o) AS was, list(k.o) AS l FROM (SELECT DISTINCT e.down FROM so JOIN e ON e.id = so.id) x JOIN e ch ON ch.down = x.down JOIN recurring.so k ON k.id = ch.id JOIN recurring.so q ON q.id = x.down GROUP BY x.down)) WHERE o > was),
ord AS MATERIALIZED (SELECT id, o FROM so)"""
_LINES = f"""{_ORDER}, nu AS (SELECT down AS id, count(*) AS n FROM e GROUP BY down),
ins AS MATERIALIZED (SELECT e.id, e.down FROM e JOIN nu ON nu.id = e.down AND n = 1 JOIN ord a ON a.id = e.id JOIN ord b ON b.id = e.down AND b.o = a.o),
walk(head, id, k) AS (SELECT id, id, 1 FROM sm WHERE id NOT IN (SELECT down FROM ins) UNION ALL SELECT head, ins.down, k + 1 FROM walk JOIN ins ON ins.id = walk.id),
own AS MATERIALIZED (SELECT * FROM walk), tip AS (SELECT head, arg_max(own.id, k) AS outlet, max(k) AS k FROM own GROUP BY head),
jn AS MATERIALIZED (SELECT head, outlet, e.down AS jid, k FROM tip LEFT JOIN e ON e.id = outlet),
pts AS MATERIALIZED (SELECT head, id, k FROM own UNION ALL SELECT head, jid, k + 1 FROM jn WHERE jid IS NOT NULL),
ln AS MATERIALIZED (SELECT head, count(*) AS n_points, string_agg((id // 1000000) || ' ' || (id % 1000000), ',' ORDER BY k) AS line, sum(st) * 5 AS length
  FROM (SELECT *, sqrt((pow(id // 1000000 - lag(id // 1000000) OVER w, 2) + pow(id % 1000000 - lag(id % 1000000) OVER w, 2))::DOUBLE) AS st FROM pts WINDOW w AS (PARTITION BY head ORDER BY k)) GROUP BY head HAVING count(*) > 1),
sg AS MATERIALIZED (SELECT own.id, own.head FROM own JOIN ln USING (head)),
nx AS (SELECT ln.head, sg.head AS next FROM ln JOIN jn USING (head) LEFT JOIN sg ON sg.id = jid)"""


def connected_depressions(spark, sf_dir):
    depth = _cells(spark, sf_dir).select("r", "c", F.expr("case when (r * 7 + c * 13 + (r div 3) * (c div 4)) % 5 < 2 then 1 + (r * c) % 9 else 0 end").alias("depth"))
    found = raster.depressions(depth, 1, 25)
    return _rc(found, "n_cells", "volume", "area", "max_depth", half_even(F.col("mean_depth"), 4).alias("mean_depth"), key="component")


_WET = f"""{sql("a_cells", recursive=True)}, wet AS MATERIALIZED (SELECT * FROM (SELECT r, c, r * 1000000 + c AS id, CASE WHEN (r * 7 + c * 13 + (r // 3) * (c // 4)) % 5 < 2 THEN 1 + (r * c) % 9 ELSE 0 END AS depth FROM a_cells) WHERE depth >= 1),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM wet a JOIN wet b ON b.id IN (a.id + 1, a.id - 1, a.id + 1000000, a.id - 1000000)),
reach(id, root) AS (SELECT id, id FROM wet UNION SELECT e.b, root FROM reach JOIN e ON e.a = reach.id WHERE root < e.b),
lab AS (SELECT id, min(root) AS component FROM reach GROUP BY id)
SELECT component // 1000000 AS r, component % 1000000 AS c, count(*) AS n_cells, sum(depth)::BIGINT * 25 AS volume, count(*) * 25 AS area, max(depth) AS max_depth, round_even(sum(depth)::BIGINT / count(*) * 10000, 0) / 10000 AS mean_depth FROM lab JOIN wet USING (id) GROUP BY component"""


def mosaic_first_valid(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    tiles = [cells.where(f"(r div 20) % {k + 1} = 0").select(F.lit(k).alias("tile"), "r", "c", F.expr(f"case when (r + c * {k + 2}) % 7 <> {k} then z + {k} end").alias("z")) for k in range(3)]
    return raster.mosaic(tiles[0].union(tiles[1]).union(tiles[2]))


_MOSAIC = f"{sql('a_cells')}, t AS (" + " UNION ALL ".join(f"SELECT {k} AS tile, r, c, CASE WHEN (r + c * {k + 2}) % 7 <> {k} THEN z + {k} END AS z FROM a_cells WHERE (r // 20) % {k + 1} = 0" for k in range(3)) + ") SELECT r, c, arg_min(z, tile) FILTER (z IS NOT NULL) AS z FROM t GROUP BY r, c"


def raster_resample(spark, sf_dir):
    return raster.resample_mean(_cells(spark, sf_dir), 4).select("r", "c", half_even(F.col("z"), 4).alias("z"))


def focal_maximum(spark, sf_dir):
    return raster.focal_max(_cells(spark, sf_dir).select("r", "c", "z"), 2).select("r", "c", "focal")


def terrain_profile(spark, sf_dir):
    """Elevation at 11 points along the line from each customer's to the next one's cell."""
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "c_custkey % 90 AS r1", "(c_custkey * 7) % 100 AS c1", "(c_custkey * 13) % 90 AS r2", "(c_custkey * 29) % 100 AS c2")
    steps = lines.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(10)))).selectExpr("id", "step", "r1 + ((r2 - r1) * step) div 10 AS r", "c1 + ((c2 - c1) * step) div 10 AS c")
    return raster.sample(_cells(spark, sf_dir), steps).select("id", "step", "z", "missing")


_PROFILE = f"""{sql("a_cells")}, l AS (SELECT c_custkey AS id, c_custkey % 90 AS r1, (c_custkey * 7) % 100 AS c1, (c_custkey * 13) % 90 AS r2, (c_custkey * 29) % 100 AS c2 FROM customer),
s AS (SELECT id, step::INT AS step, r1 + trunc((r2 - r1) * step / 10)::BIGINT AS r, c1 + trunc((c2 - c1) * step / 10)::BIGINT AS c FROM l, range(0, 11) AS q(step))
SELECT id, step, coalesce(z, 0)::BIGINT AS z, z IS NULL AS missing FROM s LEFT JOIN a_cells a ON a.r = s.r AND a.c = s.c"""

#: The cells as a raster in degrees, and its cells in web Mercator metres.
DEGREE, METRES = 0.001, 170.0


def tile_warp(spark, sf_dir):
    """The raster, taken to lie in degrees, in web Mercator."""
    cells = _cells(spark, sf_dir)
    rows = cells.agg(F.max("r")).first()[0] + 1
    source = warp.Grid(19.0, 52.0, DEGREE, rows, 100)
    target = warp.target_grid(cells, source, crs.to_web, METRES)
    return warp.warp(cells, source, target, crs.from_web).select("r", "c", half_even(F.col("z"), 3).alias("z"))


_WEB = lambda lat: f"6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(({lat})::DOUBLE) / 2))"
_WARP = f"""{sql("a_cells")}, k AS (SELECT max(r) + 1 AS n, 6378137.0::DOUBLE * radians(19.0::DOUBLE) AS x0, 6378137.0::DOUBLE * radians(19.1::DOUBLE) AS x1, {_WEB('52')} AS y0, {_WEB('52 + (max(r) + 1) * 0.001::DOUBLE')} AS y1 FROM a_cells),
g AS (SELECT *, ceil((y1 - y0) / 170)::BIGINT AS nr, ceil((x1 - x0) / 170)::BIGINT AS nc FROM k), t AS (SELECT tr, tc, n, x0 + (tc + 0.5) * 170 AS x, y0 + (nr - tr - 0.5) * 170 AS y FROM g, range(0, nr) AS a(tr), range(0, nc) AS b(tc)),
p AS (SELECT tr, tc, n, (52 + n * 0.001::DOUBLE - degrees(2 * atan(exp(y / 6378137.0::DOUBLE)) - pi() / 2)) / 0.001::DOUBLE - 0.5 AS rr, (degrees(x / 6378137.0::DOUBLE) - 19) / 0.001::DOUBLE - 0.5 AS cc FROM t),
q AS (SELECT tr, tc, rr - floor(rr) AS fr, cc - floor(cc) AS fc, floor(rr)::BIGINT AS r0, floor(cc)::BIGINT AS c0 FROM p WHERE rr >= 0 AND rr <= n - 1 AND cc >= 0 AND cc <= 99)
SELECT tr AS r, tc AS c, round_even((sum(z * CASE WHEN a.r = r0 THEN 1 - fr ELSE fr END * CASE WHEN a.c = c0 THEN 1 - fc ELSE fc END)) * 1000, 0) / 1000 AS z FROM q JOIN a_cells a ON a.r IN (r0, r0 + 1) AND a.c IN (c0, c0 + 1) WHERE z IS NOT NULL GROUP BY tr, tc HAVING count(*) = 4"""


QUERIES = {
    "tile_warp": (tile_warp, _WARP),
    "zonal_stats": (zonal_stats, f"{sql('a_cells')} SELECT label, count(*) AS n_cells, count(z) AS n_valid, sum(z)::BIGINT AS z_sum, min(z) AS z_min, max(z) AS z_max, round_even(sum(z)::BIGINT / count(z) * 10000, 0) / 10000 AS z_mean FROM a_cells GROUP BY label"),
    "zonal_histogram": (
        zonal_histogram,
        f"{sql('a_cells')}, b AS MATERIALIZED (SELECT label, z // 100 AS bin, count(*) AS n FROM a_cells WHERE z IS NOT NULL GROUP BY ALL), t AS (SELECT label, min(bin) AS low, max(bin) AS high FROM b GROUP BY label), k AS (SELECT label, low, unnest(range(low, high + 1)) AS bin FROM t) SELECT k.label, min(low) * 100 AS base, list(coalesce(n, 0) ORDER BY k.bin) AS counts FROM k LEFT JOIN b ON b.label = k.label AND b.bin = k.bin GROUP BY k.label",
    ),
    "hypsometric_cells": (hypsometric_cells, f"{_CURVE} SELECT label, step, round_even(height * 10000, 0) / 10000 AS height, round_even(fraction * 1000000, 0) / 1000000 AS fraction FROM curve"),
    "hypsometric_integral_trapezoid": (
        hypsometric_integral_trapezoid,
        f"{_CURVE}, p AS (SELECT label, (lead(height) OVER w - height) * (lead(fraction) OVER w + fraction) / 2 AS part FROM curve WINDOW w AS (PARTITION BY label ORDER BY step)) SELECT label, round_even(least(greatest(sum(part), 0), 1) * 10000, 0) / 10000 AS integral FROM p GROUP BY label",
    ),
    "elevation_bands": (elevation_bands, _BANDS),
    "focal_hole_fill": (focal_hole_fill, _FILL),
    "sobel_slope_aspect": (sobel_slope_aspect, _SOBEL),
    "twi": (twi, _TWI),
    "d8_steepest": (d8_steepest, f"{_FLOW} SELECT r, c, down_r, down_c FROM flow"),
    "flow_accumulation": (flow_accumulation, f"{_ACC} SELECT id // 1000000 AS r, id % 1000000 AS c, acc FROM acc"),
    "headwaters": (
        headwaters,
        f"{_ACC}, s AS MATERIALIZED (SELECT id FROM acc WHERE acc >= {STREAM}), u AS (SELECT down AS id, count(*) AS n FROM flow WHERE id IN (FROM s) AND down IN (FROM s) GROUP BY down) SELECT s.id // 1000000 AS r, s.id % 1000000 AS c, coalesce(n, 0) AS n_up, n IS NULL AS head FROM s LEFT JOIN u ON u.id = s.id",
    ),
    "strahler_order": (strahler_order, f"{_ACC}, {_ORDER} SELECT id // 1000000 AS r, id % 1000000 AS c, o AS strahler_order FROM ord"),
    "stream_lines": (
        stream_lines,
        _TWI[: _TWI.rindex("SELECT g.r, g.c")] + f""", {_LINES}, sl AS (SELECT r * 1000000 + c AS id, coalesce(100 * sqrt(gx * gx + gy * gy), 0) AS slope FROM g)
SELECT ln.head // 1000000 AS head_r, ln.head % 1000000 AS head_c, o AS strahler_order, n_points::INT AS n_points, round_even(length * 10, 0) / 10 AS length, acc, round_even(slope * 100, 0) / 100 AS slope, line
FROM ln JOIN ord ON ord.id = ln.head JOIN jn USING (head) JOIN acc ON acc.id = outlet JOIN (SELECT head, avg(slope) AS slope FROM own JOIN sl USING (id) GROUP BY head) USING (head)""",
    ),
    "subcatchment_polygons": (
        subcatchment_polygons,
        f"""{_ACC}, {_LINES}, w(id, loc, head) AS (SELECT flow.id, flow.id, sg.head FROM flow LEFT JOIN sg ON sg.id = flow.id UNION ALL
  SELECT w.id, f.down, sg.head FROM w JOIN flow f ON f.id = w.loc LEFT JOIN sg ON sg.id = f.down WHERE w.head IS NULL AND f.down IS NOT NULL),
lb AS MATERIALIZED (SELECT id, head AS label FROM w WHERE head IS NOT NULL), {_parts_sql('SELECT id // 1000000 AS r, id % 1000000 AS c, label FROM lb')[: -len(_PARTS_END)]},
pt AS (SELECT label, count(*) AS n_parts, sum((1 - (q1 - q3 + 2 * qd) // 4))::BIGINT AS n_holes, sum(perimeter)::BIGINT AS perimeter FROM s2 JOIN q USING (label, root) GROUP BY label),
st AS (SELECT lb.label, count(*) AS n_cells, min(z) AS z_min, max(z) AS z_max, round_even(sum(z)::BIGINT / count(*) * 100, 0) / 100 AS z_mean FROM lb JOIN a_cells ON r * 1000000 + c = id GROUP BY lb.label)
SELECT label // 1000000 AS head_r, label % 1000000 AS head_c, n_parts, n_holes, perimeter, n_cells, z_min, z_max, z_mean, o AS strahler_order, round_even(length * 10, 0) / 10 AS length FROM pt JOIN st USING (label) JOIN ln ON ln.head = label JOIN ord ON ord.id = label""",
    ),
    "subcatchment_labels": (
        subcatchment_labels,
        f"{_ACC}, s AS MATERIALIZED (SELECT id FROM acc WHERE acc >= {STREAM}), w(id, loc, stop) AS (SELECT id, id, id IN (FROM s) FROM flow UNION ALL SELECT w.id, f.down, f.down IN (FROM s) FROM w JOIN flow f ON f.id = w.loc WHERE NOT w.stop AND f.down IS NOT NULL) SELECT f.r, f.c, max(loc) FILTER (stop) // 1000000 AS label_r, max(loc) FILTER (stop) % 1000000 AS label_c FROM flow f JOIN w ON w.id = f.id GROUP BY f.r, f.c",
    ),
    "downstream_links": (downstream_links, f"{_ACC}, {_LINES} SELECT head // 1000000 AS head_r, head % 1000000 AS head_c, next // 1000000 AS next_r, next % 1000000 AS next_c FROM nx"),
    "connected_depressions": (connected_depressions, _WET),
    "mosaic_first_valid": (mosaic_first_valid, _MOSAIC),
    "raster_resample": (raster_resample, f"{sql('a_cells')} SELECT r // 4 AS r, c // 4 AS c, round_even(sum(z)::BIGINT / count(z) * 10000, 0) / 10000 AS z FROM a_cells GROUP BY ALL"),
    "focal_maximum": (focal_maximum, f"{sql('a_cells')} SELECT a.r, a.c, max(b.z) AS focal FROM a_cells a JOIN a_cells b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY a.r, a.c"),
    "terrain_profile": (terrain_profile, _PROFILE),
}
