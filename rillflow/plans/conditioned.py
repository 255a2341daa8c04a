"""Queries over conditioned terrain, cover classes, clipped streams and sets of map sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions import sheets
from rillflow.functions.num import half_even
from rillflow.operators import conditioning, landcover, raster, spatial, tiles
from rillflow.plans.adapters import sql, view
from rillflow.plans.storms import PLACES, places, sheets_sql

_CN = (60, 70, 78, 85, 92, 98, 100, 75)  # of a_land's eight categories


def _cells(spark, sf_dir):
    return view(spark, sf_dir, "a_cells").select("r", "c", F.col("z").cast("double").alias("z"))


def raise_buildings(spark, sf_dir):
    """Triangles with two sides along the grid."""
    corner = view(spark, sf_dir, "a_land").selectExpr("cast(id * 3571 % 97 as double) AS x", "cast(id * 6869 % 151 as double) AS y", "cast(2 + id % 5 as double) AS w", "cast(2 + 2 * (id % 2) as double) AS h")
    ring = F.expr("array(named_struct('x', x, 'y', y), named_struct('x', x + w, 'y', y), named_struct('x', x, 'y', y + h), named_struct('x', x, 'y', y))")
    return conditioning.raise_buildings(_cells(spark, sf_dir), corner.select(ring.alias("ring")))


_RAISED = f"""{sql("a_cells", "a_land")}, k AS (SELECT id * 3571 % 97 AS x, id * 6869 % 151 AS y, 2 + id % 5 AS w, 2 + 2 * (id % 2) AS h FROM a_land),
hit AS (SELECT DISTINCT r, c FROM a_cells JOIN k ON c >= x AND r >= y AND (2 * c + 1 - 2 * x) * h + (2 * r + 1 - 2 * y) * w < 2 * w * h)
SELECT r, c, z::DOUBLE + CASE WHEN hit.r IS NOT NULL THEN 5 ELSE 0 END AS z FROM a_cells LEFT JOIN hit USING (r, c)"""


def _lines(spark, sf_dir):
    return view(spark, sf_dir, "a_land").selectExpr("id * 3571 % 97 + 0.25D AS x1", "id * 6869 % 151 + 0.5D AS y1", "id * 3571 % 97 + 0.25D + id % 9 - 4 AS x2", "id * 6869 % 151 + 0.5D + id % 7 AS y2")


def burn_streams(spark, sf_dir):
    return conditioning.burn_streams(_cells(spark, sf_dir), _lines(spark, sf_dir))


# A line and a cell meet if their boxes do and the cell's corners are not all on one side of the line; in quarters of a cell.
_BURNT = f"""{sql("a_cells", "a_land")}, l AS (SELECT id * 3571 % 97 * 4 + 1 AS x1, id * 6869 % 151 * 4 + 2 AS y1, (id % 9 - 4) * 4 AS dx, id % 7 * 4 AS dy FROM a_land),
m AS (SELECT r, c, list_transform([[4 * c, 4 * r], [4 * c + 4, 4 * r], [4 * c, 4 * r + 4], [4 * c + 4, 4 * r + 4]], lambda p: dx * (p[2] - y1) - dy * (p[1] - x1)) AS side FROM a_cells JOIN l
  ON 4 * c <= greatest(x1, x1 + dx) AND 4 * c + 4 >= least(x1, x1 + dx) AND 4 * r <= y1 + dy AND 4 * r + 4 >= y1),
hit AS (SELECT DISTINCT r, c FROM m WHERE list_min(side) <= 0 AND list_max(side) >= 0)
SELECT r, c, z::DOUBLE - CASE WHEN hit.r IS NOT NULL THEN 10 ELSE 0 END AS z FROM a_cells LEFT JOIN hit USING (r, c)"""


def sample_near(spark, sf_dir):
    points = view(spark, sf_dir, "a_cells").where("z is null").selectExpr("r * 100 + c AS qid", "r", "c + 1 - c % 3 AS c")
    return conditioning.sample_near(_cells(spark, sf_dir), points).select("qid", "z")


_SAMPLED = f"""{sql("a_cells")}, p AS (SELECT r * 100 + c AS qid, r AS pr, c + 1 - c % 3 AS pc FROM a_cells WHERE z IS NULL)
SELECT qid, arg_min(z, ((r - pr) * (r - pr) + (c - pc) * (c - pc), r, c))::DOUBLE AS z FROM p LEFT JOIN a_cells ON r BETWEEN pr - 3 AND pr + 3 AND c BETWEEN pc - 3 AND pc + 3 AND z IS NOT NULL GROUP BY qid"""


def fill_nearest(spark, sf_dir):
    """Cells after blocks of 7 x 9 cells, too, have lost their values."""
    gaps = F.when(F.expr("r div 7 % 3 = 1 and c div 9 % 4 = 2"), None).otherwise(F.col("z")).alias("z")
    return conditioning.fill_nearest(_cells(spark, sf_dir).select("r", "c", gaps))


_FILLED = f"""{sql("a_cells")}, g AS MATERIALIZED (SELECT r, c, CASE WHEN NOT (r // 7 % 3 = 1 AND c // 9 % 4 = 2) THEN z END AS z FROM a_cells),
n AS (SELECT h.r, h.c, arg_min(v.z, ((v.r - h.r) * (v.r - h.r) + (v.c - h.c) * (v.c - h.c), v.r, v.c)) AS near FROM g h JOIN g v ON v.r BETWEEN h.r - 12 AND h.r + 12 AND v.z IS NOT NULL WHERE h.z IS NULL GROUP BY h.r, h.c)
SELECT g.r, g.c, coalesce(z, near)::DOUBLE AS z FROM g LEFT JOIN n USING (r, c)"""


def sink_repair(spark, sf_dir):
    """Steepest descent of which every 13th cell has lost its direction."""
    cells = _cells(spark, sf_dir).withColumn("acc", (F.col("r") * 7919 + F.col("c") * 104729) % 1009)
    flow = raster.steepest(cells).withColumn("down", F.when((F.col("r") * 100 + F.col("c")) % 13 != 0, F.col("down")))
    fixed = conditioning.repair_sinks(flow.select("id", "down", "r", "c"), cells)
    return fixed.where("how is not null").select("r", "c", F.expr(f"(down - id + {raster.ROW} + 1) div {raster.ROW} - 1").alias("dr"), F.expr(f"(down - id + {raster.ROW} + 1) % {raster.ROW} - 1").alias("dc"), "how")


_AROUND = ", ".join(f"({i}, {dr}, {dc}, {1.0 if i % 2 == 0 else raster.DIAGONAL}::DOUBLE)" for i, (dr, dc) in enumerate(raster.DIRECTIONS))
_SINKS = f"""{sql("a_cells")}, d(ord, dr, dc, dist) AS (VALUES {_AROUND}),
n AS MATERIALIZED (SELECT a.r, a.c, ord, dr, dc, (a.z - b.z) / dist AS fall, (b.r * 7919 + b.c * 104729) % 1009 AS acc FROM a_cells a, d, a_cells b WHERE b.r = a.r + dr AND b.c = a.c + dc AND a.z IS NOT NULL AND b.z IS NOT NULL),
s AS (SELECT r, c FROM n GROUP BY r, c HAVING (max(fall) <= 0 OR (r * 100 + c) % 13 = 0) AND r > (SELECT min(r) FROM a_cells) AND r < (SELECT max(r) FROM a_cells) AND c > (SELECT min(c) FROM a_cells) AND c < (SELECT max(c) FROM a_cells)),
k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY CASE WHEN fall > 0 THEN fall ELSE 0 END DESC, CASE WHEN fall > 0 THEN 0 ELSE acc END DESC, ord) AS k FROM n JOIN s USING (r, c))
SELECT r, c, dr::BIGINT AS dr, dc::BIGINT AS dc, CASE WHEN fall > 0 THEN 'steepest' ELSE 'max_acc' END AS how FROM k WHERE k = 1"""


def fill_depressions(spark, sf_dir):
    """Terraces of 6 x 6 cells dam the slope, so lakes of many cells stand behind them."""
    found = tiles.fill(_terraces(spark, sf_dir))
    return found.select("r", "c", *(F.col(k).cast("long").alias(k) for k in ("z", "filled")))


def _terraces(spark, sf_dir):
    steps = F.expr("z + 150 * ((r div 6 * 7 + c div 6 * 5) % 4)").alias("z")
    return view(spark, sf_dir, "a_cells").select("r", "c", steps)


def filled_flow(spark, sf_dir):
    """Directions and accumulation on the filled terraces, with a drain in the middle of every 25 x 25 cells."""
    cells = _terraces(spark, sf_dir)
    drains = cells.where("r % 25 = 12 and c % 25 = 12").select("r", "c")
    return tiles.flow(cells, drains=drains).select("r", "c", F.col("filled").cast("long").alias("filled"), "down_r", "down_c", "acc")


# Levels go down from cell to cell, for as long as some way there is lower than the ones before.
_LAKES = f"""{sql("a_cells", recursive=True)}, t AS MATERIALIZED (SELECT r, c, z + 150 * ((r // 6 * 7 + c // 6 * 5) % 4) AS z FROM a_cells WHERE z IS NOT NULL), d(dr, dc) AS (VALUES {", ".join(map(str, raster.DIRECTIONS))}),
n AS MATERIALIZED (SELECT a.r, a.c, b.r AS r2, b.c AS c2, b.z FROM t a, d, t b WHERE b.r = a.r + dr AND b.c = a.c + dc),
f(r, c, w) USING KEY (r, c) AS (SELECT r, c, z FROM t WHERE (SELECT count(*) FROM n WHERE n.r = t.r AND n.c = t.c) < 8
  UNION SELECT r2, c2, min(greatest(n.z, f.w)) FROM f JOIN n USING (r, c) LEFT JOIN recurring.f k ON k.r = r2 AND k.c = c2 WHERE k.w IS NULL OR greatest(n.z, f.w) < k.w GROUP BY r2, c2)
SELECT r, c, z, w AS filled FROM t JOIN f USING (r, c)"""

# Then steepest descent, in flats the fewest steps to a cell with a way down or to an open one, and all cells upstream of each.
_FLOWS = _LAKES.replace("WHERE z IS NOT NULL)", "WHERE z IS NOT NULL AND NOT (r % 25 = 12 AND c % 25 = 12))").replace(
    "SELECT r, c, z, w AS filled FROM t JOIN f USING (r, c)",
    f""", o(k, dr, dc) AS (VALUES {", ".join(str((k, *d)) for k, d in enumerate(raster.DIRECTIONS))}), s AS MATERIALIZED (SELECT r, c, r * 1000000 + c AS id, w FROM f),
m AS MATERIALIZED (SELECT a.id, b.id AS nid, a.w, b.w AS nw, k FROM s a, o JOIN s b ON b.r = a.r + dr AND b.c = a.c + dc),
low AS MATERIALIZED (SELECT id, nid FROM (SELECT id, nid, row_number() OVER (PARTITION BY id ORDER BY (w - nw) / CASE WHEN k % 2 = 1 THEN 1.414::DOUBLE ELSE 1.0::DOUBLE END DESC, k) AS n FROM m WHERE nw < w) WHERE n = 1),
open AS (SELECT id FROM m GROUP BY id HAVING count(*) < 8 UNION SELECT id FROM s WHERE id NOT IN (SELECT id FROM m)),
dist(id, d) USING KEY (id) AS (SELECT id, 0 FROM (SELECT id FROM low UNION SELECT id FROM open)
  UNION SELECT m.nid, min(dist.d) + 1 FROM dist JOIN m ON m.id = dist.id AND m.w = m.nw LEFT JOIN recurring.dist q ON q.id = m.nid WHERE q.id IS NULL GROUP BY m.nid),
dd AS MATERIALIZED (SELECT id, d FROM dist),
side AS (SELECT m.id, arg_min(nid, k) AS nid FROM m JOIN dd x ON x.id = m.id JOIN dd y ON y.id = m.nid WHERE w = nw AND x.d > 0 AND y.d = x.d - 1 GROUP BY m.id),
flow AS MATERIALIZED (SELECT s.id, w, coalesce(low.nid, side.nid) AS down FROM s LEFT JOIN low USING (id) LEFT JOIN side USING (id)),
up(id, loc) AS (SELECT id, id FROM flow UNION ALL SELECT up.id, flow.down FROM up JOIN flow ON flow.id = up.loc WHERE flow.down IS NOT NULL),
acc AS (SELECT loc AS id, count(*) AS acc FROM up GROUP BY loc)
SELECT id // 1000000 AS r, id % 1000000 AS c, w AS filled, down // 1000000 AS down_r, down % 1000000 AS down_c, acc FROM flow JOIN acc USING (id)""",
)


def landcover_breakdown(spark, sf_dir):
    sheds = view(spark, sf_dir, "a_sheds").select("qid", *(F.col(c).alias("b" + c) for c in ("x0", "y0", "w", "h")))
    land = view(spark, sf_dir, "a_land").withColumns({"category": F.col("cat"), "cn": F.element_at(F.array(*(F.lit(v) for v in _CN)), (F.col("cat") + 1).cast("int")), "imperviousness": F.when(F.col("id") % 7 != 0, (F.col("id") % 4) / 4)})
    return landcover.breakdown(spatial.rect_overlay(land, sheds, 2000), ["qid"], "shared")


_BREAKDOWN = f"""{sql("a_land", "a_sheds")}, o AS (SELECT qid, cat AS category, [{", ".join(map(str, _CN))}][cat + 1] AS cn, CASE WHEN id % 7 <> 0 THEN id % 4 / 4 END AS imperviousness, (least(l.x0 + l.w, s.x0 + s.w) - greatest(l.x0, s.x0)) * (least(l.y0 + l.h, s.y0 + s.h) - greatest(l.y0, s.y0)) AS area
  FROM a_land l JOIN a_sheds s ON l.x0 < s.x0 + s.w AND s.x0 < l.x0 + l.w AND l.y0 < s.y0 + s.h AND s.y0 < l.y0 + l.h),
t AS (SELECT qid, sum(area)::BIGINT AS total, sum(cn * area)::BIGINT AS s, sum(coalesce(imperviousness, 0) * area) AS i FROM o GROUP BY qid), g AS (SELECT qid, category, cn, imperviousness, sum(area)::BIGINT AS a FROM o GROUP BY ALL)
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY a DESC, category, cn, imperviousness NULLS FIRST))::INT AS rank, category, cn, imperviousness, a::DOUBLE AS area_m2, round_even(a / total * 1000, 0) / 10 AS pct, total::DOUBLE AS total_m2, round_even(s / total, 0)::INT AS weighted_cn, round_even(i / total * 1000, 0) / 1000 AS weighted_imperviousness FROM g JOIN t USING (qid)"""


def mapped_streams_inside(spark, sf_dir):
    """Number and length of mapped streams inside each catchment; derived ones and those of no source are left out."""
    sheds = view(spark, sf_dir, "a_sheds").select("qid", *(F.col(c).alias("b" + c) for c in ("x0", "y0", "w", "h")))
    lines = view(spark, sf_dir, "a_segment").where("source <> 'DEM_DERIVED'")
    return spatial.segments_in_rects(lines, sheds, 2000).groupBy("qid").agg(F.count("*").alias("n"), half_even(F.sum("inside"), 2).alias("length_m"))


_INSIDE = f"""{sql("a_segment", "a_sheds")}, p AS (SELECT qid, x1, y1, (x2 - x1)::DOUBLE AS dx, (y2 - y1)::DOUBLE AS dy, x0, x0 + w AS x9, y0, y0 + h AS y9 FROM a_segment, a_sheds WHERE source <> 'DEM_DERIVED'),
t AS (SELECT *, CASE WHEN dx <> 0 THEN least((x0 - x1) / dx, (x9 - x1) / dx) WHEN x1 BETWEEN x0 AND x9 THEN 0 ELSE 2 END AS ax, CASE WHEN dx <> 0 THEN greatest((x0 - x1) / dx, (x9 - x1) / dx) ELSE 1 END AS bx,
  CASE WHEN dy <> 0 THEN least((y0 - y1) / dy, (y9 - y1) / dy) WHEN y1 BETWEEN y0 AND y9 THEN 0 ELSE 2 END AS ay, CASE WHEN dy <> 0 THEN greatest((y0 - y1) / dy, (y9 - y1) / dy) ELSE 1 END AS ey FROM p),
u AS (SELECT *, least(bx, ey, 1) - greatest(ax, ay, 0) AS share FROM t)
SELECT qid, count(*) AS n, round_even(sum(share * sqrt(dx * dx + dy * dy)) * 100, 0) / 100 AS length_m FROM u WHERE share > 0 GROUP BY qid"""


def sheets_around(spark, sf_dir):
    """Sheets within 5 km of each station."""
    box = sheets.box_around(F.col("lat"), F.col("lon"))
    return sheets.sheets_in_box(places(spark, sf_dir).withColumns(box), ["id"])


_MARKS = f"""SELECT id, least(lat - 5 / 111.0::DOUBLE + i * 0.02::DOUBLE, lat + 5 / 111.0::DOUBLE) AS lat, least(lon - rx + j * 0.04::DOUBLE, lon + rx) AS lon
FROM (SELECT *, 5 / (111.0::DOUBLE * cos(radians(lat))) AS rx FROM ({PLACES})), range(0, 7) AS a(i), range(0, 10) AS b(j) WHERE i <= floor(10 / 111.0::DOUBLE / 0.02::DOUBLE) + 1 AND j <= floor(2 * rx / 0.04::DOUBLE) + 1"""


def sheet_neighbours(spark, sf_dir):
    codes = places(spark, sf_dir).select("id", sheets.sheet_code(F.col("lat"), F.col("lon")).alias("code")).where("code is not null")
    return sheets.neighbour_sheets(codes, "1:10000")


_FIRST = f"SELECT * FROM (WITH {sheets_sql(PLACES)} SELECT * FROM t)"
_NEXT = f"SELECT (id, code) AS id, top - hh / 2 + dy * hh AS lat, west + ww / 2 + dx * ww AS lon FROM ({_FIRST}), range(-1, 2) AS y(dy), range(-1, 2) AS x(dx)"


def sheets_extent(spark, sf_dir):
    found = sheets.extent(sheets_around(spark, sf_dir), ["id"])
    return found.select("id", *(half_even(F.col(c), 6).alias(c) for c in ("south", "west", "north", "east")))


_VIEWS = ("a_catch", "a_segment", "a_cells", "a_stations", "a_land", "a_soil", "a_depr")


def table_counts(spark, sf_dir):
    """Rows of each view."""
    found = [view(spark, sf_dir, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in _VIEWS]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


QUERIES = {
    "raise_buildings": (raise_buildings, _RAISED),
    "burn_streams": (burn_streams, _BURNT),
    "sample_near": (sample_near, _SAMPLED),
    "fill_nearest": (fill_nearest, _FILLED),
    "sink_repair": (sink_repair, _SINKS),
    "fill_depressions": (fill_depressions, _LAKES),
    "filled_flow": (filled_flow, _FLOWS),
    "landcover_breakdown": (landcover_breakdown, _BREAKDOWN),
    "mapped_streams_inside": (mapped_streams_inside, _INSIDE),
    "sheets_around": (sheets_around, f"{sql('a_stations')}, {sheets_sql(_MARKS)} SELECT DISTINCT id, code FROM t"),
    "sheet_neighbours": (sheet_neighbours, f"{sql('a_stations')}, {sheets_sql(_NEXT)} SELECT DISTINCT id[1] AS id, id[2] AS code, code AS neighbour FROM t WHERE code <> id[2]"),
    "sheets_extent": (sheets_extent, f"{sql('a_stations')}, {sheets_sql(_MARKS)} SELECT id, round_even(min(top - hh) * 1000000, 0) / 1000000 AS south, round_even(min(west) * 1000000, 0) / 1000000 AS west, round_even(max(top) * 1000000, 0) / 1000000 AS north, round_even(max(west + ww) * 1000000, 0) / 1000000 AS east FROM t GROUP BY id"),
    "table_counts": (table_counts, f"{sql(*_VIEWS)} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in _VIEWS)),
}
