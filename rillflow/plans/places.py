"""Queries over places: land cover, soil, rainfall, points, segments, tiles and depressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions.num import half_even
from rillflow.operators import landcover, spatial
from rillflow.operators import rain as rainfall
from rillflow.plans.adapters import levels, rain, sql, view

_CN = (60, 70, 78, 85, 92, 98, 100, 75)  # of a_land's eight categories
_COVERS = ("las", "meadow", "arable", "urban_residential", "road", "water", "nowhere", "31")


def _sheds(spark, sf_dir):
    return view(spark, sf_dir, "a_sheds").select("qid", *(F.col(c).alias("b" + c) for c in ("x0", "y0", "w", "h")))


def _land(spark, sf_dir):
    return spatial.rect_overlay(view(spark, sf_dir, "a_land"), _sheds(spark, sf_dir), 2000).withColumnRenamed("shared", "area")


def _cn(column):
    return F.element_at(F.array(*(F.lit(v) for v in _CN)), (F.col(column) + 1).cast("int"))


def landcover_overlay(spark, sf_dir):
    return landcover.shares(_land(spark, sf_dir), ["qid"], "cat")


def weighted_cn(spark, sf_dir):
    return landcover.weighted_cn(_land(spark, sf_dir).withColumn("cn", _cn("cat")), ["qid"])


_OVERLAY = """o AS (SELECT qid, l.*, (least(l.x0 + l.w, s.x0 + s.w) - greatest(l.x0, s.x0)) * (least(l.y0 + l.h, s.y0 + s.h) - greatest(l.y0, s.y0)) AS area
  FROM {t} l JOIN a_sheds s ON l.x0 < s.x0 + s.w AND s.x0 < l.x0 + l.w AND l.y0 < s.y0 + s.h AND s.y0 < l.y0 + l.h)"""
_LAND = f"{sql('a_land', 'a_sheds')}, {_OVERLAY.format(t='a_land')}"
_SOIL = f"{sql('a_soil', 'a_sheds')}, {_OVERLAY.format(t='a_soil')}"
_SHARES = """g AS (SELECT qid, {g}, sum(area)::BIGINT AS area FROM o GROUP BY ALL)
SELECT qid, {g}, area, round_even(area * 100 / (sum(area) OVER (PARTITION BY qid))::BIGINT * 10, 0) / 10 AS pct, (row_number() OVER (PARTITION BY qid ORDER BY area DESC, {g}))::INT AS rank FROM g"""


def soil_share_window(spark, sf_dir):
    pairs = spatial.rect_overlay(view(spark, sf_dir, "a_soil"), _sheds(spark, sf_dir), 2000).withColumnRenamed("shared", "area")
    return landcover.shares(pairs, ["qid"], "grp")


def cn_lookup_hsg(spark, sf_dir):
    land = view(spark, sf_dir, "a_land").select("id", F.element_at(F.array(*(F.lit(c) for c in _COVERS)), (F.col("cat") + 1).cast("int")).alias("cover"), F.expr("substr('ABCDX', cast(id % 5 + 1 as int), 1)").alias("hsg"))
    return landcover.lookup_cn(land, "cover", "hsg").select("id", "cover", "hsg", "cn")


_NAMES = ", ".join(f"('{c}', '{g}', {landcover.CURVE_NUMBERS[c if c in landcover.CURVE_NUMBERS else 'other'][max(0, 'ABCD'.find(g if g != 'X' else 'B'))]})" for c in _COVERS for g in "ABCDX")
_LOOKUP = f"""{sql("a_land")}, t(cover, hsg, cn) AS (VALUES {_NAMES}), l AS (SELECT id, [{", ".join(f"'{c}'" for c in _COVERS)}][cat + 1] AS cover, substr('ABCDX', id % 5 + 1, 1) AS hsg FROM a_land)
SELECT id, cover, hsg, cn FROM l JOIN t USING (cover, hsg)"""


def cn_from_percentages(spark, sf_dir):
    land = view(spark, sf_dir, "a_land").select(F.expr("id div 5").alias("gid"), (10 + F.col("id") % 23).alias("pct"), _cn("cat").alias("cn"))
    return landcover.cn_from_percentages(land, ["gid"])


def cn_source_cascade(spark, sf_dir):
    k = F.col("id")
    value, name = landcover.cascade(config=F.when(k % 7 == 0, k % 40 + 50), database=F.when(k % 3 == 0, _cn("cat").cast("long")), model=F.when(k % 2 == 0, k % 30 + 60))
    return view(spark, sf_dir, "a_land").select("id", value.cast("long").alias("cn"), name.alias("source"))


def class_codes(spark, sf_dir):
    names = F.element_at(F.array(*(F.lit(v) for v in ("OT_PTLZ_A", "ptwz", "X_PTZB", "OTPTKM_A", "PTQQ_A", "BUBD_A", "OT_PTWP", "PTTR_x"))), (F.col("cat") + 1).cast("int"))
    return landcover.classify(view(spark, sf_dir, "a_land").select("id", names.alias("layer")), "layer").select("id", "layer", "class", "category", "cn", "imperviousness")


_CLASS_ROWS = ", ".join(f"('{k}', '{a}', {b}, {c}::DOUBLE)" for k, (a, b, c) in landcover.CLASSES.items())
_CLASS = f"""{sql("a_land")}, t(class, category, cn, imperviousness) AS (VALUES {_CLASS_ROWS}),
l AS (SELECT id, ['OT_PTLZ_A', 'ptwz', 'X_PTZB', 'OTPTKM_A', 'PTQQ_A', 'BUBD_A', 'OT_PTWP', 'PTTR_x'][cat + 1] AS layer FROM a_land),
c AS (SELECT *, regexp_extract(upper(layer), '(^|_)PT([A-Z][A-Z])(_|$)', 2) AS code FROM l)
SELECT id, layer, CASE WHEN code <> '' THEN 'PT' || code END AS class, coalesce(category, 'inny') AS category, coalesce(cn, 75) AS cn, coalesce(imperviousness, 0.2) AS imperviousness FROM c LEFT JOIN t ON t.class = 'PT' || code"""


def category_counts(spark, sf_dir):
    return view(spark, sf_dir, "a_land").groupBy("cat").agg(F.count("*").alias("n"))


def _asks(spark, sf_dir):
    return view(spark, sf_dir, "a_points").select("qid", F.col("x").alias("qx"), F.col("y").alias("qy"))


def idw_knn4(spark, sf_dir):
    stations = rain(spark, sf_dir).where("duration = 60 and probability = 10")
    return rainfall.interpolate(_asks(spark, sf_dir), stations, "mm_x10", []).select("qid", half_even(F.col("value") / 10, 3).alias("mm"), "n")


def idw_all_scenarios(spark, sf_dir):
    found = rainfall.interpolate(_asks(spark, sf_dir), rain(spark, sf_dir), "mm_x10", ["duration", "probability"])
    return found.select("qid", "duration", "probability", half_even(F.col("value") / 10, 3).alias("mm"))


_NEAR = """n AS (SELECT p.qid, r.*, sqrt(((r.x - p.x) * (r.x - p.x) + (r.y - p.y) * (r.y - p.y))::DOUBLE) AS d,
  row_number() OVER (PARTITION BY p.qid, duration, probability ORDER BY (r.x - p.x) * (r.x - p.x) + (r.y - p.y) * (r.y - p.y), r.id) AS k FROM a_points p, a_rain r {w}),
i AS (SELECT qid, duration, probability, count(*) AS n, CASE WHEN min(d) < 0.001 THEN min_by(mm_x10, k)::DOUBLE ELSE sum(mm_x10 / pow(d + 0.001, 2)) / sum(1 / pow(d + 0.001, 2)) END AS v FROM n WHERE k <= 4 GROUP BY ALL)"""
_RAIN = sql("a_stations", "a_points", "a_rain")


def rain_coverage(spark, sf_dir):
    return rainfall.coverage(rain(spark, sf_dir), 503000, 303000, 509000, 309000)


def _readings(spark, sf_dir):
    old = rain(spark, sf_dir).select("id", "duration", "probability", "mm_x10", F.lit(1).cast("long").alias("version"))
    new = old.where("id % 3 = 0").select(F.expr("id + 300").alias("id"), "duration", "probability", F.expr("case when id % 11 <> 0 then mm_x10 + 7 end").alias("mm_x10"), F.expr("2 - id % 4").alias("version"))
    return old, new


def rain_upsert(spark, sf_dir):
    old, new = _readings(spark, sf_dir)
    return rainfall.upsert(old, new, ["id", "duration", "probability"], "version")


_UPSERT = f"""{sql("a_stations", "a_rain")}, old AS (SELECT id, duration, probability, mm_x10, 1 AS version, 0 AS fresh FROM a_rain),
new AS (SELECT id + 300 AS id, duration, probability, mm_x10 + 7 AS mm_x10, 2 - id % 4 AS version, 1 AS fresh FROM a_rain WHERE id % 3 = 0 AND id % 11 <> 0),
u AS (SELECT *, row_number() OVER (PARTITION BY id, duration, probability ORDER BY version DESC, fresh DESC, mm_x10 DESC) AS k FROM (FROM old UNION ALL FROM new))
SELECT id, duration, probability, mm_x10, version::BIGINT AS version FROM u WHERE k = 1"""


def scenario_list(spark, sf_dir):
    rows = [(d, p) for d in rainfall.DURATIONS.values() for p in rainfall.PROBABILITIES]
    return spark.createDataFrame(rows, "duration string, probability int")


def nearest_segment_within(spark, sf_dir):
    found = spatial.nearest_segment(view(spark, sf_dir, "a_points"), view(spark, sf_dir, "a_segment").where("id > 1"))
    return found.select("qid", "id", half_even(F.col("distance"), 4).alias("distance"))


_SEGMENT = f"""{sql("a_segment", "a_points")}, v AS (SELECT p.qid, s.id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM a_points p, a_segment s WHERE s.id > 1
  AND least(x1, x2) <= x + 1000 AND greatest(x1, x2) >= x - 1000 AND least(y1, y2) <= y + 1000 AND greatest(y1, y2) >= y - 1000),
t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0::DOUBLE ELSE least(greatest(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0.0), 1.0) END AS t FROM v),
d AS (SELECT qid, id, pow(x - (x1 + t * dx), 2) + pow(y - (y1 + t * dy), 2) AS d2 FROM t)
SELECT qid, arg_min(id, (d2, id)) AS id, round_even(sqrt(min(d2)) * 10000, 0) / 10000 AS distance FROM d WHERE d2 <= 1000000 GROUP BY qid"""


def point_in_catchment(spark, sf_dir):
    hits = spatial.points_in_rects(view(spark, sf_dir, "a_points"), view(spark, sf_dir, "a_sheds").withColumnRenamed("qid", "shed"), 2000)
    return hits.groupBy("qid").agg(F.min("shed").alias("shed"))


_INSIDE = "h AS (SELECT p.qid, min(s.qid) AS shed FROM a_points p JOIN a_sheds s ON x > x0 AND x < x0 + w AND y > y0 AND y < y0 + h GROUP BY p.qid)"


def snap_hybrid(spark, sf_dir):
    """The segment of the catchment that holds a point, else the nearest segment."""
    points = view(spark, sf_dir, "a_points")
    inside = point_in_catchment(spark, sf_dir).select("qid", (F.col("shed") + 2).alias("by_shed"))
    near = nearest_segment_within(spark, sf_dir).select("qid", F.col("id").alias("by_distance"))
    joined = points.join(inside, "qid", "left").join(near, "qid", "left")
    return joined.select("qid", F.coalesce("by_shed", "by_distance").alias("id"), F.when(F.col("by_shed").isNotNull(), "catchment").when(F.col("by_distance").isNotNull(), "nearest").alias("how"))


def tile_assign(spark, sf_dir):
    """Rectangles by the tiles of 2048 m that they touch."""
    land = view(spark, sf_dir, "a_land")
    c = F.col
    tiles = spatial.with_cells(land, c("x0"), c("x0") + c("w"), c("y0"), c("y0") + c("h"), 2048)
    return tiles.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.sum(c("w") * c("h")).alias("area"))


def thresholds_distinct(spark, sf_dir):
    return levels(spark, sf_dir).select("threshold").distinct().orderBy("threshold")


def depressions_topk(spark, sf_dir):
    d = view(spark, sf_dir, "a_depr").where("vol_dm3 between 1000 and 90000 and area_dm2 >= 100")
    return d.orderBy(F.desc("vol_dm3"), "id").limit(500).select("id", (F.col("vol_dm3") / 1000).alias("volume_m3"), (F.col("area_dm2") / 100).alias("area_m2"), (F.col("depth_mm") / 1000).alias("max_depth_m"))


def depressions_bbox(spark, sf_dir):
    d = view(spark, sf_dir, "a_depr").where("x between 503000 and 512000 and y between 302000 and 311000 and area_dm2 >= 100")
    return d.select("id", "vol_dm3", "area_dm2", "depth_mm")


def depression_totals(spark, sf_dir):
    d = view(spark, sf_dir, "a_depr")
    return d.agg(F.count("*").alias("n"), F.sum("vol_dm3").alias("vol_dm3"), half_even(F.sum("depth_mm") / F.count("*"), 4).alias("mean_depth_mm"), F.max("depth_mm").alias("max_depth_mm"))


def pipeline_report(spark, sf_dir):
    nodes = levels(spark, sf_dir)
    a = nodes.groupBy("threshold").agg(F.count("*").alias("segments"), F.max("strahler").alias("max_order"), F.sum(F.coalesce("len_m", F.lit(0))).alias("length_m"))
    b = nodes.where("id % 89 <> 0").groupBy("threshold").agg(F.count("*").alias("catchments"), F.max("area_milli").alias("max_area_milli"))
    return a.join(b, "threshold", "full")


QUERIES = {
    "landcover_overlay": (landcover_overlay, f"{_LAND}, {_SHARES.format(g='cat')}"),
    "weighted_cn": (weighted_cn, f"{_LAND} SELECT qid, least(greatest(round_even(sum([{', '.join(map(str, _CN))}][cat + 1] * area)::BIGINT / sum(area)::BIGINT, 0), 0), 100)::INT AS cn FROM o GROUP BY qid"),
    "soil_share_window": (soil_share_window, f"{_SOIL}, {_SHARES.format(g='grp')}"),
    "cn_lookup_hsg": (cn_lookup_hsg, _LOOKUP),
    "cn_from_percentages": (
        cn_from_percentages,
        f"{sql('a_land')}, l AS (SELECT id // 5 AS gid, 10 + id % 23 AS pct, [{', '.join(map(str, _CN))}][cat + 1] AS cn FROM a_land) SELECT gid, round_even(CASE WHEN abs(sum(pct) - 100) > 0.1 THEN sum(pct * cn)::BIGINT / sum(pct)::BIGINT ELSE sum(pct * cn)::BIGINT / 100 END, 0)::INT AS cn FROM l GROUP BY gid",
    ),
    "cn_source_cascade": (
        cn_source_cascade,
        f"{sql('a_land')} SELECT id, coalesce(CASE WHEN id % 7 = 0 THEN id % 40 + 50 END, CASE WHEN id % 3 = 0 THEN [{', '.join(map(str, _CN))}][cat + 1] END, CASE WHEN id % 2 = 0 THEN id % 30 + 60 END, 75)::BIGINT AS cn, CASE WHEN id % 7 = 0 THEN 'config' WHEN id % 3 = 0 THEN 'database' WHEN id % 2 = 0 THEN 'model' ELSE 'default' END AS source FROM a_land",
    ),
    "class_codes": (class_codes, _CLASS),
    "category_counts": (category_counts, f"{sql('a_land')} SELECT cat, count(*) AS n FROM a_land GROUP BY cat"),
    "idw_knn4": (idw_knn4, f"{_RAIN}, {_NEAR.format(w='WHERE duration = 60 AND probability = 10')} SELECT qid, round_even(v / 10 * 1000, 0) / 1000 AS mm, n FROM i"),
    "idw_all_scenarios": (idw_all_scenarios, f"{_RAIN}, {_NEAR.format(w='')} SELECT qid, duration, probability, round_even(v / 10 * 1000, 0) / 1000 AS mm FROM i"),
    "rain_coverage": (rain_coverage, f"{sql('a_stations', 'a_rain')} SELECT count(DISTINCT (x, y)) AS n_points, count(*) AS n_records FROM a_rain WHERE x BETWEEN 503000 AND 509000 AND y BETWEEN 303000 AND 309000"),
    "rain_upsert": (rain_upsert, _UPSERT),
    "scenario_list": (scenario_list, "SELECT duration, probability FROM (VALUES ('15min'), ('30min'), ('1h'), ('2h'), ('6h'), ('12h'), ('24h')) AS d(duration), (VALUES (1), (2), (5), (10), (20), (50)) AS p(probability)"),
    "nearest_segment_within": (nearest_segment_within, _SEGMENT),
    "point_in_catchment": (point_in_catchment, f"{sql('a_points', 'a_sheds')}, {_INSIDE} FROM h"),
    "snap_hybrid": (
        snap_hybrid,
        f"WITH near AS MATERIALIZED ({_SEGMENT}), {sql('a_points', 'a_sheds')[5:]}, {_INSIDE} SELECT a_points.qid, coalesce(shed + 2, id) AS id, CASE WHEN shed IS NOT NULL THEN 'catchment' WHEN id IS NOT NULL THEN 'nearest' END AS how FROM a_points LEFT JOIN h USING (qid) LEFT JOIN near USING (qid)",
    ),
    "tile_assign": (
        tile_assign,
        f"{sql('a_land')}, t AS (SELECT w, h, unnest(range(x0 // 2048, (x0 + w) // 2048 + 1)) AS gx, y0 FROM a_land), u AS (SELECT w, h, gx, unnest(range(y0 // 2048, (y0 + h) // 2048 + 1)) AS gy FROM t) SELECT gx, gy, count(*) AS n, sum(w * h)::BIGINT AS area FROM u GROUP BY gx, gy",
    ),
    "thresholds_distinct": (thresholds_distinct, f"{sql('a_catch', 'a_levels')} SELECT DISTINCT threshold FROM a_levels ORDER BY threshold"),
    "depressions_topk": (depressions_topk, f"{sql('a_depr')} SELECT id, vol_dm3 / 1000 AS volume_m3, area_dm2 / 100 AS area_m2, depth_mm / 1000 AS max_depth_m FROM a_depr WHERE vol_dm3 BETWEEN 1000 AND 90000 AND area_dm2 >= 100 ORDER BY vol_dm3 DESC, id LIMIT 500"),
    "depressions_bbox": (depressions_bbox, f"{sql('a_depr')} SELECT id, vol_dm3, area_dm2, depth_mm FROM a_depr WHERE x BETWEEN 503000 AND 512000 AND y BETWEEN 302000 AND 311000 AND area_dm2 >= 100"),
    "depression_totals": (depression_totals, f"{sql('a_depr')} SELECT count(*) AS n, sum(vol_dm3)::BIGINT AS vol_dm3, round_even(sum(depth_mm)::BIGINT / count(*) * 10000, 0) / 10000 AS mean_depth_mm, max(depth_mm) AS max_depth_mm FROM a_depr"),
    "pipeline_report": (
        pipeline_report,
        f"{sql('a_catch', 'a_levels')} SELECT threshold, count(*) AS segments, max(strahler) AS max_order, sum(coalesce(len_m, 0))::BIGINT AS length_m, count(*) FILTER (id % 89 <> 0) AS catchments, max(area_milli) FILTER (id % 89 <> 0) AS max_area_milli FROM a_levels GROUP BY threshold",
    ),
}
