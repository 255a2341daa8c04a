"""Whole requests over many points at once: catchments of points and streams of points."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.checkpoint import saved
from rillflow.functions.num import half_even
from rillflow.operators import forest, hydrograph, stats
from rillflow.operators import rain as rainfall
from rillflow.plans import places, shapes, watersheds
from rillflow.plans.adapters import rain, sql, view


def _snapped(spark, sf_dir):
    """(qid, id, how) of all points; id and how are null where no stream is near."""
    return places.snap_hybrid(spark, sf_dir)


def delineate(spark, sf_dir):
    """The catchment of each point: figures, main channel and relief. Points without a stream keep nulls.

    All nodes are rolled up in one pass, so its cost does not depend on how many points ask for
    the same catchment; channels are followed from the distinct outlets only.
    """
    c = F.col
    points = _snapped(spark, sf_dir)
    figures = watersheds.rollup_all_nodes(spark, sf_dir)
    outlets = points.where("id is not null").select("id").distinct()
    channel = watersheds.main_channels(spark, sf_dir, outlets).select(c("start").alias("id"), c("length_km").alias("channel_km"), c("slope").alias("channel_slope"))
    joined = points.join(figures, "id", "left").join(channel, "id", "left")
    low, high, mean = (F.when(c("n_segments").isNotNull(), F.coalesce(v, F.lit(0.0))) for v in ("elev_min_m", "elev_max_m", "elev_mean_m"))
    return joined.select("qid", "id", "how", "n_segments", half_even(c("area_km2"), 2).alias("area_km2"), low.alias("elev_min_m"), high.alias("elev_max_m"), mean.alias("elev_mean_m"), F.nullif("channel_km", F.lit(0.0)).alias("channel_km"), "channel_slope", "density", "max_order")


_DELINEATE = f"""WITH snapped AS MATERIALIZED ({places.QUERIES["snap_hybrid"][1]}), figures AS MATERIALIZED ({watersheds.QUERIES["rollup_all_nodes"][1]}), channels AS MATERIALIZED ({watersheds.QUERIES["main_channel"][1]})
SELECT qid, s.id, how, f.n_segments, round_even(area_km2, 2) AS area_km2, CASE WHEN f.id IS NOT NULL THEN coalesce(elev_min_m, 0) END AS elev_min_m, CASE WHEN f.id IS NOT NULL THEN coalesce(elev_max_m, 0) END AS elev_max_m,
  CASE WHEN f.id IS NOT NULL THEN coalesce(elev_mean_m, 0) END AS elev_mean_m, nullif(channels.length_km, 0) AS channel_km, channels.slope AS channel_slope, density, max_order FROM snapped s LEFT JOIN figures f ON f.id = s.id LEFT JOIN channels ON channels.start = s.id"""


def select_stream(spark, sf_dir):
    """The stream of each point, up to the first confluences: figures of its segments. Points without a stream have no row."""
    nodes = view(spark, sf_dir, "a_catch")
    edges = forest.resolve_edges(nodes, [])
    points = _snapped(spark, sf_dir).where("id is not null").select("qid", F.col("id").alias("start"))
    reach = forest.to_confluence(edges, points.select(F.col("start").alias("id")).distinct()).join(watersheds.parts(nodes), "id")
    figures = stats.roll_up(reach, ["start"]).select("start", *(v.alias(k) for k, v in watersheds.figures().items()))
    return points.join(figures, "start")


_SELECT = f"""WITH snapped AS MATERIALIZED ({places.QUERIES["snap_hybrid"][1]}), reach AS MATERIALIZED ({watersheds.QUERIES["upstream_to_confluence"][1]}), figures AS (
SELECT start, {watersheds.ROLL} FROM reach JOIN nodes USING (id) GROUP BY start) SELECT qid, figures.* FROM snapped JOIN figures ON start = snapped.id"""

#: Minutes of the storm and of a step, and its probability in percent.
DURATION, STEP, PROBABILITY = 60, 15, 10


def _centroids(polygons):
    """(key, qx, qy) of polygons (key, shell, holes), in whole metres; holes turn the other way or the same, they always count against the shell."""
    o = F.element_at("shell", 1)

    def moments(ring):
        after = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
        one = lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])
        total = lambda f: F.aggregate(F.zip_with(ring, after, lambda p, q: f(p, q) * one(p, q)), F.lit(0).cast("long"), lambda t, v: t + v)
        a, x, y = total(lambda p, q: F.lit(1)), total(lambda p, q: p["x"] + q["x"] - 2 * o["x"]), total(lambda p, q: p["y"] + q["y"] - 2 * o["y"])
        return F.struct(F.abs(a).alias("a"), (F.signum(a) * x).alias("x"), (F.signum(a) * y).alias("y"))

    shell, holes = moments(F.col("shell")), F.transform("holes", moments)
    rest = lambda k: shell[k] - F.aggregate(holes, F.lit(0.0), lambda t, h: t + h[k])
    whole = lambda k: F.floor(o[k] + rest(k) / (3 * rest("a")) + 0.5).cast("long")
    return polygons.select("key", whole("x").alias("qx"), whole("y").alias("qy"))


def generate_hydrograph(spark, sf_dir):
    """The storm hydrograph at each point that lies in a boundary: catchment, curve number of the boundary's cover, rain at its
    centroid, losses, unit hydrograph and water balance. Points outside, catchments over the model's area or without a channel's slope
    and boundaries without rain have no row. Each boundary is computed once, however many points it holds."""
    c = F.col
    points = shapes.polygon_of_point(spark, sf_dir).where("shed is not null").select("qid", "shed", (c("shed") + 2).alias("id"))
    sheds = points.select("shed", "id").distinct()
    figures = watersheds.rollup_all_nodes(spark, sf_dir).select("id", "area_km2")
    channel = watersheds.main_channels(spark, sf_dir, sheds.select("id")).select(c("start").alias("id"), (c("length_km") * 1000).alias("length_m"), "slope")
    cn = shapes.polygon_cn(spark, sf_dir).select(c("qid").alias("shed"), "cn")
    asks = _centroids(shapes.shapes(spark, sf_dir, "sheds", "key")).withColumnRenamed("key", "qid")
    scenario = rain(spark, sf_dir).where((c("duration") == DURATION) & (c("probability") == PROBABILITY)).select("id", "x", "y", "mm_x10")
    wet = rainfall.interpolate(asks, scenario, "mm_x10", []).select(c("qid").alias("shed"), (c("value") / 10).alias("total"))
    basins = sheds.join(figures, "id").join(channel, "id").join(cn, "shed").join(wet, "shed").where(hydrograph.design_peak_area(c("area_km2")) & (c("slope") > 0) & (c("length_m") > 0))
    none = F.lit(None).cast("double")
    tc = hydrograph.concentration("kirpich", c("length_m"), c("slope"), none, none, none, none)
    basins = saved(basins.withColumn("tc_min", tc).withColumn("steps", F.lit(DURATION // STEP)))
    fallen = hydrograph.hyetograph(basins, "beta", ["shed"]).join(basins.select("shed", "cn"), "shed")
    excess = saved(hydrograph.effective_rain(fallen, ["shed"]))
    flow = hydrograph.convolve(excess, hydrograph.unit_hydrograph(basins, ["shed"], STEP), ["shed"], ["shed"])
    result = hydrograph.balance(flow, ["shed"], STEP).join(excess.groupBy("shed").agg(F.sum("excess").alias("effective")), "shed").join(basins.drop("id"), "shed")
    return points.join(result, "shed").select(
        "qid", "id", half_even(c("area_km2"), 2).alias("area_km2"), "cn", half_even(c("total"), 2).alias("precip_mm"), half_even(c("tc_min"), 1).alias("tc_min"), half_even(c("peak"), 3).alias("peak_m3s"), "peak_min",
        half_even(c("volume_m3"), 0).alias("volume_m3"), half_even(c("effective"), 2).alias("effective_mm"), half_even(c("effective") / c("total"), 3).alias("runoff_coefficient"),
    )


_HYDROGRAPH = f"""WITH inside AS MATERIALIZED ({shapes.QUERIES["polygon_of_point"][1]}), figures AS MATERIALIZED ({watersheds.QUERIES["rollup_all_nodes"][1]}), channels AS MATERIALIZED ({watersheds.QUERIES["main_channel"][1]}), cns AS MATERIALIZED ({shapes.QUERIES["polygon_cn"][1]}),
{sql("a_sheds", "a_stations", "a_rain")[5:]}, e AS (SELECT id, s, xl - 500000 AS xl, xr - 500000 AS xr, yl - 300000 AS yl, yr - 300000 AS yr FROM ({shapes.edges_sql("sheds")}) WHERE s <> 0),
ce AS (SELECT id AS shed, floor(500000 + sum(s * (xr - xl) * (xl * (2 * yl + yr) + xr * (yl + 2 * yr)) / 6) / sum(s * (xr - xl) * (yl + yr) / 2) + 0.5) AS x,
  floor(300000 + sum(s * (xr - xl) * (yl * yl + yl * yr + yr * yr) / 6) / sum(s * (xr - xl) * (yl + yr) / 2) + 0.5) AS y FROM e GROUP BY id),
ne AS (SELECT shed, mm_x10, sqrt(pow(r.x - ce.x, 2) + pow(r.y - ce.y, 2)) AS d, row_number() OVER (PARTITION BY shed ORDER BY pow(r.x - ce.x, 2) + pow(r.y - ce.y, 2), r.id) AS k FROM ce, a_rain r WHERE duration = {DURATION} AND probability = {PROBABILITY}),
wet AS (SELECT shed, CASE WHEN min(d) < 0.001 THEN min_by(mm_x10, k)::DOUBLE ELSE sum(mm_x10 / pow(d + 0.001, 2)) / sum(1 / pow(d + 0.001, 2)) END / 10 AS total FROM ne WHERE k <= 4 GROUP BY shed),
b AS MATERIALIZED (SELECT w.shed, w.shed + 2 AS id, area_km2 AS a, cns.cn, total, 0.0195::DOUBLE * pow(c.length_km * 1000, 0.77) * pow(c.slope, -0.385) AS tc, {DURATION // STEP} AS steps
  FROM wet w JOIN figures f ON f.id = w.shed + 2 JOIN channels c ON c.start = w.shed + 2 JOIN cns ON cns.qid = w.shed WHERE area_km2 > 0 AND area_km2 <= 250 AND c.slope > 0 AND c.length_km > 0),
t AS (SELECT *, step / steps AS t1, (step - 1) / steps AS t0 FROM (SELECT *, unnest(range(1, steps + 1)) AS step FROM b)),
de AS (SELECT *, total * ((1 - pow(1 - t1, 6) - 6 * t1 * pow(1 - t1, 5)) - (1 - pow(1 - t0, 6) - 6 * t0 * pow(1 - t0, 5))) AS depth, 25.4::DOUBLE * (1000 / cn - 10) AS s FROM t),
pr AS (SELECT *, sum(depth) OVER (PARTITION BY shed ORDER BY step ROWS UNBOUNDED PRECEDING) AS p FROM de),
ru AS (SELECT *, CASE WHEN p > 0.2::DOUBLE * s THEN (p - 0.2::DOUBLE * s) * (p - 0.2::DOUBLE * s) / (p + 0.8::DOUBLE * s) ELSE 0 END AS runoff FROM pr),
ex AS MATERIALIZED (SELECT shed, step, runoff - coalesce(lag(runoff) OVER (PARTITION BY shed ORDER BY step), 0) AS excess FROM ru),
u0 AS (SELECT *, unnest(range(1, ceil(5 * tp / 0.25)::BIGINT + 1)) AS step FROM (SELECT shed, a, 0.25::DOUBLE / 2 + 0.6::DOUBLE * tc / 60 AS tp FROM b)),
u1 AS (SELECT *, CASE WHEN step * 0.25 <= tp THEN 0.208::DOUBLE * a / tp * pow(step * 0.25 / tp, 2.3) ELSE 0.208::DOUBLE * a / tp * exp(-1.67::DOUBLE / tp * (step * 0.25 - tp)) END AS raw FROM u0),
un AS (SELECT shed, step, raw * a * 1000 / (sum(raw) OVER (PARTITION BY shed) * 900) AS q FROM u1),
fl AS (SELECT shed, ex.step + un.step - 1 AS step, sum(excess * q) AS q FROM ex JOIN un USING (shed) GROUP BY ALL),
ba AS (SELECT shed, max(q) AS peak, (arg_max(step, (q, -step)) * {STEP})::INT AS peak_min, sum(q) * 900 AS volume FROM fl GROUP BY shed), ef AS (SELECT shed, sum(excess) AS eff FROM ex GROUP BY shed)
SELECT inside.qid, b.id, round_even(a, 2) AS area_km2, cn, round_even(total * 100, 0) / 100 AS precip_mm, round_even(tc * 10, 0) / 10 AS tc_min, round_even(peak * 1000, 0) / 1000 AS peak_m3s, peak_min, round_even(volume, 0) AS volume_m3, round_even(eff * 100, 0) / 100 AS effective_mm, round_even(eff / total * 1000, 0) / 1000 AS runoff_coefficient
FROM inside JOIN b ON b.shed = inside.shed JOIN ba ON ba.shed = b.shed JOIN ef ON ef.shed = b.shed"""

QUERIES = {"generate_hydrograph": (generate_hydrograph, _HYDROGRAPH), "delineate": (delineate, _DELINEATE), "select_stream": (select_stream, _SELECT.replace("figures AS (", f"nodes AS MATERIALIZED ({watersheds.NODES}), figures AS (", 1))}
