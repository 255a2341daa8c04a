"""Queries over the drainage forest: closures, roll-ups, channels and indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import morphometry
from rillflow.functions.num import half_even
from rillflow.operators import forest, stats
from rillflow.plans.adapters import levels, sql, view


def _catch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = view(spark, sf_dir, "a_catch")
    return nodes, forest.resolve_edges(nodes, [])


def _starts(nodes: DataFrame) -> DataFrame:
    return nodes.select("id")


def parts(nodes: DataFrame) -> DataFrame:
    c = F.col
    return stats.roll_up_parts(nodes, c("area_milli"), c("elev_min_cm"), c("elev_max_cm"), c("elev_mean_cm"), c("slope_bp"), c("len_m"), c("strahler"))


def figures() -> dict:
    c, r = F.col, stats.ratio
    return {
        "n_segments": c("n"),
        "area_km2": half_even(c("area") / 1000, 6),
        "elev_min_m": half_even(c("low") / 100, 2),
        "elev_max_m": half_even(c("high") / 100, 2),
        "elev_mean_m": half_even(r(c("elev_x_area"), c("elev_area")) / 100, 2),
        "mean_slope": half_even(r(c("slope_x_area"), c("slope_area")) / 10000, 6),
        "length_km": half_even(c("length") / 1000, 4),
        "density": half_even(r(c("length"), c("area")), 4),
        "frequency": half_even(r(c("n") * 1000, c("area")), 4),
        "max_order": c("order"),
    }


_CLOSURE = f"""{sql("a_catch", recursive=True)},
up(start, id, steps) AS (
  SELECT id, id, 0::BIGINT FROM a_catch
  UNION ALL SELECT up.start, c.id, steps + 1 FROM up JOIN a_catch c ON c.down = up.id
)
"""
ROLL = """count(*) AS n_segments, round_even(sum(area_milli)::BIGINT / 1000, 6) AS area_km2,
  round_even(min(elev_min_cm) / 100, 2) AS elev_min_m, round_even(max(elev_max_cm) / 100, 2) AS elev_max_m,
  round_even(sum(elev_mean_cm * area_milli)::BIGINT / nullif(sum(area_milli) FILTER (elev_mean_cm IS NOT NULL), 0)::BIGINT / 100, 2) AS elev_mean_m,
  round_even(sum(slope_bp * area_milli)::BIGINT / nullif(sum(area_milli) FILTER (slope_bp IS NOT NULL), 0)::BIGINT / 10000, 6) AS mean_slope,
  round_even(coalesce(sum(len_m), 0)::BIGINT / 1000, 4) AS length_km,
  round_even(coalesce(sum(len_m), 0)::BIGINT / sum(area_milli)::BIGINT, 4) AS density,
  round_even(count(*) * 1000 / sum(area_milli)::BIGINT, 4) AS frequency, max(strahler) AS max_order"""


def upstream_closure(spark, sf_dir):
    nodes, edges = _catch(spark, sf_dir)
    return forest.closure(edges, _starts(nodes)).select("start", "id")


def upstream_to_confluence(spark, sf_dir):
    nodes, edges = _catch(spark, sf_dir)
    return forest.to_confluence(edges, _starts(nodes))


_CONFLUENCE = f"""{sql("a_catch", recursive=True)},
n_up AS MATERIALIZED (SELECT down AS id, count(*) AS n FROM a_catch WHERE down IS NOT NULL GROUP BY down),
up(start, id, grows) AS (
  SELECT id, id, true FROM a_catch
  UNION ALL SELECT up.start, c.id, coalesce(n, 0) <= 1 FROM up JOIN a_catch c ON c.down = up.id LEFT JOIN n_up ON n_up.id = c.id WHERE grows
) SELECT start, id FROM up"""


def watershed_rollup(spark, sf_dir):
    return rollup_all_nodes(spark, sf_dir).withColumnRenamed("id", "start")


def rollup_all_nodes(spark, sf_dir):
    nodes, edges = _catch(spark, sf_dir)
    sums = forest.subtree(parts(nodes), edges, stats.PARTS)
    return sums.select("id", *(v.alias(k) for k, v in figures().items()))


def main_channel(spark, sf_dir):
    return main_channels(spark, sf_dir, view(spark, sf_dir, "a_catch").select("id"))


def main_channels(spark, sf_dir, starts):
    """Length and slope of the channel that follows the main tributary up from each of ``starts`` (id)."""
    nodes, edges = _catch(spark, sf_dir)
    order = [F.col("strahler"), F.coalesce("len_m", F.lit(0)), F.col("area_milli")]
    best = forest.best_children(nodes.drop("down"), edges, order)
    path = forest.closure(best, starts).join(nodes, "id")
    ends = path.groupBy("start").agg(F.sum(F.coalesce("len_m", F.lit(0))).alias("m"), F.max_by("elev_max_cm", "steps").alias("top"), F.min_by("elev_min_cm", "steps").alias("bottom"), F.count("*").alias("n_segments"))
    slope = F.when(F.col("m") > 0, half_even((F.col("top") - F.col("bottom")) / 100 / F.col("m"), 6))
    return ends.select("start", "n_segments", half_even(F.col("m") / 1000, 4).alias("length_km"), slope.alias("slope"))


_CHANNEL = f"""{sql("a_catch", recursive=True)},
best AS MATERIALIZED (SELECT id, down FROM (SELECT *, row_number() OVER (PARTITION BY down ORDER BY strahler DESC, coalesce(len_m, 0) DESC, area_milli DESC, id) AS k FROM a_catch WHERE down IS NOT NULL) WHERE k = 1),
up(start, id, steps) AS (
  SELECT id, id, 0 FROM a_catch
  UNION ALL SELECT up.start, b.id, steps + 1 FROM up JOIN best b ON b.down = up.id
), p AS (SELECT up.start, up.steps, c.* FROM up JOIN a_catch c USING (id))
SELECT start, count(*) AS n_segments, round_even(sum(coalesce(len_m, 0))::BIGINT / 1000, 4) AS length_km,
  CASE WHEN sum(coalesce(len_m, 0)) > 0 THEN round_even((max_by(elev_max_cm, steps) - min_by(elev_min_cm, steps)) / 100 / sum(coalesce(len_m, 0))::BIGINT, 6) END AS slope
FROM p GROUP BY start"""


def threshold_cascade(spark, sf_dir):
    nodes = levels(spark, sf_dir).withColumn("node", F.struct("threshold", "id"))
    edges = forest.resolve_edges(nodes, ["threshold"]).select(F.struct("threshold", "id").alias("id"), F.struct("threshold", F.col("down").alias("id")).alias("down"))
    counts = forest.subtree(nodes.select(F.col("node").alias("id"), F.lit(1).cast("long").alias("n")), edges, {"n": "sum"}).select("id.threshold", "id.id", "n")
    return forest.choose_threshold(counts)


_CASCADE = f"""{sql("a_catch", "a_levels", recursive=True)},
up(threshold, start, id) AS (
  SELECT threshold, id, id FROM a_levels
  UNION ALL SELECT up.threshold, up.start, c.id FROM up JOIN a_levels c ON c.down = up.id AND c.threshold = up.threshold
), n AS (SELECT start AS id, threshold, count(*) AS n FROM up GROUP BY ALL)
SELECT id, threshold, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (n > 500)::INT, CASE WHEN n > 500 THEN -threshold ELSE threshold END) AS k FROM n) WHERE k = 1"""


def graph_integrity(spark, sf_dir):
    nodes = levels(spark, sf_dir)
    return forest.integrity(nodes.select("threshold", "id", "down"), nodes.where("id % 89 <> 0").select("threshold", "id"))


_INTEGRITY = f"""{sql("a_catch", "a_levels")}, u AS (SELECT DISTINCT a.threshold, a.down AS id FROM a_levels a JOIN a_levels b ON b.threshold = a.threshold AND b.id = a.down)
SELECT a.threshold, count(*) AS nodes, count(u.id) AS with_upstream, count(*) FILTER (down IS NULL) AS outlets, count(DISTINCT a.id) AS distinct_ids,
  count(*) FILTER (a.id % 89 = 0) AS missing, count(*) = count(DISTINCT a.id) AND count(*) FILTER (a.id % 89 = 0) = 0 AS ok
FROM a_levels a LEFT JOIN u ON u.threshold = a.threshold AND u.id = a.id GROUP BY a.threshold"""


def missing_catchments_anti(spark, sf_dir):
    nodes = levels(spark, sf_dir)
    return forest.without_catchment(nodes, nodes.where("id % 89 <> 0").select("threshold", "id"))


def edge_resolve(spark, sf_dir):
    return forest.resolve_edges(levels(spark, sf_dir), ["threshold"])


def _indices(spark, sf_dir):
    """One row per catchment with the measures that indices need."""
    c = F.col
    return view(spark, sf_dir, "a_catch").select("id", (c("area_milli") / 1000).alias("a"), ((20 + c("id") % 400) / 10).alias("p"), (c("len_m") / 1000).alias("l"), (c("elev_min_cm") / 100).alias("low"), (c("elev_mean_cm") / 100).alias("mean"), (c("elev_max_cm") / 100).alias("high"))


def shape_indices(spark, sf_dir):
    c = F.col
    return _indices(spark, sf_dir).select("id", *(v.alias(k) for k, v in morphometry.shape(c("a"), c("p"), c("l")).items()))


def relief_indices(spark, sf_dir):
    c = F.col
    return _indices(spark, sf_dir).select("id", *(v.alias(k) for k, v in morphometry.relief(c("low"), c("mean"), c("high"), c("l")).items()))


def drainage_indices(spark, sf_dir):
    c = F.col
    return _indices(spark, sf_dir).select("id", *(v.alias(k) for k, v in morphometry.drainage(c("a"), c("l"), F.lit(1), c("low"), c("high")).items()))


_MEASURES = f"""{sql("a_catch")}, m AS (SELECT id, area_milli / 1000 AS a, (20 + id % 400) / 10 AS p, len_m / 1000 AS l, elev_min_cm / 100 AS low, elev_mean_cm / 100 AS mean, elev_max_cm / 100 AS high FROM a_catch)"""


def stream_info(spark, sf_dir):
    return levels(spark, sf_dir).where("threshold = 10000").select("threshold", "id", "down", "strahler", "len_m")


def hypsometric_merge(spark, sf_dir):
    nodes, edges = _catch(spark, sf_dir)
    bins = nodes.select("id", F.expr("explode(array(named_struct('bin', elev_min_cm div 100, 'count', 1 + id % 7), named_struct('bin', elev_min_cm div 100 + 1, 'count', 2 + id % 5), named_struct('bin', elev_max_cm div 100, 'count', 1 + id % 3)))").alias("b")).select("id", "b.*")
    members = forest.closure(edges, _starts(nodes)).select("start", "id").join(bins, "id")
    return stats.hypsometric_merge(members, ["start"]).select("start", "step", half_even(F.col("height"), 4).alias("height"), half_even(F.col("fraction"), 6).alias("fraction"))


_HYPSO = f"""{_CLOSURE}, b AS (
  SELECT start, unnest([elev_min_cm // 100, elev_min_cm // 100 + 1, elev_max_cm // 100]) AS bin, unnest([1 + c.id % 7, 2 + c.id % 5, 1 + c.id % 3]) AS n FROM up JOIN a_catch c USING (id)
), h AS MATERIALIZED (SELECT start, bin, sum(n)::BIGINT AS n FROM b GROUP BY ALL), t AS MATERIALIZED (SELECT start, min(bin) AS low, max(bin) AS high, sum(n)::BIGINT AS total FROM h GROUP BY start),
s AS (SELECT *, CASE WHEN low = high AND step > 0 THEN high + 1 ELSE low + ceil((high - low) * step / 20)::BIGINT END AS edge FROM t, range(0, 21) AS r(step) WHERE low < high OR step IN (0, 20))
SELECT start, step::INT AS step, round_even(step / 20, 4) AS height, round_even(coalesce((SELECT sum(n) FROM h WHERE h.start = s.start AND bin >= edge), 0)::BIGINT / total, 6) AS fraction FROM s"""


NODES = f"{sql('a_catch')} SELECT * FROM a_catch"

QUERIES = {
    "upstream_closure": (upstream_closure, f"{_CLOSURE} SELECT start, id FROM up"),
    "upstream_to_confluence": (upstream_to_confluence, _CONFLUENCE),
    "watershed_rollup": (watershed_rollup, f"{_CLOSURE} SELECT start, {ROLL} FROM up JOIN a_catch USING (id) GROUP BY start"),
    "rollup_all_nodes": (rollup_all_nodes, f"{_CLOSURE} SELECT start AS id, {ROLL} FROM up JOIN a_catch USING (id) GROUP BY start"),
    "main_channel": (main_channel, _CHANNEL),
    "threshold_cascade": (threshold_cascade, _CASCADE),
    "graph_integrity": (graph_integrity, _INTEGRITY),
    "missing_catchments_anti": (missing_catchments_anti, f"{sql('a_catch', 'a_levels')} SELECT threshold, count(*) AS missing FROM a_levels WHERE id % 89 = 0 GROUP BY threshold"),
    "edge_resolve": (edge_resolve, f"{sql('a_catch', 'a_levels')} SELECT a.threshold, a.id, a.down FROM a_levels a JOIN a_levels b ON a.threshold = b.threshold AND a.down = b.id"),
    "shape_indices": (
        shape_indices,
        f"{_MEASURES} SELECT id, CASE WHEN l > 0 THEN round_even(p / (2 * sqrt(pi() * a)), 4) END AS compactness, CASE WHEN l > 0 THEN round_even(4 * pi() * a / (p * p), 4) END AS circularity, CASE WHEN l > 0 THEN round_even(2 / l * sqrt(a / pi()), 4) END AS elongation, CASE WHEN l > 0 THEN round_even(a / (l * l), 4) END AS form_factor, CASE WHEN l > 0 THEN round_even(a / l, 4) END AS mean_width_km FROM m",
    ),
    "relief_indices": (relief_indices, f"{_MEASURES} SELECT id, CASE WHEN l > 0 AND high > low THEN round_even((high - low) / (l * 1000), 6) END AS relief_ratio, CASE WHEN high > low THEN round_even((mean - low) / (high - low), 4) END AS hypsometric_integral FROM m"),
    "drainage_indices": (
        drainage_indices,
        f"{_MEASURES} SELECT id, round_even(l / a, 4) AS drainage_density, round_even(1 / a, 4) AS stream_frequency, CASE WHEN high > low THEN round_even((high - low) / 1000 * (l / a), 4) END AS ruggedness FROM m",
    ),
    "stream_info": (stream_info, f"{sql('a_catch', 'a_levels')} SELECT threshold, id, down, strahler, len_m FROM a_levels WHERE threshold = 10000"),
    "hypsometric_merge": (hypsometric_merge, _HYPSO),
}
