"""Queries of the storm model and of map sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions.num import half_even
from rillflow.functions.sheets import sheet_code as code_of
from rillflow.operators import hydrograph
from rillflow.plans.adapters import sql, view

#: Minutes of a time step.
STEP = 15


def _storms(spark, sf_dir):
    """One storm per shed: total in mm, steps, curve number."""
    return view(spark, sf_dir, "a_sheds").selectExpr("qid", "cast(20 + qid * 3 as double) AS total", "8 + qid % 5 * 4 AS steps", "55 + qid AS cn")


_STORMS = f"{sql('a_sheds')}, storms AS MATERIALIZED (SELECT qid, (20 + qid * 3)::DOUBLE AS total, 8 + qid % 5 * 4 AS steps, 55 + qid AS cn FROM a_sheds)"
_BETA = f"""{_STORMS}, k AS (SELECT *, step / steps AS t1, (step - 1) / steps AS t0 FROM (SELECT *, unnest(range(1, steps + 1)) AS step FROM storms)),
beta AS MATERIALIZED (SELECT qid, total, steps, cn, step, total * ((1 - pow(1 - t1, 6) - 6 * t1 * pow(1 - t1, 5)) - (1 - pow(1 - t0, 6) - 6 * t0 * pow(1 - t0, 5))) AS depth FROM k)"""


def hyetograph(spark, sf_dir):
    storms = _storms(spark, sf_dir)
    parts = [hydrograph.hyetograph(storms, m, ["qid"]).select(F.lit(m).alias("method"), "qid", "step", half_even(F.col("depth"), 6).alias("depth")) for m in ("beta", "block", "euler2")]
    return parts[0].union(parts[1]).union(parts[2])


_HYETO = f"""{_BETA}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY depth DESC, step) AS k, greatest(ceil(steps * 0.33), 1)::INT AS peak FROM beta)
SELECT 'beta' AS method, qid, step::INT AS step, round_even(depth * 1000000, 0) / 1000000 AS depth FROM beta
UNION ALL SELECT 'block', qid, step::INT, round_even(total / steps * 1000000, 0) / 1000000 FROM beta
UNION ALL SELECT 'euler2', qid, (CASE WHEN k <= peak THEN peak - k + 1 ELSE k END)::INT, round_even(depth * 1000000, 0) / 1000000 FROM r"""


def _excess(spark, sf_dir):
    storms = _storms(spark, sf_dir)
    rain = hydrograph.hyetograph(storms, "beta", ["qid"]).join(storms.select("qid", "cn"), "qid")
    return hydrograph.effective_rain(rain, ["qid"])


def scs_cn_runoff(spark, sf_dir):
    return _excess(spark, sf_dir).select("qid", "step", half_even(F.col("depth"), 6).alias("depth"), half_even(F.col("excess"), 6).alias("excess"))


_EXCESS = f"""{_BETA}, c AS (SELECT *, 25.4::DOUBLE * (1000 / cn - 10) AS s, sum(depth) OVER (PARTITION BY qid ORDER BY step ROWS UNBOUNDED PRECEDING) AS p FROM beta),
q AS (SELECT *, CASE WHEN p > 0.2::DOUBLE * s THEN (p - 0.2::DOUBLE * s) * (p - 0.2::DOUBLE * s) / (p + 0.8::DOUBLE * s) ELSE 0 END AS runoff FROM c),
excess AS MATERIALIZED (SELECT qid, step, depth, runoff - coalesce(lag(runoff) OVER (PARTITION BY qid ORDER BY step), 0) AS excess FROM q)"""


def _basins(spark, sf_dir):
    return view(spark, sf_dir, "a_sheds").selectExpr("qid", "cast(2 + qid as double) AS area_km2", "cast(40 + qid * 7 as double) AS tc_min")


def unit_hydrograph(spark, sf_dir):
    unit = hydrograph.unit_hydrograph(_basins(spark, sf_dir), ["qid"], STEP)
    return unit.select("qid", "step", half_even(F.col("q"), 6).alias("q"))


_UNIT = """b AS (SELECT qid, (2 + qid)::DOUBLE AS a, 0.25::DOUBLE / 2 + 0.6::DOUBLE * (40 + qid * 7) / 60 AS tp FROM a_sheds),
u0 AS (SELECT *, unnest(range(1, ceil(5 * tp / 0.25)::BIGINT + 1)) AS step FROM b),
u1 AS (SELECT *, CASE WHEN step * 0.25 <= tp THEN 0.208::DOUBLE * a / tp * pow(step * 0.25 / tp, 2.3) ELSE 0.208::DOUBLE * a / tp * exp(-1.67::DOUBLE / tp * (step * 0.25 - tp)) END AS raw FROM u0),
unit AS MATERIALIZED (SELECT qid, step, raw * a * 1000 / (sum(raw) OVER (PARTITION BY qid) * 900) AS q FROM u1)"""


def hydrograph_convolution(spark, sf_dir):
    unit = hydrograph.unit_hydrograph(_basins(spark, sf_dir), ["qid"], STEP)
    flow = hydrograph.convolve(_excess(spark, sf_dir), unit, ["qid"], ["qid"])
    return flow.select("qid", "step", half_even(F.col("q"), 5).alias("q"))


def water_balance(spark, sf_dir):
    unit = hydrograph.unit_hydrograph(_basins(spark, sf_dir), ["qid"], STEP)
    flow = hydrograph.convolve(_excess(spark, sf_dir), unit, ["qid"], ["qid"])
    return hydrograph.balance(flow, ["qid"], STEP).select("qid", half_even(F.col("peak"), 4).alias("peak"), "peak_min", half_even(F.col("volume_m3"), 1).alias("volume_m3"))


_FLOWQ = f"{_EXCESS}, {_UNIT}, flow AS (SELECT e.qid, e.step + u.step - 1 AS step, sum(excess * q) AS q FROM excess e JOIN unit u USING (qid) GROUP BY ALL)"


def concentration_times(spark, sf_dir):
    c = F.col
    rows = view(spark, sf_dir, "a_catch").withColumn("slope_bp", F.expr("nullif(slope_bp, 0)"))
    args = (c("len_m").cast("double"), c("slope_bp") / 10000, (40 + c("id") % 50).cast("double"), c("area_milli") / 1000, c("elev_mean_cm") / 100, c("elev_min_cm") / 100)
    return rows.select("id", *(half_even(hydrograph.concentration(m, *args), 4).alias(m) for m in ("kirpich", "scs_lag", "giandotti")))


_TC = f"""{sql("a_catch")} SELECT id, round_even(0.0195::DOUBLE * pow(len_m, 0.77) * pow(slope_bp / 10000, -0.385) * 10000, 0) / 10000 AS kirpich,
  round_even(0.057::DOUBLE * pow(len_m, 0.8) * pow(1000 / (40 + id % 50) - 9, 0.7) / sqrt(slope_bp / 10000) / 0.6::DOUBLE * 10000, 0) / 10000 AS scs_lag,
  round_even(60 * (4 * sqrt(area_milli / 1000) + 1.5::DOUBLE * len_m / 1000) / (0.8::DOUBLE * sqrt(elev_mean_cm / 100 - elev_min_cm / 100)) * 10000, 0) / 10000 AS giandotti
FROM (SELECT * REPLACE (nullif(slope_bp, 0) AS slope_bp) FROM a_catch)"""


def places(spark, sf_dir):
    return view(spark, sf_dir, "a_stations").selectExpr("id", "49 + (id * 7919 % 6000) / 1000 AS lat", "14 + (id * 104729 % 10500) / 1000 AS lon")


def sheet_code(spark, sf_dir):
    return places(spark, sf_dir).select("id", code_of(F.col("lat"), F.col("lon")).alias("code"), code_of(F.col("lat"), F.col("lon"), "1:100000").alias("code_100k"))


def _division(n: int, rows: int, cols: int) -> str:
    """The next subdivision in SQL, from d{n-1} (top, west, height, width) to d{n} (row, col, ...)."""
    return f"""p{n} AS (SELECT *, least(greatest(floor((top - lat) / (hh / {rows})), 0), {rows - 1})::BIGINT AS row{n}, least(greatest(floor((lon - west) / (ww / {cols})), 0), {cols - 1})::BIGINT AS col{n} FROM d{n - 1}),
d{n} AS (SELECT * REPLACE (top - row{n} * (hh / {rows}) AS top, west + col{n} * (ww / {cols}) AS west, hh / {rows} AS hh, ww / {cols} AS ww) FROM p{n})"""


def sheets_sql(points: str) -> str:
    """WITH list that ends in t (id, code, code_100k, top, west, hh, ww) of the rows (id, lat, lon) of ``points`` inside the grid."""
    return f"""d0 AS (SELECT id, lat, lon, (floor(lat / 4) + 1) * 4.0::DOUBLE AS top, floor(lon / 6) * 6.0::DOUBLE AS west, 4.0::DOUBLE AS hh, 6.0::DOUBLE AS ww FROM ({points}) WHERE lat BETWEEN 49 AND 55 AND lon BETWEEN 14 AND 24.5),
{_division(1, 12, 12)}, {_division(2, 2, 2)}, {_division(3, 2, 2)}, {_division(4, 2, 4)},
n AS (SELECT *, substr('ABCDEFGHJKLMNPQRSTUV', (floor(lat / 4) - 1)::INT + 1, 1) || '-' || (floor((lon + 180) / 6) + 1)::INT || '-' || lpad((row1 * 12 + col1 + 1)::VARCHAR, 3, '0') AS code_100k, substr('ABCD', (row2 * 2 + col2)::INT + 1, 1) AS b, substr('abcd', (row3 * 2 + col3)::INT + 1, 1) AS c FROM d4),
t AS (SELECT id, code_100k || '-' || b || '-' || c || '-' || (row4 + 1) || '-' || (col4 + 1) AS code, code_100k, top, west, hh, ww FROM n)"""


PLACES = "SELECT id, 49 + (id * 7919 % 6000) / 1000 AS lat, 14 + (id * 104729 % 10500) / 1000 AS lon FROM a_stations"
_SHEET = f"{sql('a_stations')}, {sheets_sql(PLACES)} SELECT id, code, code_100k FROM t"

QUERIES = {
    "hyetograph": (hyetograph, _HYETO),
    "scs_cn_runoff": (scs_cn_runoff, f"{_EXCESS} SELECT qid, step::INT AS step, round_even(depth * 1000000, 0) / 1000000 AS depth, round_even(excess * 1000000, 0) / 1000000 AS excess FROM excess"),
    "unit_hydrograph": (unit_hydrograph, f"{sql('a_sheds')}, {_UNIT} SELECT qid, step::INT AS step, round_even(q * 1000000, 0) / 1000000 AS q FROM unit"),
    "hydrograph_convolution": (hydrograph_convolution, f"{_FLOWQ} SELECT qid, step::INT AS step, round_even(q * 100000, 0) / 100000 AS q FROM flow"),
    "water_balance": (water_balance, f"{_FLOWQ} SELECT qid, round_even(max(q) * 10000, 0) / 10000 AS peak, (arg_max(step, (q, -step)) * 15)::INT AS peak_min, round_even(sum(q) * 900 * 10, 0) / 10 AS volume_m3 FROM flow GROUP BY qid"),
    "concentration_times": (concentration_times, _TC),
    "sheet_code": (sheet_code, _SHEET),
}
