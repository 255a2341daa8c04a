"""Storm hydrographs: rain over time, losses, unit hydrograph and convolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PEAK_AT = 0.33


def concentration(method: str, length_m: Column, slope: Column, cn: Column, area_km2: Column, mean_m: Column, low_m: Column) -> Column:
    """Time of concentration in minutes."""
    if method == "kirpich":
        return 0.0195 * F.pow(length_m, F.lit(0.77)) * F.pow(slope, F.lit(-0.385))
    if method == "scs_lag":
        return 0.057 * F.pow(length_m, F.lit(0.8)) * F.pow(1000 / cn - 9, F.lit(0.7)) / F.sqrt(slope) / 0.6
    if method == "giandotti":
        return 60 * (4 * F.sqrt(area_km2) + 1.5 * length_m / 1000) / (0.8 * F.sqrt(mean_m - low_m))
    raise ValueError(f"no method {method}")


def beta_cdf(t: Column) -> Column:
    """Distribution function of Beta(2, 5)."""
    return 1 - F.pow(1 - t, F.lit(6)) - 6 * t * F.pow(1 - t, F.lit(5))


def hyetograph(storms: DataFrame, method: str, keys: list[str]) -> DataFrame:
    """(keys, step, depth) from storms (keys, total, steps); the depths of a storm sum to its total.

    beta: increments of Beta(2, 5); block: equal; euler2: the beta increments with the largest
    at PEAK_AT of the time, smaller ones before it towards the start, the rest after it.
    """
    each = storms.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps").cast("int"))))
    if method == "block":
        return each.select(*keys, "step", (F.col("total") / F.col("steps")).alias("depth"))
    part = F.col("total") * (beta_cdf(F.col("step") / F.col("steps")) - beta_cdf((F.col("step") - 1) / F.col("steps")))
    beta = each.withColumn("depth", part)
    if method == "beta":
        return beta.select(*keys, "step", "depth")
    if method != "euler2":
        raise ValueError(f"no method {method}")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("depth"), "step"))
    peak = F.greatest(F.ceil(F.col("steps") * PEAK_AT), F.lit(1)).cast("int")
    # the largest stands at the peak, the next ones go backwards to the start
    place = F.when(F.col("rank") <= F.col("peak"), F.col("peak") - F.col("rank") + 1).otherwise(F.col("rank"))
    return beta.withColumns({"rank": rank, "peak": peak}).select(*keys, place.alias("step"), "depth")


def retention(cn: Column) -> Column:
    return 25.4 * (1000 / cn - 10)


def effective_rain(rain: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, depth, excess): runoff of each step from rows with cn, by the curve-number method on running sums."""
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    s = retention(F.col("cn"))
    total = F.sum("depth").over(w)
    runoff = F.when(total > 0.2 * s, (total - 0.2 * s) * (total - 0.2 * s) / (total + 0.8 * s)).otherwise(0.0)
    before = F.lag("runoff", 1, 0.0).over(Window.partitionBy(*keys).orderBy("step"))
    return rain.withColumn("runoff", runoff).withColumn("excess", F.col("runoff") - before).drop("runoff")


def unit_hydrograph(basins: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """(keys, step, q): flow in m3/s for 1 mm of runoff, from rows (keys, area_km2, tc_min).

    Rise with power 2.3 to tp = dt/2 + 0.6 tc, recession with 1.67/tp over five tp; ordinates
    are scaled so that their volume is 1 mm on the area.
    """
    dt = minutes / 60
    tp = dt / 2 + 0.6 * F.col("tc_min") / 60
    base = basins.withColumn("tp", tp).withColumn("step", F.explode(F.sequence(F.lit(1), F.ceil(5 * F.col("tp") / dt).cast("int"))))
    t = F.col("step") * dt
    peak = 0.208 * F.col("area_km2") / F.col("tp")
    raw = F.when(t <= F.col("tp"), peak * F.pow(t / F.col("tp"), F.lit(2.3))).otherwise(peak * F.exp(-1.67 / F.col("tp") * (t - F.col("tp"))))
    shaped = base.withColumn("raw", raw)
    volume = F.sum("raw").over(Window.partitionBy(*keys)) * minutes * 60
    return shaped.select(*keys, "step", (F.col("raw") * F.col("area_km2") * 1000 / volume).alias("q"))


def convolve(excess: DataFrame, unit: DataFrame, storm_keys: list[str], basin_keys: list[str]) -> DataFrame:
    """(storm_keys, step, q): sum of excess(i) x unit(j) over i + j - 1 = step."""
    pairs = excess.select(*storm_keys, F.col("step").alias("i"), "excess").join(unit.select(*basin_keys, F.col("step").alias("j"), F.col("q").alias("u")), basin_keys)
    return pairs.groupBy(*storm_keys, (F.col("i") + F.col("j") - 1).alias("step")).agg(F.sum(F.col("excess") * F.col("u")).alias("q"))


def balance(flow: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """(keys, peak, peak_min, volume_m3): largest flow, its time, and the volume under the steps."""
    return flow.groupBy(*keys).agg(F.max("q").alias("peak"), (F.max_by("step", F.struct("q", -F.col("step"))) * minutes).alias("peak_min"), (F.sum("q") * minutes * 60).alias("volume_m3"))


def scenarios(storms: DataFrame, multipliers: tuple[float, ...] = (0.6, 0.8, 1.0, 1.2, 1.5)) -> DataFrame:
    """Each storm at several shares of its total."""
    return storms.withColumn("multiplier", F.explode(F.array(*(F.lit(m) for m in multipliers)))).withColumn("total", F.col("total") * F.col("multiplier"))


def peak_without_convolution(unit_peak: Column, runoff_mm: Column) -> Column:
    return unit_peak * runoff_mm


def design_peak_area(area_km2: Column) -> Column:
    """Whether the curve-number model may be used: up to 250 km2."""
    return (area_km2 > 0) & (area_km2 <= 250)

