"""Curve numbers from land cover and soil."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.num import half_even

DEFAULT_CN = 75

#: Curve numbers of soil groups A, B, C and D by land cover.
CURVE_NUMBERS: dict[str, tuple[int, int, int, int]] = {
    "forest": (30, 55, 70, 77),
    "las": (30, 55, 70, 77),
    "PTLZ": (30, 55, 70, 77),
    "meadow": (30, 58, 71, 78),
    "łąka": (30, 58, 71, 78),
    "PTZB": (30, 58, 71, 78),
    "arable": (72, 81, 88, 91),
    "grunt_orny": (72, 81, 88, 91),
    "PTUT": (72, 81, 88, 91),
    "PTRK": (72, 81, 88, 91),
    "urban_residential": (77, 85, 90, 92),
    "zabudowa_mieszkaniowa": (77, 85, 90, 92),
    "BUBD": (77, 85, 90, 92),
    "urban_commercial": (89, 92, 94, 95),
    "zabudowa_przemysłowa": (89, 92, 94, 95),
    "BUIN": (89, 92, 94, 95),
    "road": (98, 98, 98, 98),
    "droga": (98, 98, 98, 98),
    "SKDR": (98, 98, 98, 98),
    "SKJZ": (98, 98, 98, 98),
    "water": (100, 100, 100, 100),
    "woda": (100, 100, 100, 100),
    "PTWP": (100, 100, 100, 100),
    "SWRS": (100, 100, 100, 100),
    "11": (89, 92, 94, 95),
    "12": (89, 92, 94, 95),
    "13": (98, 98, 98, 98),
    "14": (49, 69, 79, 84),
    "21": (72, 81, 88, 91),
    "22": (72, 81, 88, 91),
    "23": (39, 61, 74, 80),
    "24": (62, 71, 78, 81),
    "31": (30, 55, 70, 77),
    "32": (30, 58, 71, 78),
    "33": (77, 86, 91, 94),
    "41": (100, 100, 100, 100),
    "42": (100, 100, 100, 100),
    "51": (100, 100, 100, 100),
    "52": (100, 100, 100, 100),
    "other": (60, 70, 80, 85),
    "inny": (60, 70, 80, 85),
    "unknown": (60, 70, 80, 85),
}
#: Category, curve number and imperviousness of imported land-cover classes.
CLASSES: dict[str, tuple[str, int, float]] = {
    "PTLZ": ("las", 60, 0.0),
    "PTTR": ("grunt_orny", 78, 0.1),
    "PTUT": ("grunt_orny", 78, 0.1),
    "PTWP": ("woda", 100, 1.0),
    "PTWZ": ("łąka", 70, 0.0),
    "PTRK": ("łąka", 70, 0.0),
    "PTZB": ("zabudowa_mieszkaniowa", 85, 0.5),
    "PTKM": ("droga", 98, 0.95),
    "PTPL": ("droga", 98, 0.95),
    "PTGN": ("inny", 75, 0.2),
    "PTNZ": ("inny", 75, 0.2),
    "PTSO": ("inny", 75, 0.2),
}
DEFAULT_CLASS = ("inny", 75, 0.2)
GROUPS = "ABCD"


def lookup_cn(df: DataFrame, cover: str, hsg: str) -> DataFrame:
    """``df`` with column cn; an unknown cover counts as "other", an unknown soil group as B."""
    spark: SparkSession = df.sparkSession
    rows = [(k, g, v[i]) for k, v in CURVE_NUMBERS.items() for i, g in enumerate(GROUPS)]
    table = F.broadcast(spark.createDataFrame(rows, "cover_key string, hsg_key string, cn int"))  # a fixed table
    known = F.coalesce(F.when(F.col(cover).isin(*CURVE_NUMBERS), F.col(cover)), F.lit("other"))
    group = F.coalesce(F.when(F.upper(F.col(hsg)).isin(*GROUPS), F.upper(F.col(hsg))), F.lit("B"))
    return df.withColumns({"cover_key": known, "hsg_key": group}).join(table, ["cover_key", "hsg_key"]).drop("cover_key", "hsg_key")


def classify(df: DataFrame, layer: str) -> DataFrame:
    """``df`` with class, category, cn and imperviousness of a layer name; unknown classes get the default."""
    # the first part of the name, between underscores, that has four letters and begins with PT
    found = F.get(F.filter(F.split(F.upper(layer), "_"), lambda part: part.rlike("^PT[A-Z]{2}$")), F.lit(0))
    rows = [(k, *v) for k, v in CLASSES.items()]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "class string, category string, cn int, imperviousness double"))
    joined = df.withColumn("class", found).join(table, "class", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(("category", "cn", "imperviousness"), DEFAULT_CLASS, strict=True)})


def weighted_cn(shares: DataFrame, keys: list[str], area: str = "area", clamp: bool = True) -> DataFrame:
    """(keys, cn): area-weighted curve number as a whole number, DEFAULT_CN without area; clamped to 0..100 if asked."""
    sums = shares.groupBy(*keys).agg(F.sum(F.col("cn") * F.col(area)).alias("s"), F.sum(area).alias("a"))
    cn = F.when(F.col("a") > 0, F.rint(F.col("s") / F.col("a")).cast("int")).otherwise(F.lit(DEFAULT_CN))
    return sums.select(*keys, (F.least(F.greatest(cn, F.lit(0)), F.lit(100)) if clamp else cn).alias("cn"))


def cn_of_boundaries(boundaries: DataFrame, shares: DataFrame, keys: list[str], area: str = "area") -> DataFrame:
    """(keys, cn, stats) of every row of ``boundaries``: the weighted curve number, and the share of each curve number as
    array of struct(cn, pct), smallest first. Boundaries without cover have DEFAULT_CN and an empty array."""
    parts = shares.where(F.col(area) > 0).groupBy(*keys, "cn").agg(F.sum(area).alias("a"))
    total = F.sum("a").over(Window.partitionBy(*keys))
    each = parts.withColumn("pct", half_even(F.col("a") * 100 / total, 1))
    found = each.groupBy(*keys).agg(F.rint(F.sum(F.col("cn") * F.col("a")) / F.sum("a")).cast("int").alias("cn"), F.array_sort(F.collect_list(F.struct("cn", "pct"))).alias("stats"))
    value = F.least(F.greatest(F.coalesce("cn", F.lit(DEFAULT_CN)), F.lit(0)), F.lit(100))
    return boundaries.select(*keys).join(found, keys, "left").select(*keys, value.alias("cn"), F.coalesce("stats", F.array().cast("array<struct<cn: int, pct: double>>")).alias("stats"))


def cn_from_percentages(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cn) from rows (pct, cn): percentages are scaled to 100 if they are off by over 0.1."""
    sums = df.groupBy(*keys).agg(F.sum(F.col("pct") * F.col("cn")).alias("s"), F.sum("pct").alias("p"))
    mean = F.when(F.abs(F.col("p") - 100) > 0.1, F.col("s") / F.col("p")).otherwise(F.col("s") / 100)
    return sums.select(*keys, F.least(F.greatest(F.when(F.col("p") > 0, F.rint(mean).cast("int")).otherwise(F.lit(DEFAULT_CN)), F.lit(0)), F.lit(100)).alias("cn"))


def cascade(**sources: Column) -> tuple[Column, Column]:
    """(value, name) of the first source that isn't null, in the order given; else the default."""
    value, name = F.lit(DEFAULT_CN), F.lit("default")
    for k, v in reversed(sources.items()):
        value, name = F.coalesce(v, value), F.when(v.isNotNull(), k).otherwise(name)
    return value, name


def shares(df: DataFrame, keys: list[str], group: str, area: str = "area") -> DataFrame:
    """(keys, group, area, pct, rank): area and percentage of each group, largest first, ties by group."""
    sums = df.groupBy(*keys, group).agg(F.sum(area).alias("area"))
    total = F.sum("area").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), group))
    return sums.select(*keys, group, "area", half_even(F.when(total != 0, F.col("area") * 100 / total), 1).alias("pct"), rank.alias("rank"))


def breakdown(df: DataFrame, keys: list[str], area: str = "area") -> DataFrame:
    """Area and share of each (category, cn, imperviousness) in ``keys``, with the totals of the key.

    The mean curve number is not clamped; a null imperviousness is a class of its own and counts as 0 in the mean.
    """
    kinds = df.groupBy(*keys, "category", "cn", "imperviousness").agg(F.sum(area).alias("a"))
    over = Window.partitionBy(*keys)
    total, a = F.sum("a").over(over), F.col("a")
    rank = F.row_number().over(over.orderBy(F.desc("a"), "category", "cn", "imperviousness"))
    rows = kinds.withColumns({"total": total, "s": F.sum(F.col("cn") * a).over(over), "i": F.sum(F.coalesce("imperviousness", F.lit(0.0)) * a).over(over), "rank": rank}).where("total > 0")
    t = F.col("total")
    return rows.select(*keys, "rank", "category", "cn", "imperviousness", half_even(a, 1).alias("area_m2"), half_even(a / t * 100, 1).alias("pct"), half_even(t, 1).alias("total_m2"), F.rint(F.col("s") / t).cast("int").alias("weighted_cn"), half_even(F.col("i") / t, 3).alias("weighted_imperviousness"))
