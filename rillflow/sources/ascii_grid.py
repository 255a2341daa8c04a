"""ASCII grids (.asc) as long-form cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODATA = -9999.0
_KEYS = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.asc").select(F.input_file_name().alias("path"), F.expr("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, ncols, nrows, x0, y0, cellsize, nodata, xmax, ymax) of each grid under ``path``.

    Keys in any case; a centre is shifted to its corner; without a no-data value it is -9999.
    Files without a header are left out.
    """
    # one small aggregate over the lines that start with a letter, split or whole files alike
    pair = F.split("line", r"\s+")
    keyed = _lines(spark, path).where(F.col("line").rlike("^[A-Za-z_]+\\s")).select("path", F.lower(pair[0]).alias("k"), F.expr("try_cast(split(line, '\\\\s+')[1] as double)").alias("v"))
    rows = keyed.groupBy("path").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in _KEYS)).where("ncols is not null and nrows is not null and cellsize is not null")
    x0 = F.coalesce("xllcorner", F.col("xllcenter") - F.col("cellsize") / 2)
    y0 = F.coalesce("yllcorner", F.col("yllcenter") - F.col("cellsize") / 2)
    sized = rows.select("path", F.col("ncols").cast("int").alias("ncols"), F.col("nrows").cast("int").alias("nrows"), x0.alias("x0"), y0.alias("y0"), "cellsize", F.coalesce("nodata_value", F.lit(NODATA)).alias("nodata"))
    return sized.withColumns({"xmax": F.col("x0") + F.col("ncols") * F.col("cellsize"), "ymax": F.col("y0") + F.col("nrows") * F.col("cellsize")})


def discover(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Headers of the grids that touch a box (xmin, ymin, xmax, ymax), those under ``reprojected/`` left out."""
    found = headers(spark, path).where(~F.col("path").contains("/reprojected/"))
    if box is None:
        return found
    return found.where((F.col("x0") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("y0") <= box[3]) & (F.col("ymax") >= box[1]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, x, y, z) of every cell, x and y at its centre, z null for no data; a shape that differs from the header is an error.

    Files are read line by line, so that a large grid is no single value in memory.
    """
    head = headers(spark, path)
    lines = _lines(spark, path)
    data = lines.where(F.col("line").rlike(r"(?i)^([-+0-9.]|nan\b)"))
    rows = data.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("block", "at")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("path"))).withColumn("v", F.split("line", r"\s+"))
    joined = rows.join(head, "path")
    checked = joined.withColumn("v", F.when((F.size("v") == F.col("ncols")) & (F.col("n") == F.col("nrows")), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("the shape differs from the header in "), F.col("path"))).cast("array<string>")))
    cells = checked.select("path", "r", "ncols", "nrows", "x0", "y0", "cellsize", "nodata", F.posexplode("v").alias("c", "t"))
    z = F.col("t").cast("double")
    return cells.select("path", "r", "c", (F.col("x0") + (F.col("c") + 0.5) * F.col("cellsize")).alias("x"), (F.col("y0") + (F.col("nrows") - F.col("r") - 0.5) * F.col("cellsize")).alias("y"), F.when(z != F.col("nodata"), z).alias("z"))


def zone(x: Column) -> Column:
    """Projection zone of an easting: millions digit 5 to 8, else null for the single-zone system."""
    digit = F.floor(x / 1_000_000)
    return F.when((x > 1_000_000) & digit.between(5, 8), digit.cast("int"))


def compatible(head: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(n_files, cellsize, same_size, same_zone) over the headers of a mosaic."""
    zones = F.count_distinct(F.coalesce(zone(F.col("x0")), F.lit(0)))
    return head.agg(F.count("*").alias("n_files"), F.min("cellsize").alias("cellsize"), (F.max("cellsize") - F.min("cellsize") <= tolerance).alias("same_size"), (zones == 1).alias("same_zone"))


def mosaic_info(head: DataFrame) -> DataFrame:
    """(xmin, ymin, xmax, ymax, n_cells, n_bytes) of a mosaic, 4 bytes a cell."""
    width, height = F.max("xmax") - F.min("x0"), F.max("ymax") - F.min("y0")
    cells = (F.round(width / F.min("cellsize")) * F.round(height / F.min("cellsize"))).cast("long")
    return head.agg(F.min("x0").alias("xmin"), F.min("y0").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), cells.alias("n_cells"), (cells * 4).alias("n_bytes"))
