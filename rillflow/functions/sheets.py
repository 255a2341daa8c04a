"""Map sheet codes of the 1:1,000,000 grid and its subdivisions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of latitude zones of 4 degrees, without I and O.
ZONES = "ABCDEFGHJKLMNPQRSTUV"
#: Scale -> rows and columns of a sheet's division into the next scale.
DIVISIONS = (("1:100000", 12, 12), ("1:50000", 2, 2), ("1:25000", 2, 2), ("1:10000", 2, 4))

#: Scale -> steps in degrees of latitude and longitude at which a box is sampled.
STEPS = {"1:10000": (0.02, 0.04), "1:25000": (0.05, 0.08), "1:50000": (0.1, 0.16), "1:100000": (0.33, 0.5)}
#: Fixed value: kilometres of a degree of latitude.
DEGREE_KM = 111.0


def _zone_letter(lat: Column) -> Column:
    band = F.floor(lat / 4)
    index = F.when(band <= 7, band).when(band <= 14, band - 1).otherwise(band - 2)
    return F.substring(F.lit(ZONES), (index + 1).cast("int"), F.lit(1))


def sheet_code(lat: Column, lon: Column, scale: str = "1:10000") -> Column:
    """Code of the sheet that holds a point; null outside 49..55 N, 14..24.5 E."""
    code = F.concat_ws("-", _zone_letter(lat), (F.floor((lon + 180) / 6) + 1).cast("string"))
    top, left = (F.floor(lat / 4) + 1) * 4.0, F.floor(lon / 6) * 6.0
    height, width = F.lit(4.0), F.lit(6.0)
    if scale != "1:1000000":
        for name, rows, cols in DIVISIONS:
            height, width = height / rows, width / cols
            row = F.least(F.greatest(F.floor((top - lat) / height), F.lit(0)), F.lit(rows - 1))
            col = F.least(F.greatest(F.floor((lon - left) / width), F.lit(0)), F.lit(cols - 1))
            place = row * cols + col
            part = {
                "1:100000": F.lpad((place + 1).cast("string"), 3, "0"),
                "1:50000": F.substring(F.lit("ABCD"), (place + 1).cast("int"), F.lit(1)),
                "1:25000": F.substring(F.lit("abcd"), (place + 1).cast("int"), F.lit(1)),
                "1:10000": F.concat_ws("-", (row + 1).cast("string"), (col + 1).cast("string")),
            }[name]
            code = F.concat_ws("-", code, part)
            top, left = top - row * height, left + col * width
            if name == scale:
                break
        else:
            raise ValueError(f"no scale {scale}")
    return F.when(lat.between(49, 55) & lon.between(14, 24.5), code)


def sheet_bounds(code: Column) -> Column:
    """(south, north, west, east) of a code of any scale."""
    p = F.split(code, "-")
    part = lambda i: F.get(p, F.lit(i))
    index = F.instr(F.lit(ZONES), part(0)) - 1
    band = F.when(index <= 7, index).when(index <= 12, index + 1).otherwise(index + 2)
    north, west = (band + 1) * 4.0, (part(1).cast("int") - 31) * 6.0
    height, width = F.lit(4.0), F.lit(6.0)
    places = ((12, 12, part(2).cast("int") - 1), (2, 2, F.instr(F.lit("ABCD"), part(3)) - 1), (2, 2, F.instr(F.lit("abcd"), part(4)) - 1), (2, 4, (part(5).cast("int") - 1) * 4 + part(6).cast("int") - 1))
    for i, (rows, cols, place) in enumerate(places):
        there = F.size(p) > i + 2
        north = F.when(there, north - F.floor(place / cols) * (height / rows)).otherwise(north)
        west = F.when(there, west + (place % cols) * (width / cols)).otherwise(west)
        height, width = F.when(there, height / rows).otherwise(height), F.when(there, width / cols).otherwise(width)
    return F.struct((north - height).alias("south"), north.alias("north"), west.alias("west"), (west + width).alias("east"))


def sheets_in_box(boxes: DataFrame, keys: list[str], scale: str = "1:10000") -> DataFrame:
    """Distinct (keys, code) of the sheets that hold a sample point of boxes (south, west, north, east)."""
    step_y, step_x = STEPS.get(scale, (0.1, 0.1))

    def marks(low: str, high: str, step: float) -> Column:
        n = F.floor((F.col(high) - F.col(low)) / step).cast("int") + 1
        return F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.least(F.col(low) + i * step, F.col(high))))

    points = boxes.withColumn("lat", marks("south", "north", step_y)).withColumn("lon", marks("west", "east", step_x))
    return points.select(*keys, sheet_code(F.col("lat"), F.col("lon"), scale).alias("code")).where("code is not null").distinct()


def box_around(lat: Column, lon: Column, km: float = 5.0) -> dict[str, Column]:
    """A box that reaches ``km`` from a point."""
    dy, dx = km / DEGREE_KM, km / (DEGREE_KM * F.cos(F.radians(lat)))
    return {"south": lat - dy, "west": lon - dx, "north": lat + dy, "east": lon + dx}


def neighbour_sheets(sheets: DataFrame, scale: str, code: str = "code", corners: bool = True) -> DataFrame:
    """``sheets`` of ``scale`` with one row per neighbour of the same scale in column ``neighbour``; those outside the grid are left out."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps)))
    b = F.col("box")
    lat = (b["south"] + b["north"]) / 2 + F.col("step.dy") * (b["north"] - b["south"])
    lon = (b["west"] + b["east"]) / 2 + F.col("step.dx") * (b["east"] - b["west"])
    at = sheets.withColumn("box", sheet_bounds(F.col(code))).withColumn("step", around).withColumns({"lat": lat, "lon": lon})
    found = at.withColumn("neighbour", sheet_code(F.col("lat"), F.col("lon"), scale)).where(F.col("neighbour") != F.col(code))
    return found.select(*(F.col(f"`{c}`") for c in sheets.columns), "neighbour").distinct()


def extent(sheets: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """(keys, south, west, north, east): the box around all sheets of a key."""
    b = sheets.withColumn("box", sheet_bounds(F.col(code)))
    return b.groupBy(*keys).agg(F.min("box.south").alias("south"), F.min("box.west").alias("west"), F.max("box.north").alias("north"), F.max("box.east").alias("east"))
