"""Shape, relief and drainage indices as Column expressions; null where a divisor is not over 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions.num import half_even


def shape(area_km2: Column, perimeter_km: Column, length_km: Column) -> dict[str, Column]:
    ok = (area_km2 > 0) & (perimeter_km > 0) & (length_km > 0)
    figures = {
        "compactness": perimeter_km / (2 * F.sqrt(math.pi * area_km2)),
        "circularity": 4 * math.pi * area_km2 / (perimeter_km * perimeter_km),
        "elongation": 2 / length_km * F.sqrt(area_km2 / math.pi),
        "form_factor": area_km2 / (length_km * length_km),
        "mean_width_km": area_km2 / length_km,
    }
    return {k: F.when(ok, half_even(v, 4)) for k, v in figures.items()}


def relief(low_m: Column, mean_m: Column, high_m: Column, length_km: Column) -> dict[str, Column]:
    drop = high_m - low_m
    return {"relief_ratio": F.when((length_km > 0) & (drop > 0), half_even(drop / (length_km * 1000), 6)), "hypsometric_integral": F.when(drop > 0, half_even((mean_m - low_m) / drop, 4))}


def drainage(area_km2: Column, length_km: Column, segments: Column, low_m: Column, high_m: Column) -> dict[str, Column]:
    density = length_km / area_km2
    ok = area_km2 > 0
    return {
        "drainage_density": F.when(ok, half_even(density, 4)),
        "stream_frequency": F.when(ok, half_even(segments / area_km2, 4)),
        "ruggedness": F.when(ok & (high_m > low_m), half_even((high_m - low_m) / 1000 * density, 4)),
    }
