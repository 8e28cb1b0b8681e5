"""Dates, pairs, tiles and products in names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of names.
DATE = r"(\d{8})"
PAIR = r"(\d{8})_(\d{8})"
TILE = r"([NS])(\d+\.?\d*)([EW])(\d+\.?\d*)"
PRODUCT = r"(S1[AB])_(\w{2})_(\w{3})(\w)_.*?_(\d{8})T(\d{6})_.*?_(\d{6})_"


def date_in(name: Column) -> Column:
    """The first eight digits as a date; an error if there are none."""
    found = F.regexp_extract(name, DATE, 1)
    return F.when(found != "", F.to_date(found, "yyyyMMdd")).otherwise(F.raise_error(F.concat(F.lit("no date in "), name)))


def pair_in(name: Column) -> tuple[Column, Column]:
    return tuple(F.to_date(F.regexp_extract(name, PAIR, k), "yyyyMMdd") for k in (1, 2))


def pair_name(early: Column, late: Column, extension: str = "") -> Column:
    return F.concat(F.date_format(early, "yyyyMMdd"), F.lit("_"), F.date_format(late, "yyyyMMdd"), F.lit(extension))


def tile_name(lat: Column, lon: Column) -> Column:
    """N30.8W103.7: hemispheres and one decimal."""
    return F.concat(F.when(lat >= 0, "N").otherwise("S"), F.format_string("%.1f", F.abs(lat)), F.when(lon >= 0, "E").otherwise("W"), F.format_string("%.1f", F.abs(lon)))


def tile_place(name: Column) -> tuple[Column, Column]:
    """(lon, lat) of a tile's name."""
    lat = F.regexp_extract(name, TILE, 2).cast("double") * F.when(F.regexp_extract(name, TILE, 1) == "S", -1).otherwise(1)
    lon = F.regexp_extract(name, TILE, 4).cast("double") * F.when(F.regexp_extract(name, TILE, 3) == "W", -1).otherwise(1)
    return lon, lat


def product_fields(name: Column) -> list[Column]:
    keys = ("mission", "mode", "product", "resolution", "day", "time", "orbit")
    return [F.regexp_extract(name, PRODUCT, k + 1).alias(v) for k, v in enumerate(keys)]


def relative_orbit(mission: Column, orbit: Column) -> Column:
    """Path number of an absolute orbit: 175 paths, offset by 73 for the first satellite and 27 for the second."""
    return F.pmod(orbit.cast("int") - F.when(mission == "S1A", 73).otherwise(27), F.lit(175)) + 1


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600


def replace_extension(name: Column, extension: str) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", extension)
