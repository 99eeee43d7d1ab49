"""Wide sensor tables: a column for each sensor (L0_S1_F3) or date (L0_S1_D4) of a part."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENSOR, DATE = re.compile(r"L\d+_S\d+_F\d+"), re.compile(r"L\d+_S\d+_D\d+")


def sensor_columns(df: DataFrame) -> list[str]:
    """Names of sensors whose columns are numeric, in the table's order."""
    return [f.name for f in df.schema if SENSOR.fullmatch(f.name) and isinstance(f.dataType, T.NumericType)]


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if DATE.fullmatch(c)]


def station_of(column: str) -> str:
    """The station's key, which begins a column's name."""
    return "_".join(column.split("_")[:2])


def stations(columns: Sequence[str], numeric: bool = True) -> list[str]:
    """Station keys of columns, by line and station number, or as strings."""
    keys = {station_of(c) for c in columns}
    return sorted(keys, key=lambda k: tuple(int(x[1:]) for x in k.split("_"))) if numeric else sorted(keys)


def without_suffix(names: Sequence[str], suffix: str = "_target_enc") -> list[str]:
    return [n.removesuffix(suffix) for n in names]


def with_prefix(names: Sequence[str], prefix: str = "sensor_mean_") -> list[str]:
    return [prefix + n for n in names]


#: Rows that a task pivots, about: its table holds a value of every cell for each of their keys.
PIVOT_ROWS = 250_000


def dealt(rows: DataFrame, key: str = "id", size: int | None = None) -> DataFrame:
    """rows by their key, in so many partitions that each has about `size` rows; groups of the key then need no other shuffle."""
    return rows.repartition(max(1, -(-rows.count() // (size or PIVOT_ROWS))), key)


def _mean(columns: Sequence[str]) -> Column:
    """Mean of the columns that aren't null; null if all are."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]).cast("double"), F.lit(0.0)))
    return F.when(n > 0, total / n)


def wide_station_means(df: DataFrame, key: str = "id", prefix: str = "") -> DataFrame:
    """key and the mean of each station's sensors, by line and station number. A projection: no row moves."""
    own: dict[str, list[str]] = {}
    for c in sensor_columns(df):
        own.setdefault(station_of(c), []).append(c)
    return df.select(key, *[_mean(own[s]).alias(prefix + s) for s in stations([c for cs in own.values() for c in cs])])


def wide_times(df: DataFrame, key: str = "id") -> DataFrame:
    """key, start_time and end_time over all date columns; null without any date."""
    dates = [F.col(c).cast("double") for c in date_columns(df)] or [F.lit(None).cast("double")]
    return df.select(key, F.array_min(F.array(*dates)).alias("start_time"), F.array_max(F.array(*dates)).alias("end_time"))


def to_readings(df: DataFrame, key: str = "id") -> DataFrame:
    """key, line, station, column and value: a row for each sensor that isn't null, the long form that other operators read."""
    cells = [F.struct(F.lit(c.split("_")[0]).alias("line"), F.lit(station_of(c)).alias("station"), F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in sensor_columns(df)]
    if not cells:
        return df.select(key, *[F.lit(None).cast(t).alias(n) for n, t in (("line", "string"), ("station", "string"), ("column", "string"), ("value", "double"))]).where("false")
    return df.select(key, F.explode(F.filter(F.array(*cells), lambda x: x["value"].isNotNull())).alias("x")).select(key, "x.*")
