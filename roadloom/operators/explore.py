"""Breakdowns, highlights, and frames for charts and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.constants import BREAKDOWN_COLUMNS, HIGHLIGHT_COLUMNS


def breakdown(df: DataFrame, table: str, aggregate: Column, unit: str,
              condition: Column | None = None, n: int | None = None) -> DataFrame:
    """A filtered total split by the table's main dimension, with the same filter.

    ``unit`` names the value column: km, count or value.  All groups, or the
    ``n`` largest.
    """
    by = BREAKDOWN_COLUMNS[table]
    rows = df if condition is None else df.where(condition)
    out = rows.groupBy(by).agg(aggregate.alias(unit)).orderBy(F.col(unit).desc_nulls_last(), F.col(by).asc_nulls_last())
    return out if n is None else out.limit(n)


def matching_places(places: DataFrame, condition: Column, n: int | None = None) -> DataFrame:
    """The places behind a filtered total, for the map: all, or the first ``n`` by id."""
    found = places.where(condition)
    found = found if n is None else found.orderBy("id").limit(n)
    return found.select("name", "category", "lon", "lat")


def top_groups(df: DataFrame, by: str, k: int, value: Column | None = None, name: str = "n") -> DataFrame:
    """The k largest groups; equal ones in key order.  Rows without a key are left out."""
    value = F.count(F.lit(1)) if value is None else value
    return (df.where(F.col(by).isNotNull()).groupBy(by).agg(value.alias(name))
            .orderBy(F.col(name).desc_nulls_last(), by).limit(k))


def distinct_names(df: DataFrame, condition: Column) -> DataFrame:
    """Different non-empty names under a filter."""
    name = F.nullif(F.col("name"), F.lit(""))
    return df.where(condition).agg(F.count_distinct(name).alias("names"))


def matching_values(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Distinct values of a column that match a case-insensitive pattern."""
    return df.where(F.col(column).ilike(pattern)).select(column).distinct()


def highlight(df: DataFrame, table: str, column: str, value, n: int | None = None) -> DataFrame | None:
    """Rows whose column equals a value: all, or the first ``n`` by id; None for
    columns that are not offered.  The value is a literal and never becomes part
    of a statement."""
    if (table, column) not in HIGHLIGHT_COLUMNS:
        return None
    found = df.where(F.col(column) == F.lit(value))
    return found if n is None else found.orderBy("id").limit(n)


def map_columns(schema: T.StructType, points: bool) -> dict[str, str] | None:
    """Which columns the map shows, as {column: name on the map}; None for a table
    without positions.  Decided from the schema alone; ``points`` says that every
    feature is a single position, so that lon and lat are all of it."""
    names = schema.fieldNames()
    pair, text = {"lon", "lat"} <= set(names), "geometry_geojson" in names
    if not (pair or text):
        return None
    hidden = {n for n in names if n.startswith("bbox_m") or n == "geom_type"}
    hidden |= {"geometry_geojson"} if pair and (points or not text) else {"lon", "lat"}
    return {n: "_geojson" if n == "geometry_geojson" else n for n in names if n not in hidden}


def map_frame(df: DataFrame, points: bool) -> DataFrame:
    """All rows of a table with the columns of ``map_columns``."""
    shown = map_columns(df.schema, points)
    if shown is None:
        raise ValueError("the table has no positions")
    return df.select([F.col(f"`{c}`").alias(name) for c, name in shown.items()])


def chart_frame(result: DataFrame) -> DataFrame | None:
    """A result as bars (label, value), largest first: its first text-like column against
    its first number that is not a coordinate.  A result of one number alone is labelled with its
    name.  None where the schema has no number to show."""
    shown = {f.name: isinstance(f.dataType, T.NumericType) for f in result.schema.fields
             if f.name not in ("lon", "lat", "geometry_geojson", "_geojson")}
    numbers, labels = ([c for c, is_number in shown.items() if is_number is kind] for kind in (True, False))
    if not numbers or not (labels or len(result.columns) == 1):
        return None
    label = F.col(f"`{labels[0]}`").cast("string") if labels else F.lit(numbers[0])
    bars = result.select(label.alias("label"), F.col(f"`{numbers[0]}`").cast("double").alias("value"))
    return bars.dropna().orderBy(F.col("value").desc(), "label")
