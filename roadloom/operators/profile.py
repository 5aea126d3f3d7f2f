"""Table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.constants import LATITUDE_NAMES, LONGITUDE_NAMES
from roadloom.operators.skew import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _value(f: T.StructField):
    """A column; not-a-number counts as missing."""
    c = F.col(f"`{f.name}`")
    return F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, non-null count, null percent, distinct values.

    One aggregate over the whole table.  Exact distinct counts shuffle each
    column's distinct values; ``approximate`` trades them for sketches.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    fields = df.schema.fields
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count(_value(f)).alias(f"n{i}") for i, f in enumerate(fields)],
                  *[distinct(_value(f)).alias(f"d{i}") for i, f in enumerate(fields)])
    entries = F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f"n{i}").alias("non_null"),
                 F.round(F.coalesce(F.try_divide(F.lit(100.0) * (F.col("rows") - F.col(f"n{i}")), F.col("rows")),
                                    F.lit(0.0)), 1).alias("null_pct"),
                 F.col(f"d{i}").alias("unique_values")) for i, f in enumerate(fields)])
    return wide.select(F.inline(entries))


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of
    every numeric column.

    All columns are stacked into (column, value) rows, so one pass serves all.
    """
    columns = columns or numeric_columns(df)
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _value(df.schema[c]).cast("double").alias("value")) for c in columns
    ])).alias("e")).select("e.*")
    moments = stacked.groupBy("column_name").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("quantile")))
    quarters = (quantiles(stacked, ["column_name"], "value", [0.25, 0.5, 0.75]).groupBy("column_name")
                .agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3")))
    return (moments.join(quarters, "column_name", "left")
            .select("column_name", "n", "mean", "std", "min", "q1", "median", "q3", "max"))


def summarize(df: DataFrame) -> DataFrame:
    """Profile and numeric summary side by side."""
    profile = column_profile(df)
    return profile.join(numeric_summary(df), "column_name", "left") if numeric_columns(df) else profile


def line_summary(df: DataFrame, column: str = "length_km") -> DataFrame:
    """Total kilometres, rows with a length, mean metres."""
    km = F.col(column).try_cast("double")
    return df.agg(F.sum(km).alias("total_length_km"), F.count(km).alias("line_features"),
                  (F.avg(km) * 1000).alias("mean_segment_m"))


def table_envelope(df: DataFrame) -> DataFrame:
    """Envelope over the four bbox columns."""
    return df.agg(F.min("bbox_min_lon").alias("min_lon"), F.min("bbox_min_lat").alias("min_lat"),
                  F.max("bbox_max_lon").alias("max_lon"), F.max("bbox_max_lat").alias("max_lat"))


def point_columns(df: DataFrame) -> tuple[str, str] | None:
    """The first column named like a longitude and the first like a latitude."""
    pick = lambda names: next((c for c in df.columns if c.lower() in names), None)
    lon, lat = pick(LONGITUDE_NAMES), pick(LATITUDE_NAMES)
    return (lon, lat) if lon and lat else None


def points(df: DataFrame) -> DataFrame | None:
    """lon/lat of every row that has both, or None without such columns."""
    found = point_columns(df)
    if found is None:
        return None
    lon, lat = (F.col(f"`{c}`").cast("string").try_cast("double") for c in found)
    return df.select(lon.alias("lon"), lat.alias("lat")).dropna()


def geometry_types(df: DataFrame, column: str = "geom_type") -> DataFrame:
    return (df.groupBy(F.coalesce(F.col(column), F.lit("null")).alias("geom_type"))
            .agg(F.count(F.lit(1)).alias("features")))


def sample_points(df: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key has an md5 in the lowest ``share`` of all values: the same ones every
    time and in every engine, without a sort."""
    position = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.where(position < F.lit(int(share * (1 << 32))))


#: Hexadecimal digits of a key's md5 by which the sample of wanted size counts rows: 65,536 counts, whatever the table.
_DIGITS = 4


def exact_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows with the smallest md5 of the key (all rows of a smaller table), without sorting the table.

    Rows are counted by the first digits of the md5.  Those below the digits in which the ``size``-th row lies are taken as they are; only
    rows with these very digits are ordered, by md5 and then by their other columns.  Null keys come last.
    """
    mark = F.coalesce(F.md5(F.col(key).cast("string")), F.lit("g"))
    digits = F.substring(mark, 1, _DIGITS)
    counts = df.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, 0)
    last = counts.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= size).orderBy("digits").select("digits", (F.col("upto") - F.col("n")).alias("below")).first()
    if last is None:
        return df
    edge = df.where(digits == last["digits"]).orderBy(mark, *df.columns).limit(size - last["below"])
    return df.where(digits < last["digits"]).unionByName(edge)


def sample_rows(df: DataFrame, *keys: str, rows: int = 3) -> DataFrame:
    """The first rows of a table by its key, as an example of what it holds."""
    return df.orderBy(*keys).limit(rows)
