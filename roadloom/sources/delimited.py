"""CSV in and out."""

from __future__ import annotations

import csv
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.constants import CSV_DELIMITERS, DATE_COLUMN_SHARE, NA_TOKENS
from roadloom.functions.text import clean_key
from roadloom.sources.records_in_splits import quotes, records


def header_separator(spark: SparkSession, path: str) -> str:
    """The candidate that cuts the first line into most fields; of equals the one listed first."""
    line = F.col("value")
    fields = [F.size(F.split(line, re.escape(c))) for c in CSV_DELIMITERS]
    best = F.array_position(F.array(*fields), F.greatest(*fields)) - 1
    found = spark.read.text(path).limit(1).select(F.element_at(F.array(*map(F.lit, CSV_DELIMITERS)), best.cast("int") + 1)).first()
    if found is None:
        raise ValueError(f"{path} is empty")
    return found[0]


def plain_names(spark: SparkSession, names: list[str]) -> list[str]:
    """Column names by the rule for property keys, without underscores at the ends; what nothing is left of is numbered."""
    rows = spark.createDataFrame(list(enumerate(names)), "at int, name string")
    key = F.trim(clean_key(F.replace(F.col("name"), F.lit("\ufeff"), F.lit(""))), F.lit("_"))
    blank = ~F.col("name").rlike("[0-9a-zA-Z]")
    name = F.when(blank, F.concat(F.lit("col_"), F.col("at").cast("string"))).otherwise(key)
    return [r["name"] for r in sorted(rows.select("at", name.alias("name")).collect())]


def _moment(value):
    """A date or time as ISO text, or a date written month first, day first with points, or with slashes from the year."""
    return F.coalesce(F.try_to_timestamp(value), *[F.try_to_timestamp(value, F.lit(p)) for p in ("M/d/yyyy", "d.M.yyyy", "yyyy/M/d")])


def header(spark: SparkSession, path: str, separator: str) -> list[str]:
    """The fields of the first record, which may go over several lines."""
    asked, rule = 1, quotes(separator)
    while True:
        lines = [r["value"] for r in spark.read.text(path, lineSep="\n").limit(asked).collect()]
        is_open = False
        for at, line in enumerate(lines):
            is_open = rule.open_after(line, is_open)
            if not is_open:
                break
        if not is_open or len(lines) < asked:
            csv.field_size_limit(sys.maxsize)
            text = [x + "\n" for x in lines[:at]] + [lines[at].removesuffix("\r")]
            return next(csv.reader(text, delimiter=separator))
        asked *= 8


def read_csv(spark: SparkSession, path: str, surplus: str = "error") -> DataFrame:
    """A CSV file or folder of unknown layout.

    Looks at the header line for the delimiter, then reads everything as text; quoted
    fields may hold line breaks, and one file is still read by many tasks.  Every file has a header, and that of one file
    names the columns; empty lines are passed over, fields that a row lacks are null.  A row with more fields than the
    header raises an error, or, with ``surplus="count"``, has their number in ``surplus_fields``.
    One aggregate over the whole table decides the column types; decimal commas
    are not numbers.  Text columns named like a date become timestamps if more
    than 80 % of all rows parse.
    """
    if surplus not in ("error", "count"):
        raise ValueError(f"surplus: {surplus}")
    separator = header_separator(spark, path)
    names = plain_names(spark, header(spark, path, separator))
    rows = records(spark, path, separator).where("NOT first AND record <> ''")
    more = F.col("fields") - len(names)
    if surplus == "error":
        said = F.concat(F.lit(f"more than {len(names)} fields: "), F.substring("record", 1, 200))
        rows = rows.where(F.when(more > 0, F.raise_error(said).cast("boolean")).otherwise(True))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv("record", schema, {"sep": separator, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    raw = rows.select(parsed.alias("r"), F.greatest(more, F.lit(0)).alias("more")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], "more")
    text = raw.select(*[F.when(F.col(c).isin(NA_TOKENS), None).otherwise(F.col(c)).alias(c) for c in names], "more")

    def fits(c):
        value = F.trim(F.col(c))
        plain = value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Inf|infinity|Infinity)$")
        return [F.count(c).alias(f"n_{c}"),
                F.count_if(value.rlike(r"^[+-]?\d+$") & value.try_cast("bigint").isNotNull()).alias(f"i_{c}"),
                F.count_if(plain).alias(f"d_{c}"),
                F.count_if(F.lower(value).isin("true", "false")).alias(f"b_{c}"),
                F.count_if(_moment(value).isNotNull()).alias(f"t_{c}")]

    found = text.agg(F.count(F.lit(1)).alias("rows"), *[e for c in names for e in fits(c)]).first()

    def typed(c):
        n, value = found[f"n_{c}"], F.trim(F.col(c))
        if n and found[f"i_{c}"] == n:
            return value.try_cast("bigint").alias(c)
        if n and found[f"d_{c}"] == n:
            return value.try_cast("double").alias(c)
        if n and found[f"b_{c}"] == n:
            return (F.lower(value) == "true").alias(c)
        if re.search("date|time|timestamp", c, re.IGNORECASE) and found[f"t_{c}"] > DATE_COLUMN_SHARE * found["rows"]:
            return _moment(value).cast("timestamp_ntz").alias(c)
        return F.col(c)

    counted = [F.col("more").alias("surplus_fields")] if surplus == "count" else []
    return text.select(*[typed(c) for c in names], *counted)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
