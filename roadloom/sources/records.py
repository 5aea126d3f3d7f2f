"""JSONL logs: turns and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.text import result_name

TURN_SCHEMA = ("ts string, question string, answer string, provider string, model string, seconds double, "
               "input_tokens bigint, output_tokens bigint, queries array<struct<sql string, purpose string, "
               "ok boolean, rows bigint, error string, seconds double>>, tables array<string>, rating string")
RUN_SCHEMA = ("model string, id string, lang string, `check` string, question string, expected array<string>, "
              "answer string, passed boolean, tool_ok boolean, detail string, seconds double, "
              "queries array<struct<sql string, ok boolean, error string>>")


def append_turns(turns: DataFrame, path: str) -> None:
    turns.write.mode("append").option("ignoreNullFields", False).json(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TURN_SCHEMA).json(path)


def write_run(rows: DataFrame, directory: str, run_date: str, partial: bool = False) -> None:
    """Scored answers of one run, one folder per date and model.  A run
    that is repeated replaces itself; partial runs go to a folder of their own and
    never replace a full run."""
    folder = f"{directory}/partial" if partial else f"{directory}/full"
    (rows.withColumn("run_date", F.lit(run_date)).withColumn("model_name", result_name("model"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "model_name").json(folder))


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``<date>_<model>.jsonl`` files with the name of their file."""
    return spark.read.schema(RUN_SCHEMA).json(path).withColumn("file_name", F.col("_metadata.file_path"))
