"""Scoring a table of recorded answers against expected values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.constants import REFUSAL_MARKERS
from roadloom.functions import text
from roadloom.operators.query import read_only
from roadloom.operators.skew import quantiles


def expected_values(spark: SparkSession, questions: list[dict]) -> DataFrame:
    """First column of each question's reference SQL, as an array of texts.

    The reference statements are evaluated on the registered tables, behind the same
    gate as any ad-hoc statement; all their values count.  ``questions``: dicts with id, check,
    reference_sql and optional tolerances (the question file, not data).
    """
    frames = []
    for q in questions:
        if q["check"] == "refusal":
            values = spark.range(1).select(F.array().cast("array<string>").alias("expected"))
        else:
            rows = read_only(spark, q["reference_sql"])
            first = F.col(f"`{rows.columns[0]}`").cast("string").alias("v")
            values = rows.select(first).agg(F.collect_list("v").alias("expected"))
        frames.append(values.select(
            F.lit(q["id"]).alias("id"), F.lit(q.get("lang")).alias("lang"), F.lit(q["check"]).alias("check"),
            F.lit(float(q.get("rel_tol", 0.0))).alias("rel_tol"), F.lit(float(q.get("abs_tol", 0.0))).alias("abs_tol"),
            "expected"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def score_answers(answers: DataFrame) -> DataFrame:
    """Adds ``passed``, ``tool_ok`` and ``detail``.

    ``answers``: answer, check, expected array<string>, rel_tol, abs_tol and
    queries array<struct<ok boolean, ..>>, one row per answer.
    """
    answer = F.coalesce(F.col("answer"), F.lit(""))
    refused = text.contains_any(F.lower(answer), REFUSAL_MARKERS)
    target = F.try_element_at("expected", F.lit(1)).try_cast("double")
    rel, tol = F.coalesce("rel_tol", F.lit(0.0)), F.coalesce("abs_tol", F.lit(0.0))
    hit = F.exists(text.number_readings(answer), lambda v: text.close_to(v, target, rel, tol))
    missing = text.missing_from(answer, F.col("expected"))
    check = F.col("check")
    unknown = F.raise_error(F.concat(F.lit("unknown check "), check))
    passed = (F.when(check == "refusal", refused).when(check == "number", F.coalesce(hit, F.lit(False)))
              .when(check == "set", F.size(missing) == 0).otherwise(unknown.cast("boolean")))
    detail = (F.when(check == "refusal", F.when(refused, "refused").otherwise("answered instead of refusing"))
              .when(check == "number", F.concat(F.lit("expected "), F.try_element_at("expected", F.lit(1))))
              .when(F.size(missing) == 0, "all named")
              .otherwise(F.concat(F.lit("missing "), F.array_join(missing, ", "))))
    return (answers.withColumn("passed", passed)
            .withColumn("tool_ok", F.coalesce(F.exists("queries", lambda q: q["ok"]), F.lit(False)))
            .withColumn("detail", detail))


def eval_summary(scored: DataFrame, by: str = "model") -> DataFrame:
    """Passes and totals per model: overall, by language, by check; valid SQL
    among answerable questions; median seconds."""
    def pair(name, cond):
        return [F.count_if(cond & F.col("passed")).alias(f"{name}_passed"), F.count_if(cond).alias(f"{name}_total")]

    answerable = F.col("check") != "refusal"
    counts = scored.groupBy(by).agg(
        F.count_if(F.col("passed")).alias("passed"), F.count(F.lit(1)).alias("total"),
        *pair("en", F.col("lang") == "en"), *pair("de", F.col("lang") == "de"),
        *pair("number", F.col("check") == "number"), *pair("set", F.col("check") == "set"),
        *pair("refusal", F.col("check") == "refusal"),
        F.count_if(answerable & F.col("tool_ok")).alias("valid_sql"),
        F.count_if(answerable).alias("answerable"))
    median = quantiles(scored, [by], "seconds", [0.5]).select(by, F.col("quantile").alias("median_seconds"))
    return counts.join(median, by, "left")


def failures(scored: DataFrame) -> DataFrame:
    """The failed answers on one line each, for the report; whoever prints them may shorten them."""
    excerpt = F.replace(F.coalesce(F.col("answer"), F.lit("")), F.lit("\n"), F.lit(" "))
    return scored.where(~F.col("passed")).select("model", "id", "detail", excerpt.alias("excerpt"))


def with_run(rows: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Run date and model of each row; rows of older files take the model from
    the file name."""
    own = F.col("model") if "model" in rows.columns else F.lit(None).cast("string")
    return (rows.withColumn("run_date", text.run_date(file_name))
            .withColumn("model", F.coalesce(F.nullif(own, F.lit("")), text.run_model(file_name))))


def latest_runs(rows: DataFrame) -> DataFrame:
    """Rows of the newest run of every model.

    The newest date per model is one small row each; the large side is matched
    against it on both columns, and a model may hold any share of the rows.
    """
    from roadloom.operators.skew import skew_join

    newest = rows.groupBy("model").agg(F.max("run_date").alias("run_date"))
    return skew_join(rows, newest, ["model", "run_date"], "left_semi")
