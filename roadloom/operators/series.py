"""Weekly series between measured releases, and monitoring on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.constants import (
    CLASS_ORDER, INCIDENT_CLASSES, INCIDENT_NAME, INCIDENT_STATES, INCIDENT_WEEKS, MEASURED, SIMULATED,
)
from roadloom.functions.dates import release_date, weeks_between


def incident_rules(spark: SparkSession, states=INCIDENT_STATES, classes=INCIDENT_CLASSES,
                   weeks: dict = INCIDENT_WEEKS, name: str = INCIDENT_NAME) -> DataFrame:
    """(week, state, class, factor, cause): the known incident as a table."""
    rows = [(w, s, c, float(f), name) for w, f in weeks.items() for s in states for c in classes]
    return (spark.createDataFrame(rows, "week string, state string, class string, factor double, cause string")
            .withColumn("week", F.to_date("week")))


def class_ordinal(column: str = "class") -> Column:
    """Position in the fixed class order; null for an unknown class."""
    position = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), F.col(column))
    return F.when(position > 0, position)


def weekly_series(stats: DataFrame, rules: DataFrame | None = None,
                  before: int = 4, after: int = 4) -> DataFrame:
    """Kilometres, segments and named share per (week, state, class).

    On a release date the row holds the measured values.  In between, and some
    weeks beyond, kilometres grow geometrically from the first to the last
    release while segments and named share move linearly within that range.
    Work per (state, class) is one grouped row; weeks come from a generated
    sequence, not from a join.
    """
    # One row per release, state and class.  It is looked at three times below,
    # so the statistics behind it are computed once and kept.
    dated = stats.select("release", release_date("release").alias("date"), "state", "class",
                         F.col("length_km").cast("double").alias("km"),
                         F.col("segments").cast("double").alias("seg"),
                         F.col("pct_named").cast("double").alias("pct")).persist()
    # One row for the whole input: first and last release.
    earliest = F.struct(-F.unix_date("date"), "release")       # of two releases of one day the later id counts
    ends = dated.agg(F.max_by("release", earliest).alias("r0"), F.max("release").alias("r1"))
    span = ends.select(release_date("r0").alias("d0"), release_date("r1").alias("d1"), "r0", "r1")
    r0, r1 = span.select("r0").scalar(), span.select("r1").scalar()
    d0, d1 = span.select("d0").scalar(), span.select("d1").scalar()

    at = lambda r, c: F.max(F.when(F.col("release") == r, F.col(c)))
    listed = F.sort_array(F.collect_list(F.struct("date", "release", F.struct("km", "seg", "pct").alias("v"))))
    last = F.filter("listed", lambda e, i: F.coalesce(F.get("listed", i + 1)["date"] != e["date"], F.lit(True)))
    measured = F.map_from_entries(F.transform(last, lambda e: F.struct(e["date"], e["v"])))
    keys = dated.withColumn("r0", r0).withColumn("r1", r1).groupBy("state", "class").agg(
        *[at(F.col(r), c).alias(f"{c}_{r}") for r in ("r0", "r1") for c in ("km", "seg", "pct")],
        listed.alias("listed")).withColumn("measured", measured).drop("listed")     # one entry per day of this key
    keys = keys.where(F.col("km_r0").isNotNull() | F.col("km_r1").isNotNull())

    nz = lambda c: F.nullif(F.col(c), F.lit(0.0))  # noqa: E731  zero segments count as missing
    keys = (keys.withColumn("d0", d0).withColumn("d1", d1)
            .withColumn("km0", F.coalesce("km_r0", "km_r1")).withColumn("km1", F.coalesce("km_r1", "km_r0"))
            .withColumn("seg0", F.coalesce(nz("seg_r0"), nz("seg_r1"), F.lit(0.0)))
            .withColumn("seg1", F.coalesce(nz("seg_r1"), F.col("seg0")))
            .withColumn("pct0", F.coalesce("pct_r0", "pct_r1", F.lit(0.0)))
            .withColumn("pct1", F.coalesce("pct_r1", "pct0"))
            .withColumn("span", F.greatest(F.lit(1), F.floor(F.date_diff("d1", "d0") / 7))))
    growth = F.when(F.col("km0") > 0, F.pow(F.try_divide(F.col("km1"), F.col("km0")), F.lit(1.0) / F.col("span")))
    keys = keys.withColumn("growth", F.coalesce(growth, F.lit(1.0)))

    # Every release date is an anchor, also for keys that the release lacks.
    anchors = dated.agg(F.collect_set("date").alias("a")).scalar()
    rows = keys.withColumn("anchors", anchors).select(
        "*", F.explode(weeks_between("d0", "d1", before, after)).alias("week"))
    if rules is not None:
        rows = rows.join(rules.select("week", "state", "class", "factor"), ["week", "state", "class"], "left")
    else:
        rows = rows.withColumn("factor", F.lit(None).cast("double"))

    is_anchor = F.array_contains("anchors", F.col("week"))
    hit = F.try_element_at("measured", F.col("week"))
    offset = F.date_diff("week", "d0") / 7
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), offset / F.col("span")))
    linear = lambda c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * share
    # A key that shrinks to nothing has no defined value before its first release: keep the first one.
    curve = F.when((F.col("growth") == 0) & (offset < 0), F.col("km0")).otherwise(
        F.col("km0") * F.pow("growth", offset))
    pick = lambda field, model: F.when(is_anchor, F.coalesce(hit[field], F.lit(0.0))).otherwise(model)
    incident = ~is_anchor & F.col("factor").isNotNull()
    factor = F.when(incident, F.col("factor")).otherwise(F.lit(1.0))
    return rows.select(
        "week", "state",
        F.when(class_ordinal().isNotNull(), F.col("class")).alias("class"),
        F.greatest(F.lit(0.0), pick("km", curve) * factor).alias("length_km"),
        F.bround(F.greatest(F.lit(0.0), pick("seg", linear("seg")) * factor)).cast("bigint").alias("segments"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), pick("pct", linear("pct")))).alias("pct_named"),
        F.when(is_anchor, MEASURED).otherwise(SIMULATED).alias("source"),
        incident.alias("incident"))


def in_series_order(weekly: DataFrame) -> DataFrame:
    return weekly.orderBy("week", "state", class_ordinal().asc_nulls_last())


def dates_off_grid(stats: DataFrame) -> DataFrame:
    """Releases whose date is not on the 7-day grid of the series; they never
    show up in it as measured."""
    first = stats.agg(release_date(F.min("release"))).scalar()
    d = release_date("release")
    return stats.select("release").distinct().where(F.date_diff(d, first) % 7 != 0)


def weekly_totals(weekly: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals per week (and dimension); measured only if every row is."""
    groups = ["week", *(by or [])]
    rows = weekly
    for c in by or []:
        rows = rows.where(F.col(c).isNotNull())
    km = F.sum("length_km")
    named = F.try_divide(F.sum(F.col("pct_named") * F.col("length_km")), km)
    return rows.groupBy(*groups).agg(
        km.alias("length_km"), F.sum("segments").alias("segments"),
        F.bool_or("incident").alias("incident"),
        F.when(km > 0, named).alias("pct_named"),
        F.when(F.bool_and(F.col("source") == MEASURED), MEASURED).otherwise(SIMULATED).alias("source"))


def measured_only(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("source") == MEASURED)


def class_index(weekly: DataFrame) -> DataFrame:
    """Per class, percent change against its first week."""
    per_class = (weekly.where(F.col("class").isNotNull()).groupBy("class", "week").agg(
        F.sum("length_km").alias("length_km"),
        F.when(F.bool_and(F.col("source") == MEASURED), MEASURED).otherwise(SIMULATED).alias("source")))
    start = Window.partitionBy("class").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("length_km").over(start)
    return per_class.withColumn("pct_vs_first",
                                F.try_divide(F.lit(100.0) * (F.col("length_km") - first), first))


def drops(totals: DataFrame, threshold_pct: float = -1.0, by: list[str] | None = None) -> DataFrame:
    """Week-over-week changes below the threshold.  The input is already one
    row per week and dimension."""
    order = Window.partitionBy(*(by or [])).orderBy("week")
    wow = F.try_divide(F.lit(100.0) * (F.col("length_km") - F.col("prev_km")), F.col("prev_km"))
    return (totals.withColumn("prev_km", F.lag("length_km").over(order))
            .withColumn("wow_pct", wow).where(F.col("wow_pct") < threshold_pct))


def with_cause(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Name the known cause of a drop, if its week is one of the cause's weeks."""
    causes = rules.groupBy("week").agg(F.min("cause").alias("cause"))
    return found.join(causes, "week", "left")


def worst_week(found: DataFrame) -> DataFrame:
    """The deepest drop; the earliest of equal ones."""
    return found.orderBy("wow_pct", "week").limit(1)
