"""Release ids and weekly dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def release_date(release) -> Column:
    """``2026-08-19.0`` -> 2026-08-19; an id that does not start with a date is an error."""
    release = _col(release)
    day = F.try_to_date(F.regexp_extract(release, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.when(release.isNull(), F.lit(None).cast("date")).otherwise(
        F.coalesce(day, F.raise_error(F.concat(F.lit("Unrecognised release id: "), release)).cast("date")))


def weeks_between(first, last, before: int, after: int) -> Column:
    """Array of dates in 7-day steps, some weeks before and after the two ends."""
    return F.sequence(F.date_sub(_col(first), 7 * before), F.date_add(_col(last), 7 * after),
                      F.expr("INTERVAL 7 DAYS"))
