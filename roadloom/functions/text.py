"""Text functions: number readings, normalisation, containment, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_readings(text) -> Column:
    """Every reading of every number in a text, as ``array<double>``.

    A token such as ``1.542`` is read with English separators (1.542), with
    German ones (1542) and with a decimal comma; readings that are not a number
    are left out.
    """
    tokens = F.transform(
        F.regexp_extract_all(_col(text), F.lit(r"\d[\d.,]*"), F.lit(0)),
        lambda t: F.rtrim(t, F.lit(".,")))

    def read(t):
        english = F.replace(t, F.lit(","), F.lit(""))
        german = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        comma = F.replace(t, F.lit(","), F.lit("."))
        return F.array(*[c.try_cast("double") for c in (english, german, comma)])

    return F.filter(F.flatten(F.transform(tokens, read)), lambda v: v.isNotNull())


def normalized(text) -> Column:
    """Lower case; runs of space, underscore and hyphen become one space."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[\s_\-]+", " "))


def contains_any(text, needles: list[str]) -> Column:
    text = _col(text)
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(text, n))


def missing_from(text, values) -> Column:
    """The values (an array column) whose normalised form is not in the text."""
    text = normalized(text)
    return F.filter(_col(values), lambda v: ~F.contains(text, normalized(v)))


def close_to(a, b, rel_tol, abs_tol) -> Column:
    """Tolerant equality; the absolute tolerance is never below 1e-9."""
    a, b = _col(a), _col(b)
    return F.abs(a - b) <= F.greatest(
        rel_tol * F.greatest(F.abs(a), F.abs(b)), F.greatest(abs_tol, F.lit(1e-9)))


def clean_key(name) -> Column:
    """A property key as a column name."""
    cleaned = F.regexp_replace(_col(name), "[^0-9a-zA-Z_]+", "_")
    return F.when(cleaned == "", F.lit("prop")).otherwise(cleaned)


def run_date(file_name) -> Column:
    """The part of ``<date>_<model>.jsonl`` before the first underscore."""
    return F.split(_base(file_name), "_", 2)[0]


def run_model(file_name) -> Column:
    """The model in ``<date>_<model>.jsonl``; the last underscore stands for a colon."""
    rest = F.regexp_replace(_base(file_name), "^[^_]*_?", "")
    return F.regexp_replace(rest, "_([^_]*)$", ":$1")


def result_name(model) -> Column:
    """A model name that is safe in a file name."""
    return F.replace(F.replace(_col(model), F.lit(":"), F.lit("_")), F.lit("/"), F.lit("--"))


def _base(file_name) -> Column:
    return F.regexp_replace(F.regexp_extract(_col(file_name), "([^/]*)$", 1), r"\.jsonl$", "")
