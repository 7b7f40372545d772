"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.params import Window


def finite(x: Column) -> Column:
    """False for NULL, NaN and infinities; Spark's own comparisons treat NaN as the largest value."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def window_count(samples: Column, window: Window) -> Column:
    """Whole windows that fit: 0 if shorter than one window, never a partial one; a negative count is an error."""
    fits = F.floor((samples - window.length_samples) / F.lit(window.step_samples)).cast("bigint") + 1
    return (
        F.when(samples < 0, F.raise_error(F.lit("sample count must not be negative")).cast("bigint"))
        .when(samples < window.length_samples, F.lit(0).cast("bigint"))
        .otherwise(fits)
    )


def seconds(samples: Column, rate_hz: int) -> Column:
    return samples / F.lit(float(rate_hz))


def hours(samples: Column, rate_hz: int) -> Column:
    return seconds(samples, rate_hz) / F.lit(3600.0)


def milliseconds(samples: Column, rate_hz: int) -> Column:
    return samples * F.lit(1000.0) / F.lit(float(rate_hz))


def joined(values: Column) -> Column:
    """1;2;3 of a set of integers."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ";")


def listed(values: Column) -> Column:
    """[1, 2, 3] as it stands in issue details."""
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def positives(column: str) -> Column:
    """Aggregate: sorted distinct positive values."""
    return F.array_sort(F.collect_set(F.when(F.col(column) > 0, F.col(column))))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
