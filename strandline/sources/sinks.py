"""Writers of the audit's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.operators import rollup
from strandline.params import AuditParams

TABLES = ("file_inventory", "trial_inventory", "window_counts", "channel_quality", "participant_summary", "issues")
#: The order of each table's rows, as SQL expressions. Findings on pairs come before those on files.
ORDERS = {
    "file_inventory": ["subject", "exercise", "acquisition", "relative_path"],
    "trial_inventory": ["subject", "exercise", "file", "start_sample"],
    "window_counts": ["subject", "exercise", "file", "start_sample"],
    "channel_quality": ["subject", "exercise", "file", "channel"],
    "participant_summary": ["subject"],
    "issues": ["CASE category WHEN 'missing_file' THEN 0 WHEN 'duplicate_file' THEN 1 ELSE 2 END", "subject", "exercise", "file", "category", "detail"],
}


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows dealt by ranges and sorted in each: files are numbered in that order, so reading them by name gives all rows in order. No task sorts more than its range."""
    columns = [F.expr(c).asc_nulls_first() for c in order]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: str | None = None, order: list[str] | None = None, observed: tuple[Observation, list[Column]] | None = None) -> None:
    """One result table, by default unsorted. CSV has a header, true/false and empty NULLs.

    observed: aggregates that are gathered while the rows are written, after all shuffles, so that each row counts once.
    """
    if order:
        df = in_order(df, order)
    if observed:
        df = df.observe(observed[0], *observed[1])
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.option("header", True).csv(path) if format == "csv" else writer.parquet(path)


def write_summary(summary: DataFrame, path: str, data_root: str) -> None:
    """One JSON object with sorted keys."""
    full = stamped(summary, data_root)
    full.select(*sorted(full.columns)).coalesce(1).write.mode("overwrite").json(path)


def stamped(summary: DataFrame, data_root: str) -> DataFrame:
    """The summary with the wall clock (UTC, ISO 8601) and the root, which are added here only."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return summary.withColumns({"generated_utc": now, "data_root": F.lit(data_root)})


def write_report(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_audit(results: dict[str, DataFrame], expected: DataFrame, recordings: DataFrame, params: AuditParams, root: str, data_root: str, format: str = "parquet") -> DataFrame:
    """All tables in their order, the summary and the report; returns the summary.

    The summary's totals are observed while the tables are written: no result is computed or read a second time for them.
    """
    measures, observed = rollup.summary_measures(), {}
    for name in TABLES:
        found = (Observation(name), measures[name]) if name in measures else None
        write_table(results[name], f"{root}/{name}", format, order=ORDERS[name], observed=found)
        if found:
            observed |= found[0].get
    summary = rollup.observed_summary(expected, recordings, observed, params)
    write_summary(summary, f"{root}/audit_summary", data_root)
    write_report(rollup.report_lines(stamped(summary, data_root)), f"{root}/report")
    return summary
