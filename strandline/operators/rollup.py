"""Recording, participant and dataset level. Every side is aggregated before it is joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.expr import hours, joined, milliseconds, seconds
from strandline.params import STREAMS, AuditParams

DISAGREE = ("stimulus_restimulus_disagreement_samples", "repetition_rerepetition_disagreement_samples")


def file_inventory(loaded: DataFrame, labels: DataFrame, found: DataFrame, channels: DataFrame, params: AuditParams) -> DataFrame:
    """The 28 fields of each loaded recording, plus recording_id. labels: checks.label_facts."""
    trials = found.groupBy("recording_id").agg(F.count("*").alias("active_trial_segments"))
    bad = channels.groupBy("recording_id").agg(F.sum("nonfinite_count").alias("nonfinite_emg_values"))
    out = loaded.join(labels, "recording_id", "left").join(trials, "recording_id", "left").join(bad, "recording_id", "left")
    out = out.fillna(0, ["active_trial_segments", "nonfinite_emg_values", *DISAGREE])
    text = lambda c: F.coalesce(joined(F.col(c)), F.lit(""))
    return out.select(
        "recording_id", "subject", "exercise", "acquisition", "file", "relative_path", "file_bytes",
        *[F.col(f"{s}_length").alias(f"original_{s}_samples") for s in STREAMS],
        reduce(lambda a, b: a + b, [F.col(f"{s}_removed") for s in STREAMS]).alias("trailing_samples_removed"),
        *[F.col(f"{s}_removed").alias(f"{s}_samples_removed") for s in STREAMS],
        F.col("shortest").alias("emg_samples"), F.col("channel_count").alias("emg_channels"), F.lit("float64").alias("emg_dtype"),
        F.lit(params.sampling_rate_hz).alias("sampling_rate_hz"), seconds(F.col("shortest"), params.sampling_rate_hz).alias("recording_duration_seconds"),
        text("active_labels").alias("active_labels"), text("active_repetitions").alias("active_repetitions"),
        "active_trial_segments", "nonfinite_emg_values", *DISAGREE,
    )


def participant_summary(files: DataFrame, windows: DataFrame, channels: DataFrame, issues: DataFrame, params: AuditParams) -> DataFrame:
    """Subjects with a loaded file drive; windows, channels (with subject) and issues are attached by subject."""
    base = files.groupBy("subject").agg(
        F.count("*").alias("file_count"), F.countDistinct("exercise").alias("exercise_count"), F.sum("emg_samples").alias("total_samples"), F.sum("nonfinite_emg_values").alias("nonfinite_emg_values")
    )
    fit = windows.groupBy("subject").agg(F.sum("generator_window_count").alias("generator_window_count"), F.sum("classifier_window_count").alias("classifier_window_count"))
    flags = channels.groupBy("subject").agg(F.count_if("constant_channel").alias("constant_channels"), F.count_if("potential_saturation").alias("potential_saturation_channels"))
    found = issues.groupBy("subject").agg(F.count("*").alias("issue_count"))
    out = base.join(fit, "subject", "left").join(flags, "subject", "left").join(found, "subject", "left").fillna(0)
    return out.select(
        "subject", "file_count", "exercise_count", "total_samples", seconds(F.col("total_samples"), params.sampling_rate_hz).alias("total_duration_seconds"),
        "generator_window_count", "classifier_window_count", "nonfinite_emg_values", "constant_channels", "potential_saturation_channels", "issue_count",
    )


def summary_measures() -> dict[str, list[Column]]:
    """The summary's totals as aggregates of the result tables that they come from."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    label_removed = reduce(lambda a, b: a + b, [F.col(f"{s}_samples_removed") for s in STREAMS[1:]])
    return {
        "file_inventory": [
            F.count("*").alias("successfully_loaded_file_count"), zero("emg_samples").alias("total_emg_samples"), zero("nonfinite_emg_values").alias("nonfinite_emg_values"), *[zero(c).alias(c) for c in DISAGREE],
            F.count_if(F.col("trailing_samples_removed") > 0).alias("aligned_file_count"), zero("emg_samples_removed").alias("emg_tail_samples_removed"), zero(label_removed).alias("label_tail_samples_removed"),
        ],
        "window_counts": [F.count("*").alias("trial_segment_count"), zero("generator_window_count").alias("generator_window_count"), zero("classifier_window_count").alias("classifier_window_count")],
        "channel_quality": [F.count("*").alias("channel_record_count"), F.count_if("constant_channel").alias("constant_channels"), F.count_if("potential_saturation").alias("potential_saturation_channels")],
        "participant_summary": [F.count("*").alias("subject_count")],
        "issues": [F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count")],
    }


def _listed(expected: DataFrame, recordings: DataFrame) -> list[DataFrame]:
    """What the summary takes from the tables that come in. The subjects requested are those of ``expected``."""
    subjects = F.sort_array(F.collect_set(F.col("subject").cast("int"))).alias("subjects_requested")
    return [expected.agg(F.count("*").alias("expected_file_count"), subjects), recordings.agg(F.count("*").alias("observed_file_count"))]


def dataset_summary(expected: DataFrame, recordings: DataFrame, files: DataFrame, windows: DataFrame, channels: DataFrame, issues: DataFrame, params: AuditParams) -> DataFrame:
    """One row: the summary's keys without the wall clock and the data root, which the sink adds."""
    measures = summary_measures()
    tables = {"file_inventory": files, "window_counts": windows, "channel_quality": channels, "issues": issues}
    subjects = files.agg(F.countDistinct("subject").alias("subject_count"))
    return _with_settings(reduce(DataFrame.crossJoin, [*_listed(expected, recordings), subjects, *[df.agg(*measures[name]) for name, df in tables.items()]]), params)


def observed_summary(expected: DataFrame, recordings: DataFrame, observed: dict[str, int], params: AuditParams) -> DataFrame:
    """The same row from totals that were gathered while the result tables were written."""
    one = reduce(DataFrame.crossJoin, _listed(expected, recordings))
    return _with_settings(one.withColumns({k: F.lit(v).cast("bigint") for k, v in observed.items()}), params)


def _with_settings(one: DataFrame, params: AuditParams) -> DataFrame:
    window = lambda w: F.struct(F.lit(w.length_samples).alias("length_samples"), F.lit(w.step_samples).alias("step_samples"))
    return one.withColumns(
        {
            "audit_status": F.when(F.col("error_count") == 0, "pass").otherwise("fail"),
            "label_source": F.lit(params.label_source),
            "sampling_rate_hz": F.lit(params.sampling_rate_hz),
            "expected_channels": F.lit(params.expected_channels),
            "max_tail_mismatch_samples": F.lit(params.max_tail_mismatch),
            "max_tail_mismatch_milliseconds": milliseconds(F.lit(params.max_tail_mismatch), params.sampling_rate_hz),
            "total_recording_hours": hours(F.col("total_emg_samples"), params.sampling_rate_hz),
            "generator_window": window(params.generator),
            "classifier_window": window(params.classifier),
        }
    )


def report_lines(summary: DataFrame, title: str = "DATA AUDIT") -> DataFrame:
    """The text report, a line a row. The lines of the wall clock and the source directory are there if the summary has generated_utc and data_root."""
    f = F.format_string
    given = [f(text, name) for text, name in (("Generated (UTC): %s", "generated_utc"), ("Source directory: %s", "data_root")) if name in summary.columns]
    # The texts of the report.
    lines = [
        F.lit(title),
        F.lit("=" * len(title)),
        f("Status: %s", F.upper("audit_status")),
        *given,
        f("Primary labels: %s", "label_source"),
        f("Terminal alignment limit: %d samples (%.3f ms)", "max_tail_mismatch_samples", "max_tail_mismatch_milliseconds"),
        F.lit(""),
        F.lit("DATA ACCOUNTING"),
        f("Subjects: %d", "subject_count"),
        f("MATLAB files: %d loaded / %d expected", "successfully_loaded_file_count", "expected_file_count"),
        f("Trial segments: %d", "trial_segment_count"),
        f("Total EMG samples: %d", "total_emg_samples"),
        f("Total recording hours: %.3f", "total_recording_hours"),
        F.lit(""),
        F.lit("WINDOW ACCOUNTING"),
        f("Generator windows: %d", "generator_window_count"),
        f("Classifier windows: %d", "classifier_window_count"),
        F.lit(""),
        F.lit("QUALITY SCREEN"),
        f("Non-finite EMG values: %d", "nonfinite_emg_values"),
        f("Constant channel records: %d", "constant_channels"),
        f("Potential saturation channel records: %d", "potential_saturation_channels"),
        f("Stimulus/restimulus disagreement samples: %d", DISAGREE[0]),
        f("Repetition/rerepetition disagreement samples: %d", DISAGREE[1]),
        f("Files aligned at the terminal boundary: %d", "aligned_file_count"),
        f("EMG tail samples removed: %d", "emg_tail_samples_removed"),
        f("Label tail samples removed: %d", "label_tail_samples_removed"),
        f("Errors: %d", "error_count"),
        f("Warnings: %d", "warning_count"),
        F.lit(""),
        F.lit("Interpret potential saturation as a screening flag, not an exclusion rule."),
        F.lit("Review issues.csv and participant_summary.csv before creating splits."),
    ]
    return summary.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def rollup_levels(files: DataFrame, windows: DataFrame, channels: DataFrame) -> DataFrame:
    """Additive measures at recording, participant and dataset level in one shuffle of per-recording facts."""
    fit = windows.groupBy("recording_id").agg(F.sum("generator_window_count").alias("g"), F.sum("classifier_window_count").alias("c"))
    flags = channels.groupBy("recording_id").agg(F.count_if("constant_channel").alias("k"), F.count_if("potential_saturation").alias("p"))
    facts = files.join(fit, "recording_id", "left").join(flags, "recording_id", "left").fillna(0, ["g", "c", "k", "p"])
    return facts.rollup("subject", "recording_id").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("files"), F.sum("emg_samples").alias("samples"),
        F.sum("g").alias("generator_windows"), F.sum("c").alias("classifier_windows"), F.sum("nonfinite_emg_values").alias("nonfinite_values"),
        F.sum("k").alias("constant_channels"), F.sum("p").alias("potential_saturation_channels"),
    )
