"""Findings of the audit. All per-recording findings come from one fact frame, so samples are read once for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.expr import finite, listed, positives
from strandline.operators.align import removed_text
from strandline.operators.intake import LABELS, integer_labels
from strandline.params import STREAMS, AuditParams

# The texts of findings.
MISSING_FILE = "expected one MATLAB file"
DUPLICATE_FILE = "observed %d MATLAB files"
NOT_INTEGER = "{} must contain finite integer labels"
NOT_ONE = "{} must contain one value, received (%d,)"
TOO_LONG = "time-series length mismatch exceeds {} sample(s): %s"
ALIGNED = "aligned all streams to %d samples; removed trailing samples: %s"
MISMATCH = "filename=%d, variable=%d"
CHANNELS = "observed=%d, expected={}"
FRAGMENTED = "movement=%d, repetition=%d, segments=%d"


def requested_pairs(spark: SparkSession, params: AuditParams) -> DataFrame:
    """(subject, exercise) of every requested subject and every exercise of the label table, each once; a table of parameters only."""
    pairs = [(s, e) for s in sorted(set(params.requested_subjects)) for e in params.exercises]
    return spark.createDataFrame(pairs, "subject int, exercise int")


def missing_recordings(expected: DataFrame, recordings: DataFrame) -> DataFrame:
    return expected.select("subject", "exercise").join(recordings.select("subject", "exercise"), ["subject", "exercise"], "left_anti")


def duplicate_recordings(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("subject", "exercise").agg(F.count("*").alias("files")).where("files > 1")


def label_validity(raw: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """recording_id and, per stream, whether it breaks the integer rule."""
    return raw.groupBy("recording_id").agg(*[integer_labels(c).alias(f"{c}_invalid") for c in columns])


def scalar_validity(scalars: DataFrame) -> DataFrame:
    """(recording_id, variable): exactly one finite value, truncated to an integer of 64 bits; one beyond that is invalid."""
    out = scalars.groupBy("recording_id", "variable").agg(F.count("*").alias("values_received"), F.max("value").cast("double").alias("v"))
    scalar = F.when((F.col("values_received") == 1) & finite(F.col("v")), F.col("v").try_cast("bigint"))
    return out.select("recording_id", "variable", "values_received", scalar.alias("scalar"), scalar.isNull().alias("invalid"))


def _disagreement() -> list[Column]:
    return [
        F.count_if(F.col("stimulus") != F.col("restimulus")).alias("stimulus_restimulus_disagreement_samples"),
        F.count_if(F.col("repetition") != F.col("rerepetition")).alias("repetition_rerepetition_disagreement_samples"),
    ]


def _active(params: AuditParams) -> list[Column]:
    movement, repetition = params.label_columns
    return [positives(movement).alias("active_labels"), positives(repetition).alias("active_repetitions")]


def stream_disagreement(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("recording_id").agg(*_disagreement())


def active_sets(aligned: DataFrame, params: AuditParams) -> DataFrame:
    """Sorted distinct positive labels and repetitions, each on its own."""
    return aligned.groupBy("recording_id").agg(*_active(params))


def label_facts(aligned: DataFrame, params: AuditParams) -> DataFrame:
    """Active sets and disagreement counts of each recording in one pass."""
    return aligned.groupBy("recording_id").agg(*_active(params), *_disagreement())


def expected_label_list(exercise: Column, params: AuditParams) -> Column:
    """The exercise's labels as an array; empty where the exercise is unknown. A map literal of parameters, so no join."""
    none = F.array().cast("array<int>")
    if not params.expected_labels:
        return none
    pairs = [x for e, labels in params.expected_labels.items() for x in (F.lit(e), F.array(*map(F.lit, sorted(labels))).cast("array<int>") if labels else none)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), exercise), none)


def label_coverage(sets: DataFrame, recordings: DataFrame, params: AuditParams) -> DataFrame:
    """Recordings whose active labels are not their exercise's."""
    out = recordings.select("recording_id", "subject", "exercise").join(sets, "recording_id")
    expected = expected_label_list(F.col("exercise"), params)
    return out.where(F.col("active_labels") != expected).select(
        "recording_id", "subject", "exercise", F.concat(F.lit("observed="), listed(F.col("active_labels")), F.lit(", expected="), listed(expected)).alias("detail")
    )


def repetition_coverage(sets: DataFrame, recordings: DataFrame, params: AuditParams) -> DataFrame:
    out = recordings.select("recording_id", "subject", "exercise").join(sets, "recording_id")
    expected = F.array(*map(F.lit, params.expected_repetitions)).cast("array<int>")
    return out.where(F.col("active_repetitions") != expected).select(
        "recording_id", "subject", "exercise", F.concat(F.lit("observed="), listed(F.col("active_repetitions")), F.lit(", expected="), listed(expected)).alias("detail")
    )


def identity_mismatch(recordings: DataFrame) -> DataFrame:
    """subject_mismatch and exercise_mismatch of recordings whose stored values differ from the name's."""
    def one(what: str) -> DataFrame:
        return recordings.where(F.col(f"stored_{what}") != F.col(what)).select(
            "recording_id", "subject", "exercise", "file", F.lit(f"{what}_mismatch").alias("category"),
            F.format_string(MISMATCH, what, f"stored_{what}").alias("detail"),
        )

    return one("subject").unionByName(one("exercise"))


def channel_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("recording_id").agg(F.min(F.size("emg")).alias("least"), F.max(F.size("emg")).alias("most"))


def channel_count_check(samples: DataFrame, params: AuditParams) -> DataFrame:
    """invalid_emg_shape where the width varies inside a recording, channel_count where it is not the expected one."""
    varies = F.col("least") != F.col("most")
    return channel_counts(samples).where(varies | (F.col("most") != params.expected_channels)).select(
        "recording_id", F.when(varies, "invalid_emg_shape").otherwise("channel_count").alias("category"),
        F.when(varies, F.format_string("channels vary from %d to %d", "least", "most")).otherwise(F.format_string(CHANNELS.format(params.expected_channels), "most")).alias("detail"),
    )


def recording_facts(recordings: DataFrame, lengths: DataFrame, params: AuditParams, catalogue: DataFrame | None = None, scalars: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """One row for each recording with stop_category and stop_detail: the first failing check, or NULL if it loads.

    lengths: intake.sample_facts of all recordings, with spans. With scalars, stored_subject and stored_exercise are theirs; a recording
    that has none there keeps its own. raw: labels to judge in place of those of the samples.
    """
    from strandline.sources.variables import missing_variables

    out = recordings.join(lengths, "recording_id", "left")
    steps = [("load_failure", F.when(F.col("has_rows").isNull() & (F.coalesce("channel_count", F.lit(0)) != 0), F.lit("no samples")))]
    if catalogue is not None:
        out = out.join(missing_variables(recordings, catalogue), "recording_id", "left")
        steps.append(("missing_variables", F.col("missing")))
    steps.append(("invalid_emg_shape", F.when(F.col("least") != F.col("most"), F.format_string("channels vary from %d to %d", "least", "most"))))
    if scalars is not None:
        checked = scalar_validity(scalars)
        for name in ("subject", "exercise"):
            one = checked.where(F.col("variable") == name).select("recording_id", F.col("invalid").alias(f"{name}_bad"), F.col("values_received").alias(f"{name}_n"), F.col("scalar").alias(f"{name}_scalar"))
            out = out.join(one, "recording_id", "left").withColumn(f"stored_{name}", F.coalesce(f"{name}_scalar", f"stored_{name}"))
            message = F.when(F.col(f"{name}_n") != 1, F.format_string(NOT_ONE.format(name), f"{name}_n")).otherwise(F.lit(f"{name} must contain a finite value"))
            steps.append(("invalid_metadata", F.when(F.col(f"{name}_bad"), message)))
    if raw is not None:
        streams = tuple(c for c in LABELS if c in raw.columns)
        out = out.drop(*[f"{c}_invalid" for c in streams]).join(label_validity(raw, streams), "recording_id", "left")
    steps += [("invalid_metadata", F.when(F.col(f"{c}_invalid"), F.lit(NOT_INTEGER.format(c)))) for c in LABELS]
    steps.append(("invalid_metadata", F.when(F.col("misplaced") > 0, F.lit("samples without a position"))))
    for s in STREAMS:
        steps.append(("invalid_metadata", F.when(F.col(f"{s}_missing") > 0, F.lit(f"{s} has a gap before its end"))))
        steps.append(("invalid_metadata", F.when(F.col(f"{s}_repeated") > 0, F.lit(f"{s} has repeated positions"))))
    lengths_text = F.concat_ws(", ", *[F.format_string(f"{s}=%d", f"{s}_length") for s in STREAMS])
    steps.append(("invalid_metadata", F.when(F.col("longest") - F.col("shortest") > params.max_tail_mismatch, F.format_string(TOO_LONG.format(params.max_tail_mismatch), lengths_text))))
    first = F.coalesce(*[F.when(m.isNotNull(), F.struct(F.lit(c).alias("c"), m.alias("m"))) for c, m in steps])
    return out.withColumn("stop", first).withColumns({"stop_category": F.col("stop.c"), "stop_detail": F.col("stop.m")}).drop("stop")


def _issue(df: DataFrame, severity: str, category: Column | str, detail: Column | str) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.lit(severity).alias("severity"), "subject", "exercise", "file", as_col(category).alias("category"), as_col(detail).alias("detail"))


def issues(facts: DataFrame, sets: DataFrame, split: DataFrame, expected: DataFrame, recordings: DataFrame, params: AuditParams) -> DataFrame:
    """All findings, not deduplicated, with the subject and exercise of the file name."""
    no_file = lambda df: df.withColumn("file", F.lit(None).cast("string"))
    stopped, loaded = facts.where("stop_category is not null"), facts.where("stop_category is null")
    named = recordings.select("recording_id", "subject", "exercise", "file")
    files = named.select("recording_id", "file")
    removed = F.format_string(ALIGNED, F.col("shortest"), removed_text())
    frames = [
        _issue(no_file(missing_recordings(expected, recordings)), "error", "missing_file", MISSING_FILE),
        _issue(no_file(duplicate_recordings(recordings)), "error", "duplicate_file", F.format_string(DUPLICATE_FILE, "files")),
        _issue(stopped, "error", F.col("stop_category"), F.col("stop_detail")),
        _issue(loaded.where("longest > shortest"), "warning", "trailing_length_alignment", removed),
        _issue(identity_mismatch(loaded), "error", F.col("category"), F.col("detail")),
        _issue(loaded.where(F.col("channel_count") != params.expected_channels), "error", "channel_count", F.format_string(CHANNELS.format(params.expected_channels), "channel_count")),
        _issue(label_coverage(sets, loaded, params).join(files, "recording_id"), "error", "movement_coverage", F.col("detail")),
        _issue(repetition_coverage(sets, loaded, params).join(files, "recording_id"), "error", "repetition_coverage", F.col("detail")),
        _issue(split.join(named, "recording_id"), "warning", "fragmented_trial", F.format_string(FRAGMENTED, "movement", "repetition", "segments")),
    ]
    return reduce(DataFrame.unionByName, frames)
