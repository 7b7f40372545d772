"""The registered queries: each is (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import align, channels, checks, intake, rollup, trials
from strandline.plans import bindings as b
from strandline.plans.audit import audit_dataset
from strandline.sources import files, layout
from strandline.sources.stage import written
from strandline.sources.variables import missing_variables

SATURATION = 0.01


def _aligned(e: b.Events) -> DataFrame:
    return align.truncate(e.samples, align.within_tolerance(align.stream_lengths(e.samples), e.params.max_tail_mismatch))


def _trials(spark: SparkSession, sf_dir: str, chunked: bool) -> tuple[b.Events, DataFrame]:
    e = b.events(spark, sf_dir)
    return e, trials.trials(trials.label_runs(trials.label_stream(_aligned(e), e.params), e.params.chunk_samples if chunked else None))


def trial_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, found = _trials(spark, sf_dir, False)
    return trials.trial_inventory(found, e.recordings, e.params)


def trial_inventory_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, found = _trials(spark, sf_dir, True)
    return trials.trial_inventory(found, e.recordings, e.params)


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, found = _trials(spark, sf_dir, True)
    keep = ["recording_id", "start_sample", "sample_count", "generator_window_count", "classifier_window_count"]
    return trials.with_windows(found, e.params).select(*keep)


def trial_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, found = _trials(spark, sf_dir, True)
    return trials.with_windows(trials.trial_inventory(found, e.recordings, e.params), e.params)


def fragmented_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.fragmented(_trials(spark, sf_dir, True)[1])


def stream_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    return align.alignment_report(align.stream_lengths(e.samples), e.params.max_tail_mismatch)


def stream_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.stream_disagreement(_aligned(b.events(spark, sf_dir)))


def _coverage(spark: SparkSession, sf_dir: str, which) -> DataFrame:
    e = b.events(spark, sf_dir)
    return which(checks.active_sets(_aligned(e), e.params), e.recordings, e.params)


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir, checks.label_coverage)


def repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir, checks.repetition_coverage)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def channel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(channels.channel_statistics(written(b.lineitem_signal(spark, sf_dir), "samples"), SATURATION, "percentile"))


def _selected(signal: DataFrame) -> DataFrame:
    """Channel statistics by selection; the samples in parts are stored once, so that no round moves them."""
    return channels.channel_statistics(layout.store_parts(signal), SATURATION, "rank", keep=written)


def channel_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_selected(b.lineitem_signal(spark, sf_dir)))


def channel_quality_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_selected(b.embedding_signal(spark, sf_dir)))


def channel_quality_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(channels.channel_statistics(_aligned(b.events(spark, sf_dir)), SATURATION, "rank", chunk_samples=16))


def saturation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(channels.saturation_candidates(channels.extreme_statistics(b.lineitem_signal(spark, sf_dir, previous=False), SATURATION)))


def missing_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.parse_identity(b.event_paths(spark, sf_dir), strict=False).dropna(subset=["subject"])
    return checks.missing_recordings(b.event_pairs(spark, sf_dir), found)


def duplicate_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_recordings(files.parse_identity(b.event_paths(spark, sf_dir), strict=False).dropna(subset=["subject"]))


def parse_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_identity(b.event_paths(spark, sf_dir), strict=False)


def identity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.identity_mismatch(b.events(spark, sf_dir).recordings).drop("recording_id")


def label_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.label_validity(b.events(spark, sf_dir).raw, intake.LABELS)


def position_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and repeated positions of the five streams of recordings with gaps and repeats."""
    return intake.position_integrity(b.misplaced_events(spark, sf_dir))


def scalar_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.scalar_validity(b.events(spark, sf_dir).scalars)


def missing_variable_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    return missing_variables(e.recordings.where("acquisition = 1"), e.catalogue)


def channel_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.params import AuditParams

    return checks.channel_count_check(b.embedding_signal(spark, sf_dir, previous=False), AuditParams())


def _audit(spark: SparkSession, sf_dir: str, result: str) -> DataFrame:
    """One result over the events; the small tables it is made of are written once."""
    e = b.events(spark, sf_dir)
    return audit_dataset(e.raw, e.recordings, b.event_pairs(spark, sf_dir), e.params, e.catalogue, e.scalars, results=(result,), keep=written)[result]


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir, "issues")


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir, "file_inventory")


def participant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_audit(spark, sf_dir, "participant_summary"))


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys; windows as JSON text and subjects as a list in text, so that any engine can compare them."""
    out = _audit(spark, sf_dir, "dataset_summary")
    texts = {c: F.to_json(c) for c in ("generator_window", "classifier_window")} | {"subjects_requested": F.array_join("subjects_requested", ";")}
    return _rounded(out.withColumns(texts))


def rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir, "rollup_levels")


def audit_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.report_lines(_audit(spark, sf_dir, "dataset_summary").withColumn("data_root", F.lit("DB")))


def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.content_manifest(b.table(spark, sf_dir, "documents"), "source", "text")


def source_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").select(F.col("source").alias("subject"), F.octet_length("text").cast("bigint").alias("bytes"))
    return files.completeness(d, 50)


def collection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").select(F.col("source").alias("subject"), F.octet_length("text").cast("bigint").alias("bytes"))
    return files.collection_totals(d, 20, 1000)


QUERIES = {
    f.__name__: f
    for f in (
        trial_windows, trial_inventory, trial_inventory_chunked, window_counts, fragmented_trials, stream_alignment, stream_disagreement,
        label_coverage, repetition_coverage, channel_quality, channel_quality_rank, channel_quality_arrays, channel_quality_nonfinite,
        saturation_candidates, missing_recordings, duplicate_recordings, parse_identity, identity_mismatch, label_validity, scalar_validity, position_integrity,
        channel_count_check, issues, file_inventory, participant_summary, dataset_summary, rollup_levels, audit_report_lines,
        content_manifest, source_completeness, collection_totals,
    )
} | {"missing_variables": missing_variable_list}
