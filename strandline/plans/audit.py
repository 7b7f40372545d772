"""The whole audit as a set of DataFrames."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame

from strandline.operators import align, channels, checks, intake, rollup, trials
from strandline.operators.channels import Keep
from strandline.params import AuditParams

RESULTS = ("file_inventory", "trial_inventory", "window_counts", "channel_quality", "participant_summary", "issues", "dataset_summary", "rollup_levels")


def audit_dataset(
    samples: DataFrame, recordings: DataFrame, expected: DataFrame, params: AuditParams, catalogue: DataFrame | None = None, scalars: DataFrame | None = None,
    raw: DataFrame | None = None, method: str = "rank", results: tuple[str, ...] = RESULTS, keep: Keep | None = None,
) -> dict[str, DataFrame]:
    """The asked-for result tables by name.

    Label streams of samples may be of any numeric type: what they hold is judged in the same pass as lengths and positions.
    Samples are read for the per-recording facts, for label facts, for runs, and for channel statistics, each only if a
    result needs it. ``keep`` is given each of these small intermediate tables (facts, labels, trials, channels) with its name. By
    default all stays lazy; pass ``strandline.sources.stage.written`` to write them once, so that several results, or one that
    uses a table often, neither read the samples again nor carry their whole plan.
    """

    store = keep or (lambda df, name: df)

    @cache
    def facts() -> DataFrame:
        lengths = align.with_spans(intake.sample_facts(samples), recordings)
        return store(checks.recording_facts(recordings, lengths, params, catalogue, scalars, raw), "facts")

    @cache
    def loaded() -> DataFrame:
        return facts().where("stop_category is null")

    @cache
    def aligned() -> DataFrame:
        return align.truncate(intake.typed(samples), loaded())

    @cache
    def labels() -> DataFrame:
        return store(checks.label_facts(aligned(), params), "labels")

    @cache
    def found() -> DataFrame:
        return store(trials.trials(trials.label_runs(trials.label_stream(aligned(), params), params.chunk_samples)), "trials")

    @cache
    def quality() -> DataFrame:
        wide = loaded().select("recording_id", "channel_count")
        return store(channels.channel_statistics(aligned(), params.extreme_repeat_threshold, method, params.chunk_samples, wide, keep), "channels")

    named = recordings.select("recording_id", "subject", "exercise", "file")
    windows = lambda: trials.with_windows(found(), params)

    @cache
    def issues() -> DataFrame:
        return checks.issues(facts(), labels(), trials.fragmented(found()), expected, recordings, params)

    @cache
    def files() -> DataFrame:
        return rollup.file_inventory(loaded(), labels(), found(), quality(), params)

    @cache
    def people() -> DataFrame:
        return rollup.participant_summary(files(), windows().join(named, "recording_id"), named.join(quality(), "recording_id"), issues(), params)

    build = {
        "file_inventory": files,
        "trial_inventory": lambda: trials.trial_inventory(found(), recordings, params),
        "window_counts": lambda: trials.with_windows(trials.trial_inventory(found(), recordings, params), params),
        "channel_quality": lambda: named.join(quality(), "recording_id").drop("recording_id"),
        "participant_summary": people,
        "issues": issues,
        "dataset_summary": lambda: rollup.dataset_summary(expected, recordings, files(), windows(), quality(), issues(), params),
        "rollup_levels": lambda: rollup.rollup_levels(files(), windows(), quality()),
    }
    return {name: build[name]() for name in results}
