"""Contiguous trials of a label stream (gaps and islands) and the windows that fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.expr import seconds, window_count
from strandline.params import AuditParams


def label_stream(samples: DataFrame, params: AuditParams) -> DataFrame:
    """recording_id, sample_index, movement, repetition of the chosen label source; the signal is not read."""
    movement, repetition = params.label_columns
    return samples.select("recording_id", "sample_index", F.col(movement).alias("movement"), F.col(repetition).alias("repetition"))


def _runs(rows: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Merges touching rows [start, stop) of one (movement, repetition), numbered by run_id. A run of any label separates its neighbours."""
    w = W.partitionBy(*keys).orderBy(start)
    before = F.lag(F.struct(F.col(stop).alias("at"), "movement", "repetition")).over(w)
    same = F.coalesce((before["at"] == F.col(start)) & before["movement"].eqNullSafe(F.col("movement")) & before["repetition"].eqNullSafe(F.col("repetition")), F.lit(False))
    return (
        rows.withColumn("is_new", (~same).cast("int"))
        .withColumn("run_id", F.sum("is_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "run_id", "movement", "repetition")
        .agg(F.min(start).alias("start_sample"), F.max(stop).alias("stop_sample"))
    )


def chunk_runs(labels: DataFrame, chunk_samples: int) -> DataFrame:
    """The runs inside each (recording, chunk), with edge: whether a run is the first or the last of its chunk.

    All others have neighbours in the chunk and are final; a run that goes on beyond its chunk is an edge on either side.
    """
    chunk = F.floor(F.col("sample_index") / F.lit(chunk_samples)).cast("bigint")
    parts = _runs(labels.withColumns({"chunk": chunk, "next_index": F.col("sample_index") + 1}), ["recording_id", "chunk"], "sample_index", "next_index")
    edge = (F.col("run_id") == 1) | (F.col("run_id") == F.max("run_id").over(W.partitionBy("recording_id", "chunk")))
    return parts.withColumn("edge", edge).drop("run_id")


def merged_runs(parts: DataFrame) -> DataFrame:
    """Runs of whole recordings. At most two rows of each chunk meet in a recording's scan; runs inside a chunk stay a group of their own."""
    group = F.when(F.col("edge"), -1).otherwise(F.col("chunk"))
    named = parts.select("recording_id", group.alias("part"), "movement", "repetition", F.col("start_sample").alias("part_start"), F.col("stop_sample").alias("part_stop"))
    return _runs(named, ["recording_id", "part"], "part_start", "part_stop").drop("part", "run_id")


def label_runs(labels: DataFrame, chunk_samples: int | None = None) -> DataFrame:
    """All maximal runs, rest included. A sample with a movement but no repetition, or the other way round, is an error: the streams end apart.

    With a chunk size, runs are found inside (recording, chunk) first, so that one very long recording is many tasks, and chunks
    send no more than their first and last run to the merge, however often labels change.
    """
    apart = F.col("movement").isNull() != F.col("repetition").isNull()
    error = F.raise_error(F.lit("label and repetition streams must have the same length")).cast(labels.schema["movement"].dataType)
    points = labels.withColumn("movement", F.when(apart, error).otherwise(F.col("movement")))
    if chunk_samples is None:
        return _runs(points.withColumn("next_index", F.col("sample_index") + 1), ["recording_id"], "sample_index", "next_index").drop("run_id")
    return merged_runs(chunk_runs(points, chunk_samples))


def trials(runs: DataFrame) -> DataFrame:
    """Runs with movement and repetition above 0, numbered per (movement, repetition) in start order."""
    order = W.partitionBy("recording_id", "movement", "repetition").orderBy("start_sample")
    return (
        runs.where("movement > 0 and repetition > 0")
        .withColumn("segment_index", F.row_number().over(order))
        .withColumn("sample_count", F.col("stop_sample") - F.col("start_sample"))
    )


def trial_inventory(found: DataFrame, recordings: DataFrame, params: AuditParams) -> DataFrame:
    """The 11 trial fields."""
    return found.join(recordings.select("recording_id", "subject", "exercise", "file"), "recording_id").select(
        "subject", "exercise", "file", F.lit(params.label_source).alias("label_source"), "movement", "repetition", "segment_index",
        "start_sample", "stop_sample", "sample_count", seconds(F.col("sample_count"), params.sampling_rate_hz).alias("duration_seconds"),
    )


def with_windows(inventory: DataFrame, params: AuditParams) -> DataFrame:
    """Adds both window definitions and how many whole windows fit each trial."""
    new = {}
    for name, window in (("generator", params.generator), ("classifier", params.classifier)):
        new[f"{name}_length_samples"] = F.lit(window.length_samples)
        new[f"{name}_step_samples"] = F.lit(window.step_samples)
        new[f"{name}_window_count"] = window_count(F.col("sample_count"), window)
    return inventory.withColumns(new)


def fragmented(found: DataFrame) -> DataFrame:
    """(movement, repetition) pairs cut into more than one kept run."""
    return found.groupBy("recording_id", "movement", "repetition").agg(F.count("*").alias("segments")).where("segments > 1")
