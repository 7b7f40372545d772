"""Alignment of streams of unequal length. One narrow groupBy finds the lengths; the rest is a filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.params import STREAMS


def stream_lengths(samples: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """recording_id, {stream}_length, shortest, longest, {stream}_removed. With recordings, those without a sample have length 0."""
    end = {s: F.coalesce(F.max(F.when(F.col(s).isNotNull(), F.col("sample_index") + 1)), F.lit(0)).cast("bigint") for s in STREAMS}
    return with_spans(samples.groupBy("recording_id").agg(*[e.alias(f"{s}_length") for s, e in end.items()]), recordings)


def with_spans(lengths: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Adds shortest, longest and {stream}_removed to {stream}_length, and the recordings without a sample."""
    out = lengths
    if recordings is not None:
        out = recordings.select("recording_id").join(out, "recording_id", "left").fillna(0, [f"{s}_length" for s in STREAMS])
    each = [F.col(f"{s}_length") for s in STREAMS]
    out = out.withColumns({"shortest": F.least(*each), "longest": F.greatest(*each)})
    return out.withColumns({f"{s}_removed": F.col(f"{s}_length") - F.col("shortest") for s in STREAMS})


def within_tolerance(lengths: DataFrame, max_tail_mismatch: int) -> DataFrame:
    return lengths.where(F.col("longest") - F.col("shortest") <= max_tail_mismatch)


def truncate(samples: DataFrame, lengths: DataFrame) -> DataFrame:
    """Samples before the shortest stream's end, of the recordings in ``lengths``.

    No broadcast hint: the lengths have a row for each recording, so Spark checks their size.
    """
    return samples.join(lengths.select("recording_id", "shortest"), "recording_id").where("sample_index < shortest").drop("shortest")


def zip_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """Positional zip of separately stored streams (recording_id, sample_index, value): NULL beyond a stream's end.

    One shuffle: the streams are put under each other and gathered by position. A position that a stream has more than once is as
    many rows, so that it is not hidden.
    """
    named = [df.select("recording_id", "sample_index", F.col("value").alias(name)) for name, df in streams.items()]
    under = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    found = under.groupBy("recording_id", "sample_index").agg(*[F.collect_list(name).alias(name) for name in streams])
    return found.select("recording_id", "sample_index", F.inline_outer(F.arrays_zip(*streams)))


def removed_text() -> Column:
    """``emg=1, stimulus=1``: streams with a removal, in stream order."""
    parts = [F.when(F.col(f"{s}_removed") > 0, F.concat(F.lit(f"{s}="), F.col(f"{s}_removed").cast("string"))) for s in STREAMS]
    return F.concat_ws(", ", *parts)


def alignment_report(lengths: DataFrame, max_tail_mismatch: int) -> DataFrame:
    """Each recording's lengths, what alignment removes, and whether it is within tolerance."""
    ok = F.col("longest") - F.col("shortest") <= max_tail_mismatch
    return lengths.select(
        "recording_id",
        *[f"{s}_length" for s in STREAMS],
        F.col("shortest").alias("aligned_length"),
        ok.alias("within_tolerance"),
        F.when(ok, removed_text()).alias("removed"),
    )
