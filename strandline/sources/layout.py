"""Stored layouts of samples in which the audit, or channel statistics, need no shuffle of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from strandline.sources.stage import new_folder


def store_samples(samples: DataFrame, table: str, buckets: int) -> DataFrame:
    """Writes samples as a table bucketed by recording, one sorted file a bucket, and returns the table.

    Lengths, positions, runs, differences, alignment, channel statistics and joins with per-recording tables all group by the
    recording or by something inside it, so each bucket's task does them on its own rows. Take about as many buckets as
    ``spark.sql.shuffle.partitions``, and enough that a bucket fits a task; a recording is not split over buckets.
    """
    sorted_rows = samples.repartition(buckets, "recording_id").sortWithinPartitions("recording_id", "sample_index")
    sorted_rows.write.bucketBy(buckets, "recording_id").sortBy("recording_id", "sample_index").saveAsTable(table)
    return samples.sparkSession.table(table)


def store_parts(samples: DataFrame) -> DataFrame:
    """Writes samples in parts to the shared folder, as a table bucketed by recording and part, and returns the table.

    Joins with tables of (recording, part) need no exchange of the samples then, and a long recording is many tasks. Samples that come
    from an exchange by these two columns are not exchanged again.
    """
    spark = samples.sparkSession
    name = f"parts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    samples.write.bucketBy(buckets, "recording_id", "part").option("path", new_folder(spark, "parts")).saveAsTable(name)
    return spark.table(name)
