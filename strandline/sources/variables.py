"""Required variables of each recording, from a long (recording_id, variable) catalogue."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.params import REQUIRED_VARIABLES


def missing_variables(recordings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """recording_id and the missing names in declared order, for recordings that lack any."""
    names = F.array(*[F.lit(v) for v in REQUIRED_VARIABLES])
    have = catalogue.where(F.col("variable").isin(list(REQUIRED_VARIABLES))).groupBy("recording_id").agg(F.collect_set("variable").alias("have"))
    lacks = F.filter(names, lambda v: ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), v))
    return (
        recordings.select("recording_id").join(have, "recording_id", "left")
        .select("recording_id", F.array_join(lacks, ", ").alias("missing")).where("missing <> ''")
    )
