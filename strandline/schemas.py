"""Explicit schemas of the canonical tables."""

from pyspark.sql import types as T

SAMPLES = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("sample_index", T.LongType()),
        T.StructField("emg", T.ArrayType(T.DoubleType())),
        *[T.StructField(c, T.IntegerType()) for c in ("stimulus", "restimulus", "repetition", "rerepetition")],
    ]
)
RECORDINGS = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in ("subject", "exercise", "acquisition")],
        T.StructField("file", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("file_bytes", T.LongType()),
        *[T.StructField(c, T.IntegerType()) for c in ("stored_subject", "stored_exercise", "channel_count")],
    ]
)
ISSUES = T.StructType([T.StructField(c, T.IntegerType() if c in ("subject", "exercise") else T.StringType()) for c in ("severity", "subject", "exercise", "file", "category", "detail")])
MANIFEST = "subject string, url string, bytes bigint, sha256 string, status string"
