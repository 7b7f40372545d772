"""Intake of samples as they come: one pass gives lengths, integrity of positions, and verdicts on labels, whatever their type.

Samples may have label streams of any numeric type. ``sample_facts`` reads them once, and ``typed`` gives the same rows with integer
labels. Positions are gathered as bitmaps: in each (recording, word of 64 positions) a stream has one 64-bit number, so partial
aggregation leaves a row for 64 samples at most, and bits against rows tell gaps and repeats exactly. (``bitmap_construct_agg``
would keep larger words, but its buffer needs a sort of all samples where these need a hash table.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.expr import finite
from strandline.params import STREAMS

LABELS = STREAMS[1:]
WORD = 64


def is_label(column: str) -> Column:
    """A finite whole number of 32 bits. NULL (stream ended) is none."""
    x = F.col(column).cast("double")
    return finite(x) & (x == F.rint(x)) & (F.abs(x) <= 2147483647)


def typed(samples: DataFrame) -> DataFrame:
    """The samples with labels as integers; what is none becomes NULL, and its recording does not load."""
    kinds = dict(samples.dtypes)
    return samples.withColumns({c: F.when(is_label(c), F.col(c).cast("int")) for c in LABELS if kinds[c] != "int"})


def integer_labels(column: str) -> Column:
    """Aggregate: some label is not a finite whole number of 32 bits. NULL (stream ended) is no fault."""
    return F.coalesce(F.bool_or(F.when(F.col(column).isNotNull(), ~is_label(column))), F.lit(False))


def _position_words(samples: DataFrame, streams: tuple[str, ...], more: list[Column]) -> DataFrame:
    """For each (recording, word): of each stream the rows, the bits of their positions, and the end; rows without a position are misplaced."""
    at = F.col("sample_index")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(WORD)).cast("int"))
    aggs = [F.count_if((at.isNull() | (at < 0)) & reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in streams])).alias("misplaced")]
    for s in streams:
        placed = F.col(s).isNotNull() & (at >= 0)
        aggs += [F.count_if(placed).alias(f"{s}_rows"), F.bit_or(F.when(placed, bit)).alias(f"{s}_bits"), F.max(F.when(placed, at + 1)).alias(f"{s}_end")]
    return samples.groupBy("recording_id", F.floor(at / F.lit(WORD)).cast("bigint").alias("word")).agg(*aggs, *more)


def _positions(streams: tuple[str, ...]) -> list[Column]:
    out = [F.sum("misplaced").alias("misplaced")]
    for s in streams:
        length = F.coalesce(F.max(f"{s}_end"), F.lit(0)).cast("bigint")
        distinct = F.coalesce(F.sum(F.bit_count(f"{s}_bits")), F.lit(0))
        out += [length.alias(f"{s}_length"), (length - distinct).alias(f"{s}_missing"), (F.sum(f"{s}_rows") - distinct).alias(f"{s}_repeated")]
    return out


def position_integrity(samples: DataFrame, streams: tuple[str, ...] = STREAMS) -> DataFrame:
    """recording_id, misplaced (rows whose position is null or negative), and of each stream its length, missing and repeated positions."""
    return _position_words(samples, streams, []).groupBy("recording_id").agg(*_positions(streams))


def sample_facts(samples: DataFrame) -> DataFrame:
    """position_integrity, the least and largest width of the signal, {label}_invalid, and has_rows, in one pass over the samples."""
    wide = [F.min(F.size("emg")).alias("least"), F.max(F.size("emg")).alias("most")]
    words = _position_words(samples, STREAMS, [*wide, *[integer_labels(c).alias(f"{c}_invalid") for c in LABELS]])
    return words.groupBy("recording_id").agg(
        *_positions(STREAMS), F.min("least").alias("least"), F.max("most").alias("most"), *[F.bool_or(f"{c}_invalid").alias(f"{c}_invalid") for c in LABELS], F.lit(True).alias("has_rows")
    )
