"""Per-channel quality statistics on the aligned signal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.expr import finite

Keep = Callable[[DataFrame, str], DataFrame]
#: Bits of a value's image that a round of selection counts by.
BITS = 16
QUANTILES = {"p001": 0.001, "p01": 0.01, "median": 0.5, "p99": 0.99, "p999": 0.999}
STATISTICS = ("minimum", "maximum", "mean", "standard_deviation", "rms", *QUANTILES, "zero_fraction", "flat_difference_fraction", "extreme_repeat_fraction")


def long_signal(samples: DataFrame, previous: bool = True, chunk_samples: int | None = None) -> DataFrame:
    """recording_id, channel (from 1), x and, if asked for, the previous sample's value prev.

    Samples may have the column previous, the array of the sample before. If not, lag runs on the array, one sort for each recording.
    With a chunk size, each chunk's last row is copied to the next chunk, so that long recordings are many tasks.
    """
    emg = F.col("emg").cast("array<double>").alias("emg")
    if not previous:
        return samples.select("recording_id", F.posexplode(emg).alias("pos", "x")).select("recording_id", (F.col("pos") + 1).alias("channel"), "x")
    if "previous" in samples.columns:
        rows = samples.select("recording_id", emg, F.col("previous").cast("array<double>").alias("prev"))
    elif chunk_samples is None:
        w = W.partitionBy("recording_id").orderBy("sample_index")
        rows = samples.select("recording_id", "sample_index", emg).withColumn("prev", F.lag("emg").over(w))
    else:
        rows = samples.select("recording_id", "sample_index", emg)
        chunk = F.floor(F.col("sample_index") / F.lit(chunk_samples)).cast("bigint")
        edge = (F.col("sample_index") + 1) % F.lit(chunk_samples) == 0
        w = W.partitionBy("recording_id", "chunk").orderBy("sample_index")
        rows = (
            rows.withColumn("chunk", F.explode(F.when(edge, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
            .withColumn("prev", F.lag("emg").over(w)).where(F.col("chunk") == chunk)
        )
    pairs = F.arrays_zip(F.col("emg").alias("x"), F.coalesce("prev", F.transform("emg", lambda _: F.lit(None).cast("double"))).alias("prev"))
    return rows.select("recording_id", F.posexplode(pairs).alias("pos", "v")).select("recording_id", (F.col("pos") + 1).alias("channel"), F.col("v.x").alias("x"), F.col("v.prev").alias("prev"))


def _moments(signal: DataFrame) -> DataFrame:
    x, ok, both = F.col("x"), finite(F.col("x")), finite(F.col("x")) & finite(F.col("prev"))
    v = F.when(ok, x)
    aggs = [
        F.count("*").alias("sample_count"), F.count_if(ok).alias("finite_count"), F.count_if(~ok).alias("nonfinite_count"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("standard_deviation"),
        F.sqrt(F.avg(v * v)).alias("rms"), F.avg((v == 0).cast("double")).alias("zero_fraction"),
        F.coalesce(F.avg(F.when(both, (x == F.col("prev")).cast("double"))), F.lit(0.0)).alias("flat_difference_fraction"),
    ]
    return signal.groupBy("recording_id", "channel").agg(*aggs)


def with_image(rows: DataFrame) -> DataFrame:
    """Adds image, a 64-bit integer in the order of the finite doubles x; -0.0 and 0.0 have the same.

    Exponent and mantissa are found by exact products with powers of two, a step a projection, so that none is computed twice.
    """
    x, size = F.col("x"), F.abs("x")
    part = size * F.pow(F.lit(2.0), -F.col("_near"))
    mantissa = ((size * F.pow(F.lit(2.0), -F.col("_exponent")) - 1) * F.lit(2.0**52)).cast("bigint")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")  # below the least normal number, and 0
    out = rows.withColumn("_near", F.floor(F.log2(size)).cast("bigint"))
    out = out.withColumn("_exponent", F.col("_near") + F.when(part >= 2, 1).when(part < 1, -1).otherwise(0))
    out = out.withColumn("_bits", F.when(size < F.lit(2.0**-1022), tiny).otherwise((F.col("_exponent") + 1023) * F.lit(1 << 52) + mantissa))
    return out.withColumn("image", F.when(x < 0, -F.col("_bits")).otherwise(F.col("_bits"))).drop("_near", "_exponent", "_bits")


def _wanted(n: Column) -> Column:
    """The ranks (from 0) that statistics of n values need: those around each percentile, the first and the last."""
    ranks = [f(F.lit(q) * (n - 1)).cast("bigint") for q in QUANTILES.values() for f in (F.floor, F.ceil)]
    return F.array(F.lit(0).cast("bigint"), *ranks, n - 1)


def selected_values(samples: DataFrame, keep: Keep | None = None, bits: int | None = None) -> DataFrame:
    """recording_id, channel, n, below, c, lo, hi: the values at the wanted ranks of each channel, by radix selection.

    Each round counts values by the next bits of their image, inside the prefixes that hold a wanted rank: c values from lo to hi
    with ``below`` values less than them. Values are never sorted, and no task holds more of a prefix than its 2 ** bits counts. After
    the last round lo is hi. With keep, each round's few rows are stored, and only prefixes of more than one value go on; without, all
    rounds are in one lazy plan, which has two rounds of 32 bits unless told otherwise. Samples are read once a round and meet the
    prefixes of their recording before they are unpivoted; samples in parts (column part) meet them part by part.
    """
    bits = bits or (BITS if keep else 32)
    keys = ["recording_id", "channel"]
    places = [c for c in ("recording_id", "part") if c in samples.columns]
    parts = (keep or (lambda df, name: df))(samples.select(*places).distinct(), "parts") if "part" in places else None
    found, done = None, []
    for step in range(64 // bits):
        prefix = F.shiftright("image", 64 - bits * (step + 1))
        counted = [F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")]
        if found is None:
            counts = with_image(long_signal(samples, False).where(finite(F.col("x")))).groupBy(*keys, prefix.alias("prefix")).agg(*counted)
            group = W.partitionBy(*keys)
            counts = counts.withColumns({"n": F.sum("c").over(group), "start": F.lit(0).cast("bigint")})
        else:
            of_channel = found.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("prefix", "below"))).alias("p"))
            of_channel = of_channel.select("recording_id", "channel", F.struct("n", F.col("p.prefix").alias("prefixes"), F.col("p.below").alias("belows")).alias("of"))
            by_channel = of_channel.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "of"))).alias("of"), F.max("channel").alias("last"))
            of_recording = by_channel.select("recording_id", F.transform(F.sequence(F.lit(1), "last"), lambda c: F.try_element_at("of", c)).alias("of"))
            of_place = of_recording if parts is None else parts.join(of_recording, "recording_id")
            rows = samples.select(*places, F.col("emg").cast("array<double>").alias("emg")).join(of_place, places)
            rows = rows.select("recording_id", F.posexplode(F.arrays_zip(F.col("emg").alias("x"), F.col("of").alias("of"))).alias("pos", "v"))
            rows = with_image(rows.select("recording_id", (F.col("pos") + 1).alias("channel"), F.col("v.x").alias("x"), F.col("v.of").alias("of")).where(finite(F.col("x"))))
            at = F.array_position("of.prefixes", F.shiftright("image", 64 - bits * step))
            rows = rows.select(*keys, "x", "of", prefix.alias("prefix"), at.cast("int").alias("at")).where("at > 0")
            counts = rows.groupBy(*keys, "prefix", F.col("of.n").alias("n"), F.element_at("of.belows", F.col("at")).alias("start")).agg(*counted)
            group = W.partitionBy(*keys, F.shiftright("prefix", bits))
        upto = F.col("start") + F.sum("c").over(group.orderBy("prefix").rowsBetween(W.unboundedPreceding, 0))
        counts = counts.withColumn("below", upto - F.col("c"))
        holds = F.exists(_wanted(F.col("n")), lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c")))
        found = counts.where(holds).select(*keys, "n", "prefix", "below", "c", "lo", "hi")
        if keep is not None:
            # Prefixes of one value are done; only the others go on.
            stored = keep(found, f"ranks-{step}")
            done.append(stored.where("lo = hi"))
            found = stored.where("lo < hi")
            if found.isEmpty():
                break
    return reduce(DataFrame.unionByName, done) if keep is not None else found


def value_statistics(samples: DataFrame, keep: Keep | None = None, bits: int | None = None) -> DataFrame:
    """Exact percentiles and the extreme-repeat fraction of each channel.

    A percentile interpolates the two values around rank q(n-1); the extremes' counts are those of the least and largest value.
    """
    keys = ["recording_id", "channel"]

    def at(rank: Column, what: str) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("c")), F.col(what)))

    n = F.col("n")
    aggs = [F.max("n").alias("n"), F.greatest(at(F.lit(0), "c"), at(n - 1, "c")).alias("most")]
    for name, q in QUANTILES.items():
        aggs += [at(f(F.lit(q) * (n - 1)), "lo").alias(f"{name}_{end}") for f, end in ((F.floor, "lo"), (F.ceil, "hi"))]
    out = selected_values(samples, keep, bits).groupBy(*keys).agg(*aggs)
    rank = {name: F.lit(q) * (n - 1) for name, q in QUANTILES.items()}
    return out.select(
        *keys, *[(F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (r - F.floor(r))).alias(name) for name, r in rank.items()],
        (F.col("most") / n).alias("extreme_repeat_fraction"),
    )


def _counted(samples: DataFrame) -> DataFrame:
    """recording_id, channel, x, c: each finite value of a channel with the number of its samples."""
    return long_signal(samples, False).where(finite(F.col("x"))).groupBy("recording_id", "channel", "x").agg(F.count("*").alias("c"))


def _extreme_repeats() -> Column:
    """Aggregate of counted values: larger of the shares of finite values equal to the minimum and to the maximum."""
    return (F.greatest(F.min_by("c", "x"), F.max_by("c", "x")) / F.sum("c")).alias("extreme_repeat_fraction")


def counted_statistics(samples: DataFrame) -> DataFrame:
    """Exact percentiles and the extreme-repeat fraction of each channel, from its different values and their counts."""
    q = F.percentile("x", F.array(*[F.lit(q) for q in QUANTILES.values()]), F.col("c"))
    out = _counted(samples).groupBy("recording_id", "channel").agg(q.alias("q"), _extreme_repeats())
    return out.select("recording_id", "channel", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)], "extreme_repeat_fraction")


def extreme_statistics(samples: DataFrame, threshold: float) -> DataFrame:
    """What saturation_candidates() needs of channel_statistics(), for channels with a finite value; samples may be in any order."""
    out = _counted(samples).groupBy("recording_id", "channel").agg(F.min("x").alias("minimum"), F.max("x").alias("maximum"), _extreme_repeats())
    varies = F.col("minimum") != F.col("maximum")
    return out.withColumn("potential_saturation", varies & (F.col("extreme_repeat_fraction") >= threshold))


def channel_statistics(samples: DataFrame, threshold: float, method: str = "rank", chunk_samples: int | None = None, recordings: DataFrame | None = None, keep: Keep | None = None) -> DataFrame:
    """One row for each (recording, channel): counts, 13 statistics and two flags.

    method: ``rank`` (radix selection: no sort of values, up to four passes over the values; ``keep`` stores the few rows of each) or
    ``percentile`` (values are counted first, then a value-count map in memory for each group); both are exact.
    With recordings (recording_id, channel_count), channels of recordings without a sample have a row as well.
    """
    if method not in ("percentile", "rank"):
        raise ValueError("method must be percentile or rank")
    keys = ["recording_id", "channel"]
    values = value_statistics(samples, keep) if method == "rank" else counted_statistics(samples)
    out = _moments(long_signal(samples, True, chunk_samples)).join(values, keys, "left")
    if recordings is not None:
        some = recordings.where("channel_count > 0").select("recording_id", F.explode(F.sequence(F.lit(1), "channel_count")).alias("channel"))
        out = some.join(out, keys, "left").fillna(0, ["sample_count", "finite_count", "nonfinite_count"])
    empty = F.col("finite_count") == 0
    constant = F.col("minimum") == F.col("maximum")
    return out.withColumn("flat_difference_fraction", F.when(~empty, F.col("flat_difference_fraction"))).select(
        *keys, "sample_count", "finite_count", "nonfinite_count", *STATISTICS,
        F.when(empty, True).otherwise(constant).alias("constant_channel"),
        F.when(empty, False).otherwise(~constant & (F.col("extreme_repeat_fraction") >= threshold)).alias("potential_saturation"),
    )


def saturation_candidates(statistics: DataFrame) -> DataFrame:
    return statistics.where("potential_saturation").select("recording_id", "channel", "minimum", "maximum", "extreme_repeat_fraction")
