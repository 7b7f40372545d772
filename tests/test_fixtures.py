"""Small cases with hand-made inputs and exact expected values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import AuditParams, Window
from strandline.functions.expr import window_count
from strandline.operators import align, channels, checks, intake, trials
from strandline.params import milliseconds_to_samples
from strandline.plans.audit import audit_dataset
from strandline.sources import stage

SAMPLES = "recording_id string, sample_index bigint, emg array<double>, stimulus int, restimulus int, repetition int, rerepetition int"
RECORDINGS = "recording_id string, subject int, exercise int, acquisition int, file string, relative_path string, file_bytes bigint, stored_subject int, stored_exercise int, channel_count int"
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("n,length,step,expected", [(1999, 2000, 1000, 0), (2000, 2000, 1000, 1), (3000, 2000, 1000, 2), (10000, 2000, 1000, 9), (10000, 400, 200, 49), (0, 5, 1, 0)])
def test_window_counts(spark, n, length, step, expected):
    row = spark.range(1).select(window_count(F.lit(n), Window(length, step)).alias("c")).first()
    assert row.c == expected
    starts = list(range(0, n - length + 1, step))
    assert len(starts) == expected


def test_window_errors(spark):
    with pytest.raises(Exception, match="must not be negative"):
        spark.createDataFrame([(-1,)], "n int").select(window_count(F.col("n"), Window(2000, 1000))).collect()
    for length, step in ((0, 1000), (2000, 0), (-1, 1)):
        with pytest.raises(ValueError):
            Window(length, step)


@pytest.mark.parametrize("bad", [{"sampling_rate_hz": 0}, {"expected_channels": 0}, {"label_source": "x"}, {"extreme_repeat_threshold": 1.1}, {"extreme_repeat_threshold": -0.1}, {"max_tail_mismatch": -1}, {"chunk_samples": 0}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        AuditParams(**bad)


def test_milliseconds():
    assert milliseconds_to_samples(200, 2000) == 400
    for bad in ((0, 2000), (-1, 2000), (0.3, 2000)):
        with pytest.raises(ValueError):
            milliseconds_to_samples(*bad)


def labels(spark, movement, repetition, recording="r"):
    return spark.createDataFrame([(recording, i, m, r) for i, (m, r) in enumerate(zip(movement, repetition, strict=True))], "recording_id string, sample_index bigint, movement int, repetition int")


@pytest.mark.parametrize("chunk", [None, 1, 2, 3, 4, 100])
def test_trials(spark, chunk):
    df = labels(spark, [0, 1, 1, 0, 1, 1, 0, 2, 2], [0, 1, 1, 0, 1, 1, 0, 1, 1])
    got = {(r.movement, r.repetition, r.segment_index, r.start_sample, r.stop_sample, r.sample_count) for r in trials.trials(trials.label_runs(df, chunk)).collect()}
    assert got == {(1, 1, 1, 1, 3, 2), (1, 1, 2, 4, 6, 2), (2, 1, 1, 7, 9, 2)}


@pytest.mark.parametrize("chunk", [None, 2, 3])
def test_repetition_alone_changes(spark, chunk):
    df = labels(spark, [1, 1, 1, 1, 3, 3], [1, 1, 2, 2, 0, 0])
    got = {(r.movement, r.repetition, r.start_sample, r.stop_sample) for r in trials.trials(trials.label_runs(df, chunk)).collect()}
    assert got == {(1, 1, 0, 2), (1, 2, 2, 4)}
    assert trials.label_runs(df, chunk).agg(F.sum(F.col("stop_sample") - F.col("start_sample"))).first()[0] == 6


@pytest.mark.parametrize("chunk", [None, 2])
def test_unequal_label_streams_are_refused(spark, chunk):
    for movement, repetition in (([1, 1, 1], [1, 1, None]), ([1, None], [1, 1])):
        with pytest.raises(Exception, match="must have the same length"):
            trials.trials(trials.label_runs(labels(spark, movement, repetition), chunk)).collect()


def test_expected_pairs(spark):
    """Requested subjects count once each, and exercises are those of the label table."""
    params = AuditParams(subjects=(3, 1, 1), expected_labels={2: (1,), 5: (2,)})
    assert sorted(map(tuple, checks.requested_pairs(spark, params).collect())) == [(1, 2), (1, 5), (3, 2), (3, 5)]
    assert params.requested_subjects == (1, 1, 3) and checks.requested_pairs(spark, AuditParams()).count() == 120


@pytest.mark.parametrize("bits", [4, 8, 16, 32])
def test_percentiles_by_radix(spark, bits):
    """Percentiles do not depend on how many bits a round counts by, nor on whether rounds are stored."""
    rows = [[x, 7.5] for x in (-1e308, 1e308, 0.0, 0.0, -0.0, 1.0, 2.5, 2.5, 7.0, 1e-300)]
    for keep in (None, stage.written):
        one, two = channels.value_statistics(signal(spark, rows), keep, bits).orderBy("channel").collect()
        assert (one.extreme_repeat_fraction, one.median, one.p01) == (0.1, 0.5, np.percentile([r[0] for r in rows], 1)) and (two.median, two.extreme_repeat_fraction) == (7.5, 1.0)


def test_image_keeps_the_order_of_doubles(spark):
    """The image is strictly monotonic and equals the bits of the number, at all exponents, next to powers of two and below the normal ones."""
    rng = np.random.default_rng(2)
    bits = np.concatenate([rng.integers(0, 0x7FEF_FFFF_FFFF_FFFF, 3000), [k << 52 for k in range(2047)], [(k << 52) - 1 for k in range(1, 2048)], [(k << 52) + 1 for k in range(2047)], [0, 1, 2, 3]]).astype(np.uint64)
    x = bits.view(np.float64)
    df = spark.createDataFrame([(float(v), int(b)) for v, b in zip(x, bits, strict=True)], "x double, b bigint")
    both = df.unionByName(df.select((-F.col("x")).alias("x"), (-F.col("b")).alias("b")))
    assert channels.with_image(both).where("image <> b or image is null").count() == 0


def test_selection_against_numpy(spark):
    """Outliers, subnormals and many equal values; a prefix with nearly all values is not sorted and not one task's."""
    rng = np.random.default_rng(1)
    n = 20_000
    a = np.append(rng.random(n), 1e9)
    b = np.append(rng.integers(0, 3, n) * 5e-324, -1e-310)
    c = np.append(1000 + rng.normal(size=n) * 1e-9, np.nan)
    d = np.append(np.round(rng.normal(size=n), 1), np.inf)
    df = signal(spark, np.stack([a, b, c, d], 1).tolist()).repartition(8)
    got = channels.value_statistics(df, stage.written).orderBy("channel").collect()
    for row, x in zip(got, (a, b, c, d), strict=True):
        x = x[np.isfinite(x)]
        want = np.percentile(x, [100 * q for q in channels.QUANTILES.values()])
        assert np.allclose([row[k] for k in channels.QUANTILES], want, rtol=1e-13, atol=0)
        assert row.extreme_repeat_fraction == max((x == x.min()).mean(), (x == x.max()).mean())
    plan = channels.selected_values(df)._jdf.queryExecution().executedPlan().toString()
    assert "orderBy" not in plan and "Sort [x" not in plan and "Sort [recording_id" in plan  # windows sort counts only


def test_chunks_send_two_runs_at_most(spark):
    """Labels that change at every sample: all but two runs of a chunk are final inside it."""
    n, chunk = 1000, 100
    df = labels(spark, [i % 2 + 1 for i in range(n)], [1] * n)
    parts = trials.chunk_runs(df, chunk)
    assert parts.count() == n and parts.where("edge").groupBy("chunk").count().where("count > 2").count() == 0 and parts.where("edge").count() == 2 * n // chunk
    assert trials.trials(trials.merged_runs(parts)).count() == n
    one = labels(spark, [1] * 250, [1] * 250)
    assert trials.chunk_runs(one, chunk).where("edge").count() == 3 and trials.label_runs(one, chunk).first().stop_sample == 250


def test_no_samples_no_trials(spark):
    assert trials.trials(trials.label_runs(labels(spark, [], []), 5)).count() == 0


def signal(spark, rows, recording="r"):
    return spark.createDataFrame([(recording, i, v) for i, v in enumerate(rows)], "recording_id string, sample_index bigint, emg array<double>")


@pytest.mark.parametrize("method", ["percentile", "rank"])
@pytest.mark.parametrize("chunk", [None, 1, 3])
def test_channel_statistics(spark, method, chunk):
    df = signal(spark, [[1.0, x] for x in (0.0, 1.0, NAN, 2.0, 3.0, 4.0, 5.0, 6.0)])
    one, two = channels.channel_statistics(df, 0.5, method, chunk).orderBy("channel").collect()
    assert one.constant_channel and one.nonfinite_count == 0 and not one.potential_saturation
    assert (one.standard_deviation, one.rms, one.flat_difference_fraction, one.extreme_repeat_fraction) == (0, 1, 1, 1)
    assert not two.constant_channel and two.nonfinite_count == 1 and two.finite_count == 7
    close = {"minimum": 0, "maximum": 6, "mean": 3, "standard_deviation": 2, "rms": math.sqrt(13), "median": 3, "p001": 0.006, "p01": 0.06, "p99": 5.94, "p999": 5.994, "zero_fraction": 1 / 7, "flat_difference_fraction": 0, "extreme_repeat_fraction": 1 / 7}
    assert all(abs(two[k] - v) < 1e-12 for k, v in close.items())
    assert not two.potential_saturation
    assert channels.channel_statistics(df, 0.1, method, chunk).where("channel = 2").first().potential_saturation


@pytest.mark.parametrize("method", ["percentile", "rank"])
def test_odd_values(spark, method):
    df = signal(spark, [[NAN, NAN, -0.0, INF], [1.0, NAN, 0.0, 1.0], [1.0, INF, 0.0, 2.0], [NAN, None, 5.0, -INF]])
    a, b, c, d = channels.channel_statistics(df, 0.75, method, 2).orderBy("channel").collect()
    assert (a.finite_count, a.flat_difference_fraction, a.constant_channel) == (2, 1.0, True)
    assert (b.finite_count, b.nonfinite_count, b.mean, b.flat_difference_fraction, b.constant_channel, b.potential_saturation) == (0, 4, None, None, True, False)
    assert (c.zero_fraction, c.flat_difference_fraction, c.extreme_repeat_fraction, c.potential_saturation) == (0.75, 2 / 3, 0.75, True)
    assert (d.finite_count, d.minimum, d.maximum, d.flat_difference_fraction) == (2, 1.0, 2.0, 0.0)


def test_one_sample_and_threshold_zero(spark):
    df = signal(spark, [[2.0, 3.0]])
    assert all(r.flat_difference_fraction == 0 and r.constant_channel and not r.potential_saturation for r in channels.channel_statistics(df, 0.0).collect())


def test_channels_without_samples(spark):
    recordings = spark.createDataFrame([("empty", 2), ("none", 0)], "recording_id string, channel_count int")
    rows = channels.channel_statistics(signal(spark, []), 0.5, "rank", recordings=recordings).collect()
    assert sorted(r.channel for r in rows) == [1, 2] and all(r.sample_count == 0 and r.mean is None and r.constant_channel for r in rows)


def streams(spark, lengths, recording="r"):
    rows = []
    for i in range(max(lengths.values())):
        rows.append((recording, i, [float(i)] * 2 if i < lengths["emg"] else None, *[i if i < lengths[s] else None for s in ("stimulus", "restimulus", "repetition", "rerepetition")]))
    return spark.createDataFrame(rows, SAMPLES)


def test_alignment(spark):
    df = streams(spark, {"emg": 6, "stimulus": 6, "restimulus": 5, "repetition": 6, "rerepetition": 5})
    lengths = align.stream_lengths(df)
    row = lengths.first()
    assert (row.shortest, row.emg_removed, row.stimulus_removed, row.restimulus_removed, row.repetition_removed, row.rerepetition_removed) == (5, 1, 1, 0, 1, 0)
    assert align.truncate(df, align.within_tolerance(lengths, 1)).count() == 5
    assert align.alignment_report(lengths, 1).first().removed == "emg=1, stimulus=1, repetition=1"
    assert align.within_tolerance(lengths, 0).count() == 0


def test_separate_streams(spark):
    one = lambda n: spark.createDataFrame([("r", i, i) for i in range(n)], "recording_id string, sample_index bigint, value int")
    df = align.zip_streams({"stimulus": one(2), "repetition": one(1)})
    assert df.where("repetition is null").count() == 1 and df.count() == 2
    twice = one(3).union(one(1))
    df = align.zip_streams({"stimulus": twice, "repetition": one(3)})
    assert df.count() == 4 and df.where("sample_index = 0").count() == 2
    assert str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning") == 1
    assert intake.position_integrity(df, ("stimulus", "repetition")).first().stimulus_repeated == 1


def audit(spark, samples, recordings, **more):
    params = AuditParams(expected_channels=2, max_tail_mismatch=1, subjects=(1,), generator=Window(2, 1), classifier=Window(1, 1), expected_labels={1: (1,), 2: (), 3: ()}, expected_repetitions=(1,), chunk_samples=2)
    return audit_dataset(samples, recordings, checks.requested_pairs(spark, params), params, **more)


def test_audit_of_every_kind_of_issue(spark):
    good = lambda r: [(r, i, [float(i), 1.0], 1, 1, 1, 1) for i in range(4)]
    rows = good("a") + good("dup") + [("long", i, [0.0, 0.0], 1, 1 if i < 1 else None, 1, 1) for i in range(4)]
    rows += [("hole", i, [0.0, 0.0], None if i == 1 else 1, 1, 1, 1) for i in range(3)]
    rows += [("wide", i, [0.0] * (2 + i), 1, 1, 1, 1) for i in range(3)]
    rows += [("frag", i, [0.0, float(i)], 1, m, 1, m) for i, m in enumerate((1, 0, 1, 2))]
    samples = spark.createDataFrame(rows, SAMPLES)
    rec = lambda name, exercise, stored=1, n=2: (name, 1, exercise, 1, "same.mat", f"dir_{name}/same.mat", 10, stored, exercise, n)
    recordings = spark.createDataFrame([rec("a", 1), rec("dup", 1, 9), rec("long", 2), rec("hole", 2), rec("wide", 2), rec("frag", 1, 1, 3), rec("gone", 2), rec("zero", 2, 1, 0)], RECORDINGS)
    scalars = spark.createDataFrame([(r, v, 1.9) for r in ("a", "frag", "long", "hole", "wide", "zero") for v in ("subject", "exercise")] + [("dup", "subject", NAN), ("dup", "exercise", 1.0)], "recording_id string, variable string, value double")
    out = audit(spark, samples, recordings, scalars=scalars, keep=stage.written)
    found = {(r.category, r.detail) for r in out["issues"].collect()}
    assert ("missing_file", "expected one MATLAB file") in found
    assert ("duplicate_file", "observed 3 MATLAB files") in found and ("duplicate_file", "observed 5 MATLAB files") in found
    assert ("load_failure", "no samples") in found
    assert ("invalid_metadata", "subject must contain a finite value") in found
    assert ("invalid_metadata", "stimulus has a gap before its end") in found
    assert ("invalid_metadata", "time-series length mismatch exceeds 1 sample(s): emg=4, stimulus=4, restimulus=1, repetition=4, rerepetition=4") in found
    assert ("invalid_emg_shape", "channels vary from 2 to 4") in found
    assert ("channel_count", "observed=3, expected=2") in found
    assert ("movement_coverage", "observed=[1, 2], expected=[1]") in found
    assert ("repetition_coverage", "observed=[1, 2], expected=[1]") in found
    assert ("fragmented_trial", "movement=1, repetition=1, segments=2") in found
    files = {r.relative_path: r for r in out["file_inventory"].collect()}
    assert set(files) == {"dir_a/same.mat", "dir_frag/same.mat", "dir_zero/same.mat"}
    assert files["dir_a/same.mat"].active_labels == "1" and files["dir_zero/same.mat"].emg_samples == 0
    summary = out["dataset_summary"].first()
    assert summary.audit_status == "fail" and summary.successfully_loaded_file_count == 3 and summary.observed_file_count == 8 and summary.expected_file_count == 3
    levels = {r.level: r for r in out["rollup_levels"].collect()}
    assert levels[3].samples == summary.total_emg_samples == 8
    assert summary.channel_record_count == sum(1 for _ in out["channel_quality"].collect()) and summary.trial_segment_count == out["trial_inventory"].count()


def test_positions(spark):
    """Repeated positions do not hide a gap, in any stream; a position must be a number from 0 on."""
    at = [0, 1, 2, 2, 2, 5, None, -1]
    df = spark.createDataFrame([("r", i, [0.0], 1, 1, 1, 1) for i in at], SAMPLES)
    row = intake.position_integrity(df).first()
    assert (row.misplaced, row.emg_length, row.emg_missing, row.emg_repeated, row.stimulus_missing, row.stimulus_repeated) == (2, 6, 2, 2, 2, 2)
    big = spark.createDataFrame([("r", i, [0.0], 1, 1, 1, 1 if i != 70 else None) for i in [*range(200), 130]], SAMPLES)
    row = intake.position_integrity(big).first()
    assert (row.emg_length, row.emg_missing, row.emg_repeated, row.rerepetition_missing, row.rerepetition_repeated) == (200, 0, 1, 1, 1)
    for positions, text in (([0, 1, 1, 2], "emg has repeated positions"), ([0, 1, 3], "emg has a gap before its end"), ([0, -1], "samples without a position")):
        samples = spark.createDataFrame([("a", i, [0.0, 1.0], 1, 1, 1, 1) for i in positions], SAMPLES)
        recordings = spark.createDataFrame([("a", 1, 1, 1, "f", "d/f", 1, 1, 1, 2)], RECORDINGS)
        out = audit(spark, samples, recordings, results=("issues",))["issues"].where("category = 'invalid_metadata'").collect()
        assert [r.detail for r in out] == [text]


def test_identity_and_labels_as_stored(spark):
    """Identity comes from the scalars where there are some; labels of any type are judged as they come in."""
    samples = spark.createDataFrame([(r, i, [0.0, 1.0], 1.0, 1.0, 1.0, x) for r, x in (("a", 1.0), ("b", 1.0), ("c", 1.5), ("d", 3e9)) for i in range(3)], SAMPLES.replace(" int", " double"))
    recordings = spark.createDataFrame([(r, 1, 1, k, r, f"x/{r}", 1, 1, 1, 2) for k, r in enumerate("abcd")], RECORDINGS)
    scalars = spark.createDataFrame([("a", "subject", 7.0), ("b", "subject", 3e9), ("c", "subject", 1.0), ("d", "exercise", 1e300)], "recording_id string, variable string, value double")
    found = {(r.file, r.category): r.detail for r in audit(spark, samples, recordings, scalars=scalars, results=("issues",))["issues"].collect() if r.file}
    assert found["a", "subject_mismatch"] == "filename=1, variable=7" and found["b", "subject_mismatch"] == "filename=1, variable=3000000000"
    assert found["c", "invalid_metadata"] == "rerepetition must contain finite integer labels" and found["d", "invalid_metadata"] == "exercise must contain a finite value"
    assert ("c", "subject_mismatch") not in found


def test_label_rules(spark):
    raw = spark.createDataFrame([("ok", 0, 1.0), ("ok", 1, None), ("half", 0, 1.5), ("nan", 0, NAN), ("inf", 0, INF), ("big", 0, 3e9)], "recording_id string, sample_index bigint, stimulus double")
    got = {r.recording_id: r.stimulus_invalid for r in checks.label_validity(raw, ("stimulus",)).collect()}
    assert got == {"ok": False, "half": True, "nan": True, "inf": True, "big": True}
