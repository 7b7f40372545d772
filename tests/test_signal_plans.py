"""Channel statistics of the signals: what is exchanged, and samples in parts against samples in one."""

import math
import re

from pyspark.sql import functions as F

from strandline.operators import channels
from strandline.plans import bindings, queries
from strandline.sources import layout, stage

NAN, INF = math.nan, math.inf
ODD = [[NAN, NAN, -0.0, INF], [1.0, NAN, 0.0, 1.0], [1.0, INF, 0.0, 2.0], [NAN, None, 5.0, -INF], [2.0, None, 5.0, 2.0], [1.0, NAN, 0.0, 2.0]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extremes_need_no_order(spark, sf):
    """Extremes and their repeats are those of channel_statistics, and come from one reading of unordered samples without a join."""
    df = spark.createDataFrame([(r, i, v) for r in "ab" for i, v in enumerate(ODD[ord(r) - 97 :])], "recording_id string, sample_index bigint, emg array<double>")
    columns = ["recording_id", "channel", "minimum", "maximum", "extreme_repeat_fraction", "potential_saturation"]
    for threshold in (0.0, 0.5, 0.9):
        want = channels.channel_statistics(df, threshold).where("finite_count > 0").select(*columns)
        assert sorted(map(tuple, channels.extreme_statistics(df.drop("sample_index"), threshold).select(*columns).collect())) == sorted(map(tuple, want.collect()))
    text = plan(queries.saturation_candidates(spark, sf))
    assert "Window" not in text and "Join" not in text and text.count("Scan parquet") == 1


def test_previous_sample_over_parts(spark):
    """The row before, over the edges of parts, empty parts, equal places and NULLs; rows without a key are left out."""
    rows = [(1, at, float(i), None if i % 5 == 0 else float(i % 2)) for i, at in enumerate([None, 0, 1, 1, 9, 10, 11, 35, 36, 70])]
    rows += [(2, 20, 7.0, 7.0), (None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k bigint, at bigint, a double, b double").repartition(8)
    out = bindings.followed(df, "k", F.floor(F.col("at") / 10), ["at", "a"], ["a", "b"], F.array)
    assert out.columns == ["recording_id", "part", "emg", "previous"]
    got = sorted((r.recording_id, r.emg, r.previous) for r in out.collect())
    arrays = [[a, b] for k, _, a, b in rows if k == 1]
    assert got == [("1", x, y) for x, y in zip(arrays, [None, *arrays[:-1]], strict=True)] + [("2", [7.0, 7.0], None)]


def test_signal_is_exchanged_once(spark, sf):
    """Lines go through one exchange, which both sides of the join read, and which has no columns but those that order lines or hold samples."""
    out = bindings.lineitem_signal(spark, sf)
    assert out.count() == bindings.table(spark, sf, "lineitem").where("l_suppkey is not null").count()
    out = bindings.lineitem_signal(spark, sf)
    out.collect()
    final = plan(out).split("Initial Plan")[0]
    assert "ReusedExchange" in final and "l_shipdate" not in final and "sample_index" not in final


def test_percentiles_with_given_previous_samples(spark):
    """Given the samples before, nothing is ordered, and values meet no table of extremes; the statistics are those by selection."""
    rows = [(r, i, v, ODD[i - 1] if i else None) for r in "ab" for i, v in enumerate(ODD)]
    df = spark.createDataFrame(rows, "recording_id string, sample_index bigint, emg array<double>, previous array<double>")
    given = channels.channel_statistics(df.drop("sample_index"), 0.5, "percentile")
    text = plan(given)
    assert "Window" not in text and text.count("Join") == 1  # moments with values
    want = channels.channel_statistics(df.drop("previous"), 0.5, "rank", 2)
    assert sorted(map(str, given.collect())) == sorted(map(str, want.collect()))


def test_rounds_move_no_stored_samples(spark):
    """Over samples stored in parts, no exchange of the selection has samples or values, though no join is a broadcast; results are those of plain samples."""
    rows = [("ab"[i % 2], i // 20, [math.sin(i), float(i % 7), NAN if i % 3 else 1.0]) for i in range(200)] + [("c", -5, [NAN, INF, None])]
    df = spark.createDataFrame(rows, "recording_id string, part bigint, emg array<double>")
    stored = layout.store_parts(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = channels.selected_values(stored)
        text = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        blocks = [b.strip() for b in text.split("\n\n")]
        moved = [re.search(r"Input \[\d+\]: \[(.*)\]", b).group(1) for b in blocks if re.match(r"\(\d+\) Exchange", b)]
        assert moved and not [m for m in moved if re.search(r"\b(emg|x|prev)#", m)]
        assert any("Bucketed: true" in b for b in blocks)
        want = sorted(map(str, channels.value_statistics(df.drop("part"), stage.written).collect()))
        for keep in (None, stage.written):
            assert sorted(map(str, channels.value_statistics(stored, keep).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
