"""Accuracy on held-out rows, gradients against differences, and defined results at the edges."""

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandline.llm import langid
from strandline.llm.langid import Network, fit, identify, padded, predict

SCHEMA = "doc_id bigint, text string, lang string, score string, lang_pred int"


def test_given(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_gradients():
    net = Network(["a", "b"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, labels = padded([b"hello there", b"guten tag zusammen"]), np.array([0, 1])
    g = net.gradients(windows, labels)
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(2), labels]).mean()
    rng = np.random.default_rng(0)
    for name, p in net.p.items():
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in p.shape) if name != "embed" else (int(windows[0, rng.integers(0, 11)]), int(rng.integers(0, p.shape[1])))
            if name == "conv" and net.mask[at] == 0:
                assert g[name][at] == 0
                continue
            keep, e = p[at], 1e-6
            p[at] = keep + e
            up = loss()
            p[at] = keep - e
            down = loss()
            p[at] = keep
            assert abs((up - down) / (2 * e) - g[name][at]) < 1e-4


def test_against_plain_forward_pass(monkeypatch):
    """Every filter at every place, by loops."""
    monkeypatch.setattr(langid, "STEPS", 60)
    parts = [b"the cat and the dog and the house are here", b"der hund und die katze und das haus sind da"] * 10
    net = fit(parts, np.array([0, 1] * 10), ["en", "de"])
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text = "der Hund \u00e9tait l\u00e0 " * 15
    raw, total = text.encode(), np.zeros(2)
    for s in range(0, len(raw), langid.WINDOW):
        part = raw[s : s + langid.WINDOW]
        codes = [*part, *[256] * (langid.WINDOW + 3 - len(part))]
        h = []
        for f in range(len(langid.WIDTHS) * langid.FILTERS):
            width = langid.WIDTHS[f // langid.FILTERS]
            best = max(sum(p["embed"][codes[i + j]] @ p["conv"][j * langid.DIMENSION : (j + 1) * langid.DIMENSION, f] for j in range(width)) for i in range(langid.WINDOW))
            h.append(max(0.0, best + p["bias"][f]))
        out = np.exp(np.array(h) @ p["out"] + p["last"])
        total += out / out.sum() * len(part)
    names, scores = predict(net, [text])
    assert names == [["en", "de"][int(total.argmax())]] and abs(scores[0] - total.max() / len(raw)) < 1e-4


def test_rare_languages_are_learned(spark, monkeypatch):
    """A language with a thousandth of the rows is in the sample with as many texts as the others, or all it has."""
    monkeypatch.setattr(langid, "TRAIN_ROWS", 60)
    monkeypatch.setattr(langid, "LEAST_ROWS", 5)
    monkeypatch.setattr(langid, "STEPS", 250)
    rows = [Row(i, f"the cat and the dog {i} are here with the house", "en", "x", 1) for i in range(6000)] + [Row(10_000 + i, f"der hund und die katze {i} sind da im haus", "de", "x", 1) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert langid.train(df).languages == ["de", "en"]
    ask = spark.createDataFrame([Row(1, "die katze und der hund sind im haus", None, "x", 1)], SCHEMA)
    assert langid.label(ask, langid.train(df), carry=["doc_id"]).first().lang_pred == "de"
    clash = langid.label(ask, langid.train(df))
    assert clash.columns == ["doc_id", "text", "lang", "score", "lang_pred", "_lang_pred", "_score"]


def test_whole_text_counts(monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 200)
    parts = [b"the cat and the dog and the house are here", b"der hund und die katze und das haus sind da"] * 40
    net = fit(parts, np.array([0, 1] * 40), ["en", "de"])
    long = "the cat and the dog " * 30 + "der hund und die katze und das haus " * 400
    names, scores = predict(net, ["the dog and the cat", "das haus und der hund", long, None, "", "123 !?", "日本"])
    assert names[:6] == ["en", "de", "de", "und", "und", "und"] and names[6] in ("en", "de")
    assert scores[3] == scores[4] == scores[5] == 0


def test_edges(spark):
    rows = [Row(i, "the cat and the dog are here" if i % 2 else "der hund und die katze sind da", "en" if i % 2 else "de", "x", 1) for i in range(60)]
    odd = [Row(100, None, "en", "x", 1), Row(100, None, "en", "x", 1), Row(101, "", None, "x", 1), Row(None, "the cat", "en", "x", 1), Row(102, "cat " * 100_000, None, "x", 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = identify(df).collect()
    assert len(got) == 65 and sum(r.lang_pred == "und" for r in got) == 3
    assert identify(df.limit(0)).count() == 0
    none = spark.createDataFrame(odd, SCHEMA).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(none).collect()} == {"und"}


def test_sample_is_bounded_under_repeats(spark):
    """One id, or one text, in most rows neither fills the sample nor keeps other languages out."""
    rows = spark.range(30_000).select(F.lit(17).cast("bigint").alias("doc_id"), F.concat(F.lit("ein Satz "), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    copies = spark.range(30_000).select(F.lit(18).cast("bigint").alias("doc_id"), F.lit("one text many times").alias("text"), F.lit("en").alias("lang"))
    few = spark.createDataFrame([(i, f"un texte {i}", "fr") for i in range(5, 17)], "doc_id bigint, text string, lang string")
    got = {r.lang: r["count"] for r in langid.sample(rows.union(copies).union(few)).groupBy("lang").count().collect()}
    assert got["en"] == 1 and got["fr"] == 12 and 1000 < got["de"] < 1700
