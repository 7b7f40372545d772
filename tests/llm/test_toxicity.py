"""Accuracy on held-out rows, and defined results at the edges."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandline.llm import shingles as S
from strandline.llm import toxicity as T
from strandline.llm.toxicity import classify, train

DOCS, LABELS = "doc_id bigint, text string, score string, held_out int", "doc_id bigint, toxic int, quality int"


def made(spark, n=3000):
    rng = random.Random(0)
    calm, rude = [f"word{i}" for i in range(400)], ["grumble", "snarl", "hiss"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(calm) for _ in range(rng.randrange(3, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(rude).upper() + "!")
        docs.append(Row(doc_id=i, text=" ".join(text), score="clash", held_out=1))
        labels.append(Row(doc_id=i, toxic=toxic, quality=1))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out(spark):
    docs, labels = made(spark)
    rows = classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r.toxic for r in rows) > 0.99 * len(rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def hashed(text):
    """The present features of a text, one by one: words, neighbours, and pairs over one word."""
    word = "".join(c if c.isalnum() and c.isascii() or not c.isascii() else " " for c in text).split()
    code = {w: int(S.words_of(w.encode() + b" ").code[0]) for w in word}
    low = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & low
        h = (h ^ h >> 27) * 0x94D049BB133111EB & low
        return h ^ h >> 31

    step = [int(x) for x in T._STEP]
    keys = [code[w] for w in word]
    for gap in (1, 2):
        keys += [mix(code[a] * step[gap] + code[b] & low) for a, b in zip(word, word[gap:], strict=False)]
    return {(k * step[0] & low) >> (64 - T.BITS) for k in keys}


def plain_ftrl(rows):
    """FTRL-proximal written out for one weight at a time; the last key is the bias, which has no L1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == -1 else T.L1
        return 0.0 if abs(z[i]) <= l1 and i != -1 else -(z[i] - math.copysign(l1, z[i])) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)

    for _ in range(T.PASSES):
        for present, label in rows:
            w = {i: weight(i) for i in [*present, -1]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for i, x in w.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / T.ALPHA
                z[i] += g - sigma * x
                n[i] += g * g
    return {i: w for i in z if (w := weight(i)) or i == -1}


def test_against_plain_ftrl(spark):
    docs, labels = made(spark, 300)
    got = {r.feature: r.weight for r in train(docs, labels).collect()}
    order = docs.join(labels, "doc_id").orderBy(F.xxhash64("doc_id")).collect()
    want = plain_ftrl([(hashed(r.text), r.toxic) for r in order])
    assert set(got) == set(want) and all(got[i] == pytest.approx(w, rel=1e-6, abs=1e-9) for i, w in want.items())


def test_given(spark, sf):
    path = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.95 * sum(r.predicted for r in rows) and hit >= 0.75 * sum(r.toxic for r in rows)


def test_edges(spark):
    docs, labels = made(spark, 400)
    odd = spark.createDataFrame([Row(1, None, "", 0), Row(1, None, "", 0), Row(2, "", "", 0), Row(None, "grumble", "", 0), Row(3, "calm " * 200_000, "", 0)], DOCS)
    conflicting = labels.unionByName(labels).unionByName(spark.createDataFrame([Row(5, None, 1), Row(None, 1, 1), Row(9, 7, 0)], LABELS))
    got = classify(docs.unionByName(odd), conflicting).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.doc_id is None and r.held_out is None for r in got) == 1
    none = classify(odd, labels.limit(0)).collect()
    assert len(none) == 5 and all(r.score == 0 and r.predicted == 0 for r in none)
    assert classify(docs.limit(0), labels).count() == 0


def test_sample_has_one_row_for_an_id(spark):
    """However often an id is repeated, and with whatever texts."""
    docs = spark.range(5000).select(F.lit(17).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).union(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(17, 1), (1, 0), (2, 0), (4, 1)], "doc_id bigint, toxic int")
    rows = T.sample(docs, labels).collect()
    assert sorted((r.doc_id, r.toxic) for r in rows) == [(1, 0), (2, 0), (17, 1)]
