"""Each stage against a plain version of what it decides, and the whole run."""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from strandline.llm import langid, mixing, neardup, shingles, toxicity
from test_neardup import shingle_set


def odd(spark, sf):
    """The documents with junk, null and repeated rows, and columns named like those that the operators add."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.limit(3).collect()
    more = [(10**6, "12345 678", "en", "src1", 9), (10**6 + 1, None, None, None, None), (None, some[0].text, "en", None, 1), (None, "", None, None, 0), *map(tuple, some), tuple(some[0])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(4)
    clash = {c: F.lit(i) for i, c in enumerate(("score", "lang_pred", "position", "slot", "in_mix", "kept", "component_id", "n_shingles", "_doc_id", "_source"))}
    return docs.withColumns(clash)


def test_language(spark, sf):
    """Against the network applied window by window, with loops for every product and maximum."""
    docs = odd(spark, sf)
    kept = P.language(spark, docs, sf)
    assert kept.columns == docs.columns
    net = langid.train(docs.where(langid.learnable(F.col("doc_id"))))
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        if not any(c.isalpha() for c in r.text or ""):
            continue
        parts = [raw[i : i + langid.WINDOW] for i in range(0, len(raw), langid.WINDOW)]
        p = sum(langid.softmax(np.maximum(net.hidden(langid.padded([x]))[0].max(axis=1) + net.p["bias"], 0) @ net.p["out"] + net.p["last"])[0] * len(x) for x in parts) / len(raw)
        if p.max() >= P.SURE:
            want.append(r)
    assert sorted(kept.collect(), key=str) == sorted(want, key=str)
    assert {10**6, 10**6 + 1}.isdisjoint({r.doc_id for r in want}) and len(want) >= 0.98 * (docs.count() - 3)


def test_clean(spark, sf):
    """Against a plain sum of weights over a text's words and pairs."""
    docs = odd(spark, sf)
    kept = P.clean(spark, docs, sf)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fold = toxicity.learnable(F.col("doc_id"))
    weights = {r.feature: np.float32(r.weight) if r.feature >= 0 else r.weight for r in toxicity.train(docs.where(fold), labels.where(fold)).collect()}
    want = []
    for r in docs.collect():
        found = {f for _, w in shingles.text_words(pa.array([r.text or ""]), toxicity._SEPARATORS) if len(w.code) for f in toxicity.features(w.code).tolist()}
        if 1 / (1 + math.exp(-(sum(float(weights.get(f, 0)) for f in found) + weights[-1]))) < toxicity.THRESHOLD:
            want.append(r)
    assert sorted(kept.collect(), key=str) == sorted(want, key=str) and 0 < len(want) < docs.count()


def test_deduplicate(spark, sf):
    """Against all pairs of sets: one row of each group, rows without a doc_id untouched."""
    docs = odd(spark, sf)
    for stage, (up, down) in ((P.deduplicate, (85, 100)), (P.deduplicate_corpus, P.SIMILAR)):
        kept = stage(spark, docs, sf).collect()
        rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
        sets = {i: shingle_set(t) for i, t in rows.items()}
        root = {i: i for i in sets}

        def find(a, root=root):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in itertools.combinations(sorted(sets), 2):
            x, y = sets[a], sets[b]
            if x and y and down * min(len(x), len(y)) >= up * max(len(x), len(y)) and down * len(x & y) >= up * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({find(i) for i in sets})
        assert sum(r.doc_id is None for r in kept) == 2
        assert set(kept) <= set(docs.collect())


def test_tokens(spark, sf):
    docs = odd(spark, sf)
    coded = P.tokens(spark, docs, sf)
    assert coded.count() == docs.count() and coded.where("n_tokens is null").count() == docs.where("text is null").count()


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    n, distinct = out.agg(F.count("*"), F.countDistinct("doc_id")).first()
    assert n == distinct and 0 < n < spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.where("n_tokens <> size(ids)").count() == 0


def test_empty(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_mix_keeps_every_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sources = ["hot"] * 900 + [f"s{i % 5}" for i in range(400)] + [None] * 3
    given = spark.createDataFrame([(i, f"text {i}", "en", s, 6) for i, s in enumerate(sources)], docs.schema)
    for df in (given, docs):
        mixed = P.mix(spark, df, sf).collect()
        assert sorted(mixed, key=str) == sorted(df.collect(), key=str)
        order = [r.doc_id for r in mixing.schedule(df, ["doc_id"]).orderBy("position", F.coalesce("source", F.lit(""))).collect()]
        assert [r.doc_id for r in mixed] == order
    clashing = odd(spark, sf)
    mixed = P.mix(spark, clashing, sf)
    assert mixed.columns == clashing.columns and sorted(mixed.collect(), key=str) == sorted(clashing.collect(), key=str)


def test_stage_links_from_080(spark, sf):
    words = [f"w{i}" for i in range(200)]
    edited = list(words)
    for at in (20, 60, 100, 140):  # twenty of 196 shingles differ: 176 of 216 in common
        edited[at] = f"e{at}"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a", 1), (2, " ".join(edited), "en", "a", 1)], schema)
    assert neardup.near_duplicates(docs).where("kept").count() == 2
    stage = dict(P.STAGES)["near_duplicates"]
    assert [r.doc_id for r in stage(spark, docs, sf).collect()] == [1]
    given = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in stage(spark, given, sf).collect()} == {r.doc_id for r in neardup.near_duplicates(given, (80, 100)).where("kept").collect()}
