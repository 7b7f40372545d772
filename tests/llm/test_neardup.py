"""Near duplicates against all pairs, on given and on hand-made documents."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandline.llm import hot, neardup
from strandline.llm import setsketch as K
from strandline.llm import shingles as S
from strandline.llm.graph import components
from strandline.llm.neardup import near_duplicates


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def compare(df):
    rows = near_duplicates(df).collect()
    assert len(rows) == df.count() and all(r.component_id is None and r.kept is None for r in rows if r.doc_id is None)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    want = brute([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    assert got == want


def planted():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append(Row(doc_id=n * 3 + 1, text=text, n_shingles=5, component_id="x"))
        n += 1

    for length in (3, 4, 5, 6, 12, 40, 200, 900):
        base = [rng.choice(vocabulary) for _ in range(length)]
        add(" ".join(base))
        add("\t".join(base).upper() + "\n")
        for edits in (1, 2, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(length)] = rng.choice(vocabulary)
            add(" ".join(copy))
        add(" ".join(base[:-1]))
        add(" ".join([*base, "more"]))
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(40):
        add(" ".join([rng.choice(vocabulary) for _ in range(30)] + shared))
    for text in (None, "", " \n ", "one", "One", "é à", "É à", "a b\x00c", "a b c"):
        add(text)
    rows.append(Row(doc_id=None, text="lost", n_shingles=1, component_id="x"))
    return rows


SCHEMA = "doc_id bigint, text string, n_shingles int, component_id string"


def test_given(spark, sf):
    compare(spark.read.parquet(f"{sf}/documents.parquet"))


def test_planted(spark):
    compare(spark.createDataFrame(planted(), SCHEMA))


def test_blocks_and_large_buckets(spark, monkeypatch):
    """A family of many near copies in several blocks; buckets larger than the bound."""
    monkeypatch.setattr(neardup, "BLOCK_DOCUMENTS", 16)
    monkeypatch.setattr(neardup, "BUCKET", 8)
    rng = random.Random(1)
    base = [f"v{rng.randrange(4000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append(Row(doc_id=1000 - i, text=" ".join(copy), n_shingles=0, component_id=""))
    compare(spark.createDataFrame(rows, SCHEMA))


def test_long_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(300_000))
    df = spark.createDataFrame([Row(doc_id=2, text=text, n_shingles=0, component_id=""), Row(doc_id=1, text=text + " end", n_shingles=0, component_id="")], SCHEMA)
    assert sorted(map(tuple, near_duplicates(df).collect())) == [(1, 299_997, 1, True), (2, 299_996, 1, False)]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("j", [0.3, 0.6, 0.85, 0.95])
def test_likelihood_finds_similarity(j):
    rng = np.random.default_rng(0)
    found = []
    for _ in range(60):
        n = int(1000 * 2 * j / (1 + j))
        x = rng.integers(0, 2**63, 1000).astype(np.uint64)
        y = np.concatenate([x[:n], rng.integers(0, 2**63, 1000 - n).astype(np.uint64)])
        a, b = K.registers(x), K.registers(y)
        ll = K.log_likelihood(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([1000.0]), np.array([1000.0]))
        found.append(ll[0].argmax() / 100)
    assert abs(np.mean(found) - j) < 0.04


def test_registers_merge():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 2**63, 500).astype(np.uint64), rng.integers(0, 2**63, 300).astype(np.uint64)
    assert (K.registers(np.concatenate([x, y])) == np.maximum(K.registers(x), K.registers(y))).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (101, 100), (200, 200), (300, 70), (70, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100, 300: 70, 70: 70}
    assert got == want


def near_pairs():
    """Texts and edited copies, some from 0.80 to 0.85 and some below, and a pair of 0.80 itself."""
    rng = random.Random(9)
    texts = []
    for i in range(60):
        base = [f"p{i}w{j}" for j in range(200)]
        texts.append((i, 1.0, " ".join(base)))
        for n in (4, 5):  # an edit in the middle costs five shingles of 196
            copy = list(base)
            for at in rng.sample(range(10, 190, 10), n):
                copy[at] = f"e{rng.randrange(10**9)}"
            texts.append((i, n, " ".join(copy)))
    base = [f"q{j}" for j in range(13)]
    texts.append((60, 1.0, " ".join(base)))
    texts.append((60, 0.8, " ".join(base[:12] + ["last"])))
    return [Row(doc_id=i, text=t, n_shingles=0, component_id="") for i, (_, _, t) in enumerate(texts)]


@pytest.mark.parametrize("threshold", [(80, 100), (85, 100)])
def test_threshold(spark, threshold):
    rows = near_pairs()
    sets = [shingle_set(r.text) for r in rows]
    want = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if threshold[1] * len(sets[a] & sets[b]) >= threshold[0] * len(sets[a] | sets[b]):
                want.add((a, b))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold).collect()}
    root = {i: i for i in got}
    for a, b in sorted(want):
        root[b] = min(root[b], root[a])
    assert got == root
    assert bool(want) == (threshold == (80, 100))


def test_bands_keep_pairs_at_the_threshold():
    for t in (0.8, 0.85, 0.9):
        r = neardup.band_rows(t)
        assert (1 - t**r) ** (K.REGISTERS // r) < 1e-5
    assert neardup.band_rows(0.85) == K.ROWS


def sketched(spark, n, same):
    """n classes that share one band, of which two have equal registers."""
    rng = np.random.default_rng(0)
    band = rng.integers(0, 60000, K.ROWS).astype(np.uint16)
    rows = []
    for i in range(n):
        s = K.registers(rng.integers(0, 2**63, 50).astype(np.uint64))
        s[: K.ROWS] = band
        rows.append([i, 50, s])
    rows[same[1]][2] = rows[same[0]][2]
    return spark.createDataFrame([Row(doc_id=i, n_shingles=n, sketch=bytearray(x.tobytes())) for i, n, x in rows], "doc_id bigint, n_shingles bigint, sketch binary")


@pytest.mark.parametrize("n,same", [(400, (5, 350)), (200, (5, 150))])
def test_buckets_across_arrow_batches(spark, n, same):
    """Equal registers meet however a bucket is cut into Arrow batches; a bucket over the bound is one family."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (10_000, 60, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            edges = {(r.u, r.v) for r in neardup.families(sketched(spark, n, same), 0.85).collect()}
            root = neardup.small_components(n, np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
            assert root[same[0]] == root[same[1]]
            assert n <= neardup.BUCKET or (root == 0).all()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_words_of_one_polynomial_value(spark):
    """Complementary Thue-Morse words have equal polynomial hashes modulo powers of two; they are not equal."""
    rows = []
    for n in (1024, 2048, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        rows += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    got = near_duplicates(spark.createDataFrame([Row(doc_id=i, text=t, n_shingles=0, component_id="") for i, t in enumerate(rows)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, 1, i) for i in range(6)]


@pytest.mark.parametrize("bits", [3, 6, 64])
def test_links_do_not_trust_hashes(monkeypatch, bits):
    """With a hash of few bits, sizes and links are still those of the texts."""
    monkeypatch.setattr(S, "mix", lambda h: h & np.uint64((1 << bits) - 1))
    rows = [r for r in planted() if r.doc_id is not None]
    texts = pa.array([r.text for r in rows])
    for row, words in S.text_words(texts):
        assert len(S.shingles(words)) == len(shingle_set(rows[row].text))
    ids = [r.doc_id for r in rows]
    zero = pa.array([0] * len(ids), pa.int64())
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, zero, pa.array(ids), texts], ["family", "low", "high", "block", "doc_id", "text"])
    edges = [(u, v) for b in neardup._links(85, 100)(iter([batch])) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
    at = {d: i for i, d in enumerate(ids)}
    root = neardup.small_components(len(ids), np.array([at[u] for u, _ in edges]), np.array([at[v] for _, v in edges]))
    assert {d: ids[root[at[d]]] for d in ids} == {d: c for d, (_, c) in brute([(r.doc_id, r.text) for r in rows]).items()}


def test_same_set_in_another_order(spark):
    """Texts of one set but different word sequences are linked."""
    base = [f"s{i}" for i in range(40)]
    rows = [" ".join(base * 2), " ".join(base * 3), " ".join(base * 3) + " other"]
    compare(spark.createDataFrame([Row(doc_id=i, text=t, n_shingles=0, component_id="") for i, t in enumerate(rows)], SCHEMA))


def test_hot_keys_are_split(spark, monkeypatch):
    """A join whose keys are mostly one gives the rows of a plain join."""
    monkeypatch.setattr(hot, "LEAST", 4)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "u bigint, v bigint")
    keyed = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    got = hot.spread_join(rows, keyed, ["u"], "c", 300)
    assert sorted(map(tuple, got.select("u", "v", "m", "c").collect())) == sorted(map(tuple, rows.join(keyed, "u").select("u", "v", "m", "c").collect()))
    edges = spark.createDataFrame([(i, 7 if i > 7 else 900) for i in range(400)], "u bigint, v bigint")
    assert dict(map(tuple, components(edges).collect())) == {i: 0 for i in [*range(400), 900]}
