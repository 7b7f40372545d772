"""Merkle manifests against a tree written out plainly, and against SQL."""

import hashlib
import zlib

import pytest

from compare import same
from strandline.llm import merkle
from strandline.llm.queries import LLM_SQL, op12_merkle_manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(d, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[3], d[2], d[4], text)))


def climb(nodes):
    """(root, siblings on the left and right of each node a level)"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            run = i // 8 * 8
            p.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def plain(docs):
    """Rows of the contract."""
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((d for d in docs if d[2] == x), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1]))) for x in langs]
    built = [climb([leaf(d, d[1]) for d in g]) for g in groups]
    root, upper = climb([b[0] for b in built])
    out = []
    for g, (subroot, paths), top in zip(groups, built, upper, strict=True):
        for d, p in zip(g, paths, strict=True):
            text = d[1]
            if d[0] is not None and text is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            x = leaf(d, text)
            for left, right in p + top:
                x = sha(left + x + right)
            out.append((d[0], leaf(d, d[1]), subroot, root, sha("".join(a + b for a, b in p + top)), x, x == root))
    return sorted(out, key=repr)


def run(spark, docs, **more):
    rows = merkle.audit(spark.createDataFrame(docs, DOCS), **more)
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, rows.collect()), key=repr)


def some(n, langs=("de", "en", None, "é", "Z")):
    return [(i * 7 % 101 + i, f"Text Number {i} ÄÖ", langs[i % len(langs)], f"s{i % 3}" if i % 4 else None, i if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 4])
@pytest.mark.parametrize("docs", [some(1), some(65, ("de",)), some(300), some(80, tuple(f"l{i}" for i in range(80)))])
def test_against_plain(spark, docs, levels):
    got = run(spark, docs, levels=levels)
    assert got == plain(docs)
    assert len({r[3] for r in got}) == 1


def test_odd_rows(spark):
    """Null fields, empty and long texts, equal rows, null and equal doc_ids."""
    docs = [(None, "A", "de", None, None), (None, None, None, None, None), (3, "", "de", "", 0), (3, "", "de", "", 0), (3, "B", "de", "", 0), (10, "Ab " * 100_000, "de", "x", 1), (11, None, "", "x", 1), (-5, "Q", "de", "x", 1)]
    docs += [(7, "Same", "de", "x", 4)] * 30
    assert run(spark, docs, levels=1) == run(spark, docs) == plain(docs)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "A", "de", "s", 1, 5, "x"), (2, "B", "de", "s", 1, 6, "y")], DOCS + ", tree bigint, root string")
    assert sorted(r.doc_id for r in merkle.audit(docs).collect()) == [1, 2]


def test_paths_and_versions(spark):
    """A proof folds to the root without the table; a version copies the ancestors only, one a level."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(some(300, ("de", "en")), DOCS)
    found = merkle.manifest(docs, list(merkle.FIELDS), "lang", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("0" * 64)), levels=2)
    rows = found.rows.withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("other", merkle.folded(F.lit("0" * 64), F.col("path"))).collect()
    assert len(rows) == 300 and all(r.folded == found.root and len(r.version) == len(r.path) for r in rows)
    assert all((r.version[-1] == found.root) if r.number % 2 else (r.version[-1] == r.other != found.root) for r in rows)


def test_query_against_sql(spark, sf):
    same(op12_merkle_manifest(spark, sf), LLM_SQL["op12_merkle_manifest"], sf)
