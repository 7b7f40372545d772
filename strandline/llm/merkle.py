"""Merkle manifest of a table: a tree of SHA-256 digests for each value of a column, a tree over their roots, proofs and versions.

A row's leaf is the digest of its fields, each with its length. Every FAN consecutive nodes of a level have a parent until one
is left. Trees are cut into aligned blocks of FAN ** levels nodes; a block is built in one task, and the roots of blocks are the
nodes of the next stage, so a tree of any size is many tasks. Trees are persistent: a version with one other leaf copies only
that leaf's ancestors and shares all else. Copies are made inside the leaf's block first. Upwards from there a version needs no
more than its block's path (the siblings at each level), which all versions of the block share, so versions stay where their
leaves are and no task holds those of a whole tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.batches import sorted_runs
from strandline.llm.store import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels that a block spans.
FAN, LEVELS = 8, 4
#: Rows whose proofs are in memory at once.
AT_ONCE = 1024
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels above some nodes until one is left; none above a lone node."""
    out = 0
    while nodes > 1:
        nodes, out = -(-nodes // FAN), out + 1
    return out


def grow(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def steps(tree: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each node below the top: the siblings on its left and on its right, each run together."""
    return [[("".join(level[i - i % FAN : i]), "".join(level[i + 1 : i - i % FAN + FAN])) for i in range(len(level))] for level in tree[:-1]]


def version(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """The nodes that a version with this leaf does not share: the leaf's ancestors, copied one by one up to the root."""
    out = []
    for left, right in path:
        leaf = digest(left + leaf + right)
        out.append(leaf)
    return out


def leaf(fields: list[Column]) -> Column:
    """Digest of some fields, each as "-" if null, else UTF-8 byte count, ":" and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _placed(rows: DataFrame, tree: list[str], order: list[str], name: str) -> DataFrame:
    """rows with tree (a number, ascending with the tree columns, null first), pos (0, 1, ... in the tree by ``order``) and n, the tree's size.

    Rows are sorted once by ranges and numbered inside each; only one count for each range and tree is added up, so a tree that
    has most rows is many tasks.
    """
    by = [F.col(c).asc_nulls_first() for c in [*tree, *order]]
    stored = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)
    counts = stored.groupBy(*[F.col(c).alias(f"_{c}") for c in tree], part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_c"))
    own = W.partitionBy(*[f"_{c}" for c in tree])
    before = F.sum("_c").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = written(counts.withColumns({"_start": F.coalesce(before, F.lit(0)), "n": F.sum("_c").over(own), "tree": F.min("_first").over(own)}), f"{name}-starts")
    same = part == F.col("_part")
    for c in tree:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stored.join(starts, same).select(*rows.columns, "tree", (F.col("_start") + F.col("_id") - F.col("_first")).alias("pos"), "n")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after another."""
    for rows, run in sorted_runs(batches, ["tree", "block"]):
        edges = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), rows.num_rows]
        for low, high in zip(edges, edges[1:], strict=False):
            yield rows.slice(low, high - low)


def _by_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**levels)).cast("bigint"))


def _rise(nodes: DataFrame, levels: int) -> DataFrame:
    """The next stage: tree, pos, n, digest of the roots of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole(batches):
            tree, number, n = (block.column(c)[0].as_py() for c in ("tree", "block", "n"))
            top = grow(block.column("digest").to_pylist(), min(levels, height(n)))[-1]
            yield pa.RecordBatch.from_pydict({"tree": [tree], "pos": [number], "n": [-(-n // FAN**levels)], "digest": top})

    blocks = _by_block(nodes.select("tree", "pos", "n", "digest"), levels).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return blocks.mapInArrow(run, "tree bigint, pos bigint, n bigint, digest string")


def _lists(items: list[list], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, items)]), pa.int32()), values)


def _paths(paths: list[list[tuple[str, str]]]) -> pa.Array:
    flat = [s for p in paths for s in p]
    return _lists(paths, pa.StructArray.from_arrays([pa.array([x for x, _ in flat], pa.string()), pa.array([x for _, x in flat], pa.string())], fields=list(_STEP)))


def _fall(nodes: DataFrame, above: DataFrame, levels: int, versions: bool) -> DataFrame:
    """Gives each node its path to the root, from the path of its block (above: tree, pos, path, subroot).

    With versions, nodes have number, digest and other (the leaf of the version, null for the same leaf), and also get the nodes
    that the version copies.
    """
    kept = ["number", "other"] if versions else []
    names = ["tree", "pos", "subroot", *(["number", "leaf", "version"] if versions else []), "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole(batches):
            top = [(s["left"], s["right"]) for s in block.column("path")[0].as_py()]  # the block's own row comes first
            subroot = block.column("subroot")[0].as_py()
            block = block.slice(1)
            if not block.num_rows:
                continue
            leaves = block.column("digest").to_pylist()
            own = steps(grow(leaves, min(levels, height(block.column("n")[0].as_py()))))
            for low in range(0, len(leaves), AT_ONCE):
                part = block.slice(low, AT_ONCE)
                paths = [[s[i // FAN**k] for k, s in enumerate(own)] + top for i in range(low, low + part.num_rows)]
                new = [pa.array([subroot] * part.num_rows)]
                if versions:
                    copied = [version(o or x, p) for x, o, p in zip(leaves[low:], part.column("other").to_pylist(), paths, strict=False)]
                    new += [part.column("number").combine_chunks(), part.column("digest").combine_chunks(), _lists(copied, pa.array([x for c in copied for x in c], pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("tree").combine_chunks(), part.column("pos").combine_chunks(), *new, _paths(paths)], names)

    below = _by_block(nodes.select("tree", "pos", "n", "digest", *kept), levels)
    rows = below.unionByName(above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "path", "subroot"), allowMissingColumns=True)
    path = "array<struct<left: string, right: string>>"
    schema = "tree bigint, pos bigint, subroot string, " + ("number bigint, leaf string, version array<string>, " if versions else "") + f"path {path}"
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, schema)


def _stages(nodes: DataFrame, most: int, levels: int, name: str) -> list[DataFrame]:
    """nodes, roots of their blocks, and so on, until no tree has two."""
    out = [nodes]
    while True:
        out.append(written(_rise(out[-1], levels), f"{name}-{len(out)}"))
        most = -(-most // FAN**levels)
        if most <= 1:
            return out


class Manifest(NamedTuple):
    """root, and rows: number (of the order column), leaf, subroot, path (left and right siblings a level, from leaf to root), version."""

    root: str | None
    rows: DataFrame


def manifest(rows: DataFrame, fields: list[str], tree: str, order: str, other: Column, levels: int = LEVELS) -> Manifest:
    """Leaves of all rows, a tree for each value of ``tree`` (null is one) with leaves by ``order`` (a number, null first), and the tree over their roots.

    other: the leaf of each row's version, or null where it has no other; ``version`` then recomputes the ancestors of the same leaf.
    Rows of equal order are placed by their leaf; equal rows are leaves of their own. Without rows there is no root.
    """
    made = rows.select(F.col(tree).cast("string").alias("name"), F.col(order).cast("bigint").alias("number"), leaf([F.col(f) for f in fields]).alias("digest"), other.alias("other"))
    # Numbers of rows tell equal rows apart, so that these too are dealt over ranges.
    made = written(made.withColumn("row", F.monotonically_increasing_id()), "merkle-made")
    leaves = _placed(made, ["name"], ["number", "digest", "row"], "merkle-leaves")
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return Manifest(None, rows.sparkSession.createDataFrame([], "number bigint, leaf string, version array<string>, subroot string, path array<struct<left: string, right: string>>"))
    trees = _stages(leaves, most, levels, "merkle-tree")
    tops = _placed(trees[-1].select(F.col("tree").alias("below"), "digest"), [], ["below"], "merkle-tops")
    count = tops.agg(F.max("n")).first()[0]
    over = _stages(tops, count, levels, "merkle-top")
    root = over[-1].first()["digest"]
    path = over[-1].select("tree", "pos", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.lit(None).cast("string").alias("subroot"))
    for stage in over[-2::-1]:
        path = _fall(stage, path, levels, False)
    path = path.drop("subroot").join(tops.select("pos", "below", F.col("digest").alias("subroot")), "pos").select(F.col("below").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", "subroot")
    for i, stage in enumerate(trees[-2::-1]):
        path = _fall(stage, written(path, f"merkle-path-{i}"), levels, i == len(trees) - 2)
    return Manifest(root, path.select("number", "leaf", "version", "subroot", "path"))


def folded(candidate: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give; no table but the proof is needed."""
    return F.aggregate(path, candidate, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]).cast("binary"), 256))


def audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, where every third one is tampered with.

    Tampering lower-cases A-Z of the text where 3 divides the CRC-32 of the decimal doc_id. Null fields are "-"; a null lang has
    a tree of its own; a null doc_id comes first in its tree and is not tampered with; a null, empty or lower-case text stays as it
    is and verifies. Equal rows are leaves of their own. Further columns are left out, and an empty table gives an empty result.
    """
    docs = docs.select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(tampered, leaf([lowered(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]))
    found = manifest(docs, list(FIELDS), "lang", "doc_id", other, levels)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    root = F.lit(found.root).cast("string")
    # A lone leaf is the root itself, and so is its version.
    last = F.when(F.size("version") > 0, F.element_at("version", -1)).otherwise(F.col("leaf"))
    return found.rows.select(
        F.col("number").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        last.alias("folded_root"), (last == root).alias("verified"),
    )


def sql(below: int = 6, above: int = 3) -> str:
    """audit over documents as SQL, for trees of at most FAN ** below rows and FAN ** above trees; level after level joined with itself."""
    text = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR) END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    whole = lambda *more: "sha256(" + " || ".join(text(f) for f in (*FIELDS[:-1], *more)) + ")"
    # CRC-32 of the decimal doc_id, bit by bit.
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {bits}), 4294967295)"
    out = f"""
WITH made AS (SELECT doc_id, lang, {whole("text")} AS h, CASE WHEN {crc} % 3 = 0 THEN {whole(lower)} END AS o FROM documents),
leaf AS MATERIALIZED (
  SELECT doc_id, h, coalesce(o, h) AS x, row_number() OVER () AS id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS t,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM made),
a0 AS (SELECT t, i, h, n FROM leaf),
f0 AS (SELECT id, t, i, x, '' AS p FROM leaf),"""

    def level(a: str, f: str, k: int) -> str:
        return f"""
s{a}{k} AS MATERIALIZED (
  SELECT v.t, v.i, v.n, coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (WHERE w.i < v.i), '') AS l, coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (WHERE w.i > v.i), '') AS r
  FROM {a}{k} v JOIN {a}{k} w ON v.t = w.t AND v.i // {FAN} = w.i // {FAN} GROUP BY v.t, v.i, v.n),
{f}{k + 1} AS MATERIALIZED (
  SELECT id, f.t, f.i // {FAN} AS i, CASE WHEN n > 1 THEN sha256(l || x || r) ELSE x END AS x, CASE WHEN n > 1 THEN p || l || r ELSE p END AS p
  FROM {f}{k} f JOIN s{a}{k} s ON f.t = s.t AND f.i = s.i),
{a}{k + 1} AS MATERIALIZED (
  SELECT t, i // {FAN} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + {FAN - 1}) // {FAN} AS n
  FROM {a}{k} GROUP BY t, i // {FAN}),"""

    out += "".join(level("a", "f", k) for k in range(below))
    out += f"""
b0 AS (SELECT CAST(0 AS BIGINT) AS t, t - 1 AS i, h, count(*) OVER () AS n FROM a{below}),
g0 AS (SELECT id, CAST(0 AS BIGINT) AS t, t - 1 AS i, x, p FROM f{below}),"""
    out += "".join(level("b", "g", k) for k in range(above))
    return out + f"""
root AS (SELECT h FROM b{above})
SELECT leaf.doc_id, leaf.h AS leaf, a{below}.h AS subroot, root.h AS root, sha256(g.p) AS proof_sha256, g.x AS folded_root, g.x = root.h AS verified
FROM leaf JOIN g{above} g ON leaf.id = g.id JOIN a{below} ON a{below}.t = leaf.t, root
"""
