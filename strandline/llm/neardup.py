"""Near-duplicate documents by SetSketch bands, likelihood and verification on full shingle sets.

Stages: (1) sketch every text; (2) texts of one word sequence (by SHA-256) become one class; (3) bands of registers deal the
classes into buckets, and inside a bucket register comparison by joint likelihood joins those that may reach the threshold into
families; (4) each family's texts meet, in blocks, and exact intersections of full shingle sets give the links; the sets are
compared by hash only after the texts showed that equal hashes are equal shingles; (5) components of the links.
A pair at the threshold is missed only if no band agrees (chance under 1e-5, see band_rows) or its registers are five standard
deviations off; a family is a superset, so nothing is lost by joining too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import setsketch as K
from strandline.llm.batches import give_back, slim, sorted_runs, trimmed
from strandline.llm.graph import components, small_components
from strandline.llm.hot import spread_join
from strandline.llm.shingles import Words, exact_shingles, faithful, sequence, shingles, text_words
from strandline.llm.store import written

#: Least similarity of a link as a fraction, unless another one is asked for.
THRESHOLD = 85, 100
#: Bound of the chance that a pair at the threshold shares no band.
MISS = 1e-5
NATS = 12.5  # five standard deviations
#: Buckets up to this size are compared pair by pair; members of larger ones join one family, which verification takes apart.
BUCKET = 256
#: A block of a family has about so many documents and shingles at most.
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 512, 200_000
#: Documents of a group of texts after which a worker gives back what it has freed.
LARGE = 64
#: Bits of the filter that spares texts outside families a second transfer; fixed, so its size has a bound (1 MB).
FILTER_BITS = 1 << 23
#: Pairs whose likelihoods are in memory at once.
_PAIRS = 3000


@trimmed
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, whole, sketches = batch.column("doc_id"), [], [], []
        for _, words in text_words(batch.column("text")):
            s = shingles(words)
            sizes.append(len(s))
            whole.append(sequence(words))
            sketches.append(K.registers(s).tobytes())
        arrays = [ids, pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "words", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a digest of the word sequence, and the registers."""
    return slim(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_signatures, "doc_id bigint, n_shingles bigint, words binary, sketch binary")


def _pairs(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions inside each run."""
    a, b = [], []
    for size in np.unique(counts):
        if size < 2:
            continue
        i, j = np.triu_indices(size, 1)
        s = starts[counts == size][:, None]
        a.append((s + i).ravel())
        b.append((s + j).ravel())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def band_rows(threshold: float) -> int:
    """Registers of a band: as many as keep the chance that a pair at the threshold shares no band under MISS."""
    return max((r for r in range(1, K.ROWS + 1) if (1 - threshold**r) ** (K.REGISTERS // r) < MISS), default=1)


def _families(threshold: float):
    @trimmed
    def run_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per bucket, edges that join documents whose registers allow the threshold; at most one edge a row."""
        for t, run in sorted_runs(batches, ["bucket"]):
            ids, n = t.column("doc_id").to_numpy(), t.column("n_shingles").to_numpy()
            counts = np.bincount(run)
            a, b = _pairs(counts, np.cumsum(counts) - counts)
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(len(ids), K.REGISTERS)
            keep = np.zeros(len(a), bool)
            for i in range(0, len(a), _PAIRS):
                x, y = a[i : i + _PAIRS], b[i : i + _PAIRS]
                keep[i : i + _PAIRS] = K.plausible(sketch[x], sketch[y], n[x], n[y], threshold, NATS)
            root = small_components(len(ids), a[keep], b[keep])
            rows = np.flatnonzero(root != np.arange(len(ids)))
            u, v = ids[rows], ids[root[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return run_families


def families(classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate edges (u, v) between classes that share a band of registers.

    Buckets of up to BUCKET classes are compared pair by pair. All members of a larger one are joined to its first, by a join
    that splits it into many tasks; verification takes such families apart.
    """
    rows = band_rows(threshold)
    width, bands = rows * 2, K.REGISTERS // rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(bands)])
    keyed = classes.select("doc_id", F.explode(keys).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("c"), F.min("doc_id").alias("first")).where("c > 1")
    met = spread_join(keyed, shared, ["bucket"], "c", classes.count() * bands)
    large = met.where(F.col("c") > BUCKET).select(F.col("doc_id").alias("u"), F.col("first").alias("v")).where("u <> v")
    small = met.where(F.col("c") <= BUCKET).select("bucket", "doc_id").join(classes.select("doc_id", "n_shingles", "sketch"), "doc_id")
    dealt = small.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    return large.unionByName(dealt.mapInArrow(_families(threshold), "u bigint, v bigint"))


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with the hash of each id set; only this fixed-size map reaches the driver."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1  # these functions number bits from 1
    rows = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _meets(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of a with sets of b. Only values in both sides count, some columns at a time."""
    same = a is b
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    values, code, number = np.unique(va if same else np.concatenate([va, vb]), return_inverse=True, return_counts=True)
    ca, cb = (code, code) if same else (code[: len(va)], code[len(va) :])
    if same:
        useful = number > 1
    else:
        useful = (np.bincount(ca, minlength=len(values)) > 0) & (np.bincount(cb, minlength=len(values)) > 0)
    column = np.cumsum(useful) - 1
    keep_a, keep_b = useful[ca], useful[cb]
    ca, ra, cb, rb = column[ca[keep_a]], ra[keep_a], column[cb[keep_b]], rb[keep_b]
    out = np.zeros((len(a), len(b)), np.float32)
    step = max(64, min(4096, 4_000_000 // max(len(a), len(b))))
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    for low in range(0, int(useful.sum()), step):
        i, j = np.searchsorted(ca, [low, low + step])
        x = np.zeros((len(a), step), np.float32)
        x[ra[i:j], ca[i:j] - low] = 1
        y = x
        if not same:
            i, j = np.searchsorted(cb, [low, low + step])
            y = np.zeros((len(b), step), np.float32)
            y[rb[i:j], cb[i:j] - low] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _common(first: list[Words], second: list[Words] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of all intersections of the sets of first with those of second (or of first), and the sizes of both sides' sets."""
    if faithful(first + (second or [])):
        a = [shingles(w) for w in first]
        b = a if second is None else [shingles(w) for w in second]
        return _meets(a, b), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    # Some hash stands for two texts: this block is done by the texts alone.
    c = [exact_shingles(w) for w in first]
    d = c if second is None else [exact_shingles(w) for w in second]
    return np.array([[len(x & y) for y in d] for x in c]).reshape(len(c), len(d)), np.array([len(x) for x in c]), np.array([len(x) for x in d])


def _links(numerator: int, denominator: int):
    @trimmed
    def run_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact links inside each (family, low block, high block); a spanning forest of them is passed on."""
        for t, run in sorted_runs(batches, ["family", "low", "high"]):
            ids, block, low = t.column("doc_id").to_numpy(), t.column("block").to_numpy(), t.column("low").to_numpy()
            texts = t.column("text")
            starts = np.flatnonzero(np.diff(run, prepend=-1))
            us, vs = [], []
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                if e - s < 2:
                    continue
                part = texts.slice(s, e - s).combine_chunks()
                words = [w for _, w in text_words(part)]
                split = block[s:e] == low[s]
                ra, rb = np.flatnonzero(split), np.flatnonzero(~split)
                if not len(ra):
                    continue
                common, na, nb = _common([words[i] for i in ra], [words[i] for i in rb] if len(rb) else None)
                union = na[:, None] + nb[None, :] - common
                x, y = np.nonzero((common > 0) & (denominator * common >= numerator * union))
                x, y = ra[x], (rb if len(rb) else ra)[y]
                root = small_components(e - s, x[x != y], y[x != y])
                some = np.flatnonzero(root != np.arange(e - s))
                us.append(ids[s:e][some])
                vs.append(ids[s:e][root[some]])
                if e - s >= LARGE:
                    del words, common, union
                    give_back()
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run_links


def verified_links(docs: DataFrame, members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Exact links (a spanning forest of each block pair) inside families; members: doc_id, family, n_shingles."""
    sizes = members.groupBy("family").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_DOCUMENTS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    # Families of several blocks are few, and Spark broadcasts their list while it is small; their members are split in any case.
    split = written(sizes.select("family", blocks.alias("blocks")).where("blocks > 1"), "split")
    placed = members.join(split, "family", "left").select("doc_id", "family", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter(members))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bits.value
        for batch in batches:
            k = batch.column("bit").to_numpy()
            yield batch.filter(pa.array((bitmap[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1)).select(["doc_id", "text"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(FILTER_BITS)).alias("bit"))
    some = texts.mapInArrow(wanted, "doc_id bigint, text string")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = placed.withColumn("other", other).select("doc_id", "family", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    met = cells.join(some, "doc_id")
    return met.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "doc_id").mapInArrow(_links(*threshold), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Texts of at least the threshold's similarity are linked.

    docs needs an integer doc_id and text; other columns are left alone. Repeated rows are repeated. Null, empty and all-blank texts have no
    shingles and stay alone. A null doc_id names no document: its row is linked with nothing and has component_id and kept null.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    signed = written(signatures(docs), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("words").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count("*").alias("c")), "classes")
    family = components(families(classes, threshold[0] / threshold[1])).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    members = written(family.join(classes.select("doc_id", "n_shingles"), "doc_id"), "members")
    linked = components(verified_links(named, members, threshold)).select(F.col("node").alias("class_id"), F.col("component").alias("joined"))
    found = classes.select("words", "c", F.col("doc_id").alias("class_id")).join(linked, "class_id", "left")
    found = found.select("words", "c", F.coalesce("joined", "class_id").alias("component_id"))
    out = spread_join(some.select("doc_id", "n_shingles", "words"), found, ["words"], "c", signed.count())
    alone = signed.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", "n_shingles", "component_id"]
    return out.select(*names).unionByName(alone.select(*names)).withColumn("kept", F.col("doc_id") == F.col("component_id"))


#: near_duplicates over documents as SQL: exact joins of whole shingles, for tables that are small enough for it.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) a),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n AS x ON c.a = x.doc_id JOIN n AS y ON c.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, low) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.low) AS component_id, w.doc_id = min(r.low) AS kept
FROM w JOIN r ON w.doc_id = r.doc_id LEFT JOIN n ON w.doc_id = n.doc_id GROUP BY w.doc_id
"""
