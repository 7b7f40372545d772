"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Learning rates are per coordinate, and L1 sets most weights to exactly 0, so what is broadcast is a short list of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import shingles as S
from strandline.llm.batches import slim, trimmed
from strandline.llm.store import free

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.5
#: The documented bound of the training sample: expected labelled rows, drawn by a hash of doc_id, and passes over them.
TRAIN_ROWS, PASSES = 20_000, 4
THRESHOLD = 0.3
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEP = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def features(words: np.ndarray) -> np.ndarray:
    """Hashed features of a text, with repeats: words, neighbours, and pairs with one word skipped."""
    shift = np.uint64(64 - BITS)
    parts = [(words * _STEP[0]) >> shift]
    for gap in (1, 2):
        if len(words) > gap:
            parts.append((S.mix(words[:-gap] * _STEP[gap] + words[gap:]) * _STEP[0]) >> shift)
    return np.concatenate(parts).astype(np.int64)


class Ftrl:
    """One weight for each hashed feature and a bias without L1, which comes last."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)
        self.rows = 0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(self) -> float:
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA + L2))

    def learn(self, present: np.ndarray, label: int) -> None:
        w = self.weights(present)
        b = self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - label
        n = self.n[present]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[present] += g - sigma * w
        self.n[present] = n + g * g
        s = (np.sqrt(self.n[-1] + g * g) - np.sqrt(self.n[-1])) / ALPHA
        self.z[-1] += g - s * b
        self.n[-1] += g * g
        self.rows += 1


@trimmed
def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Ftrl()
    for batch in batches:
        labels = batch.column("toxic").to_pylist()
        for row, words in S.text_words(batch.column("text"), _SEPARATORS):
            model.learn(np.unique(features(words.code)) if len(words.code) else np.empty(0, np.int64), labels[row])
    if model.rows:
        w = model.weights(slice(0, 1 << BITS))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], model.bias()))], ["feature", "weight"])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text of what is learned from: one row for each of about TRAIN_ROWS ids, drawn by a hash, whose label is 0 or 1.

    However often an id is repeated it is one row; of its texts the one of the least hash counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = 1_000_000 if n <= TRAIN_ROWS else int(1_000_000 * TRAIN_ROWS / n)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share)
    rows = slim(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # at most about TRAIN_ROWS ids
    return rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(feature, weight) of a model of sample(); feature -1 is the bias.

    The sample goes to one task, PASSES times over: its input has the sample's bound, and it holds one batch of texts at a time, of
    whatever length.
    """
    again = F.explode(F.array(*map(F.lit, range(PASSES))))
    one = sample(docs, labels).select("toxic", "text", F.xxhash64("doc_id").alias("order"), again.alias("pass")).repartition(1).sortWithinPartitions("pass", "order")
    return one.select("toxic", "text").mapInArrow(_train, "feature bigint, weight double")


def score(docs: DataFrame, weights: list[tuple[int, float]], carry: list[str] | None = None) -> DataFrame:
    """The columns of docs in ``carry`` (all, if None) and score (with "_" in front where one of them has that name). weights: the few that training left, with the bias under -1. Without any, scores are 0."""
    spark = docs.sparkSession
    table = np.zeros(1 << BITS, np.float32)
    bias = None
    for f, w in weights:
        if f < 0:
            bias = w
        else:
            table[f] = w
    at = np.flatnonzero(table).astype(np.int32)
    sent = spark.sparkContext.broadcast((at, table[at], bias))  # as many weights as L1 leaves, at most 2 ** BITS

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = values
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = np.zeros(batch.num_rows)
            if bias is not None:
                for row, words in S.text_words(texts, _SEPARATORS):
                    f = features(words.code) if len(words.code) else np.empty(0, np.int64)
                    f = np.unique(f[w[f] != 0])
                    out[row] = 1 / (1 + np.exp(-np.clip(float(w[f].sum()) + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "score"])

    carry, kinds = docs.columns if carry is None else carry, dict(docs.dtypes)
    carried = slim(docs).select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], F.col("text").alias("_text"))
    schema = ", ".join([f"_{i} {kinds[c]}" for i, c in enumerate(carry)] + ["score double"])
    return carried.mapInArrow(run, schema).toDF(*carry, free(carry, "score"))


def learnable(doc_id: Column) -> Column:
    """The fold that labels are learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from its whole text.

    Null and empty texts get the score of a text without features. Rows with a null doc_id are scored, with held_out null.
    Repeated rows are repeated. Without a labelled row all scores are 0. Only doc_id and text of docs are used.
    """
    fold = docs.where(learnable(F.col("doc_id")))
    weights = [(r.feature, r.weight) for r in train(fold, labels.where(learnable(F.col("doc_id")))).collect()]
    scored = score(docs.select("doc_id", "text").withColumn("held_out", ~learnable(F.col("doc_id"))).select("doc_id", "held_out", "text"), weights, carry=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
