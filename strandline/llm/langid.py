"""Language of a text by a byte convolutional network: filters of several widths, max pooling, softmax.

The network is trained here in numpy on labelled texts and applied to fixed-length windows that together cover each whole text.
A text's probabilities are the mean of its windows', weighted by their bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.batches import slim, trimmed
from strandline.llm.store import free, written

WINDOW = 256
WIDTHS, FILTERS, DIMENSION = (2, 3, 4), 16, 8
_WIDEST = max(WIDTHS)
#: The documented bounds of the training sample: expected labelled texts in all, drawn by a hash of the text in equal numbers for each
#: language, the least number of a language where there are many, and windows of each text.
TRAIN_ROWS, LEAST_ROWS, TRAIN_WINDOWS = 4000, 200, 3
EPOCHS, BATCH, RATE = 6, 128, 0.004
#: Steps of training at least, so that a few texts are gone through more often, and the share of windows in upper case.
STEPS, UPPER = 800, 0.15
#: Windows that go through the network at once.
_AT_ONCE = 128
#: Rows of an Arrow batch whose texts are Python strings at once.
_ROWS = 512
UNKNOWN = "und"


class Network:
    """Byte embedding (256 is padding), one weight matrix for all filters, and a softmax layer."""

    def __init__(self, languages: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        n = FILTERS * len(WIDTHS)
        mask = np.zeros((_WIDEST, DIMENSION, n), np.float32)
        for i, width in enumerate(WIDTHS):
            mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = mask.reshape(_WIDEST * DIMENSION, n)
        self.p = {
            "embed": rng.normal(0, 0.5, (257, DIMENSION)).astype(np.float32),
            "conv": (rng.normal(0, 0.25, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.2, (n, len(languages))).astype(np.float32),
            "last": np.zeros(len(languages), np.float32),
        }

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled activations, where each maximum stands, and the unfolded input."""
        n, positions = len(windows), windows.shape[1] - _WIDEST + 1
        e = self.p["embed"].take(windows, axis=0).reshape(n, -1)
        step = e.strides[1]
        unfolded = np.lib.stride_tricks.as_strided(e, (n, positions, _WIDEST * DIMENSION), (e.strides[0], DIMENSION * step, step))
        unfolded = np.ascontiguousarray(unfolded).reshape(n * positions, -1)
        a = (unfolded @ self.p["conv"]).reshape(n, positions, -1)
        return a, unfolded

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        a, _ = self.hidden(windows)
        while a.shape[1] > 1:  # halves at a time: several times faster than one reduction over the middle axis
            half = (a.shape[1] + 1) // 2
            a = np.maximum(a[:, :half], a[:, -half:])
        h = np.maximum(a[:, 0] + self.p["bias"], 0)
        return softmax(h @ self.p["out"] + self.p["last"])

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        n = len(windows)
        a, unfolded = self.hidden(windows)
        positions = a.shape[1]
        at = a.argmax(axis=1)
        top = np.take_along_axis(a, at[:, None, :], 1)[:, 0] + self.p["bias"]
        h = np.maximum(top, 0)
        g = softmax(h @ self.p["out"] + self.p["last"])
        g[np.arange(n), labels] -= 1
        g /= n
        gh = (g @ self.p["out"].T) * (top > 0)
        rows = (np.arange(n)[:, None] * positions + at).ravel()
        taken = unfolded[rows].reshape(n, -1, _WIDEST * DIMENSION)
        conv = np.einsum("nf,nfk->kf", gh, taken) * self.mask
        back = (gh[:, :, None] * self.p["conv"].T[None]).reshape(-1, _WIDEST, DIMENSION)
        places = (at[:, :, None] + np.arange(_WIDEST)).reshape(-1, _WIDEST)
        ids = windows[np.repeat(np.arange(n), a.shape[2])[:, None], places]
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, ids.ravel(), back.reshape(-1, DIMENSION))
        return {"embed": embed, "conv": conv, "bias": gh.sum(0), "out": h.T @ g, "last": g.sum(0)}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def padded(parts: list[bytes]) -> np.ndarray:
    out = np.full((len(parts), WINDOW + _WIDEST - 1), 256, np.int16)
    for i, x in enumerate(parts):
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out


def fit(parts: list[bytes], labels: np.ndarray, languages: list[str], seed: int = 5) -> Network:
    """Trains by Adam; in every epoch some windows are cut short or put in upper case, so that such texts are known as well."""
    net = Network(languages, seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(parts)))
    for epoch in range(epochs):
        order = rng.permutation(len(parts))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            cut = np.where(rng.random(len(some)) < 0.5, WINDOW, rng.integers(12, WINDOW, len(some)))
            start = [int(rng.integers(0, max(1, len(parts[k]) - c + 1))) for k, c in zip(some, cut, strict=True)]
            seen = [parts[k][s : s + c] for k, s, c in zip(some, start, cut, strict=True)]
            seen = [x.decode("utf-8", "ignore").upper().encode()[:WINDOW] if u else x for x, u in zip(seen, rng.random(len(seen)) < UPPER, strict=True)]
            g = net.gradients(padded(seen), labels[some])
            t += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def learnable(doc_id: Column) -> Column:
    """The fold that languages are learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def sample(docs: DataFrame) -> DataFrame:
    """lang, o (a hash) and text of about TRAIN_ROWS different texts, drawn by their hash, in equal numbers for each lang.

    Every language has the same share however rare it is and however often its texts or ids are repeated; one of fewer texts is
    taken whole, and none has more than twice its share.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text", F.lit(13)).alias("o"))
    counts = written(known.select("lang", "o").distinct().groupBy("lang").agg(F.count("*").alias("n")), "lang-counts")
    each = max(LEAST_ROWS, TRAIN_ROWS // max(1, counts.count()))
    rates = counts.select(F.col("lang").alias("l"), F.least(F.lit(1_000_000), F.ceil(F.lit(1_000_000.0) * each / F.col("n"))).alias("rate"))
    drawn = known.join(rates, F.col("lang") == F.col("l")).where(F.pmod("o", F.lit(1_000_000)) < F.col("rate"))
    # Equal texts are one. The hash bounds the number of texts as expected, the rank for certain.
    once = drawn.groupBy("lang", "o").agg(F.min("text").alias("text"))
    return once.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("o"))).where(F.col("r") <= 2 * each).drop("r")


def train(docs: DataFrame) -> Network | None:
    """Network of sample(), or None without a row that has a lang. Of each text up to TRAIN_WINDOWS evenly spread windows are taken; only these few reach the driver."""
    raw = F.col("text").cast("binary")
    gap = F.greatest(F.floor(F.octet_length("text") / TRAIN_WINDOWS), F.lit(WINDOW)).cast("int")
    cuts = F.array(*[F.substring(raw, gap * i + 1, F.lit(WINDOW)) for i in range(TRAIN_WINDOWS)])
    rows = sample(docs).select("lang", "o", F.posexplode(cuts).alias("i", "part")).where(F.octet_length("part") > 0).collect()
    rows = sorted(rows, key=lambda r: (r["o"], r["i"]))
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    code = {x: i for i, x in enumerate(languages)}
    return fit([bytes(r["part"]) for r in rows], np.array([code[r["lang"]] for r in rows]), languages)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its probability of each whole text; und with score 0 for null and for texts without a letter."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net is None:
        return names, scores
    totals = np.zeros((len(texts), len(net.languages)))
    row, block = [], []

    def run() -> None:
        p = net.probabilities(padded(block))
        np.add.at(totals, row, p * np.array([len(x) for x in block])[:, None])
        row.clear()
        block.clear()

    for i, text in enumerate(texts):
        if text is None or not _has_letter(text):
            continue
        raw = text.encode()
        for s in range(0, len(raw), WINDOW):
            row.append(i)
            block.append(raw[s : s + WINDOW])
            if len(block) == _AT_ONCE:
                run()
    if block:
        run()
    sums = totals.sum(axis=1)
    for i in np.flatnonzero(sums > 0):
        k = int(totals[i].argmax())
        names[i], scores[i] = net.languages[k], min(1.0, totals[i, k] / sums[i])
    return names, scores


def label(docs: DataFrame, net: Network | None, carry: list[str] | None = None) -> DataFrame:
    """The columns of docs in ``carry`` (all, if None), lang_pred and score (with "_" in front where one of them has that name). The network (some 10 KB) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in (whole.slice(i, _ROWS) for whole in batches for i in range(0, whole.num_rows, _ROWS)):
            names, scores = predict(own, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names[:-1], "lang_pred", "score"])

    carry, kinds = docs.columns if carry is None else carry, dict(docs.dtypes)
    carried = slim(docs).select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], F.col("text").alias("_text"))
    schema = ", ".join([f"_{i} {kinds[c]}" for i, c in enumerate(carry)] + ["lang_pred string", "score double"])
    return carried.mapInArrow(run, schema).toDF(*carry, free(carry, "lang_pred"), free(carry, "score"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, from its whole text.

    Null texts and texts without a letter are und with score 0; so is everything if no row has a lang to learn from.
    Repeated rows are repeated; a null doc_id has held_out null and is not learned from. Only doc_id, text and, to learn, lang are used.
    """
    net = train(docs.where(learnable(F.col("doc_id"))).select("doc_id", "text", "lang"))
    ready = docs.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "text")
    return label(ready, net, carry=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
