"""SentencePiece encoding and decoding as a shortest path in a weighted transducer.

The model file is compiled into: a normaliser (space to the word mark, one mark in front), a trie of pieces whose final nodes
put out a piece, and byte fallback arcs for characters that are no piece. Composed with an input, a state is (position, last
piece). In the tropical semiring the arc of piece b after piece a weighs

* unigram models: minus the score of b;
* BPE models: 0 if merging the characters of a and b by the model's ranks ends in exactly a and b, else infinity. The merge
  result of a text is its one segmentation without an infinite arc, so the shortest path is the merge result.

Where no piece has a word mark after another character, a text is cut into words and the paths of words are remembered.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import slim, trimmed
from strandline.llm.store import free

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]+|{MARK}+")
# Piece kinds and model kinds of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words that a worker remembers between batches; beyond that it starts anew.
REMEMBERED = 150_000
#: Rows whose words are looked up together.
AT_ONCE = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """The compiled transducer. Built once on the driver and sent to the workers."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.prefix, extra, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                self.prefix, extra, charsmap = bool(f.get(3, 1)), bool(f.get(4, 1)), f.get(2, b"")
        if self.kind not in (UNIGRAM, BPE) or charsmap or extra or USER in self.kinds:
            raise ValueError("only unigram and BPE models with identity normalisation, kept white space and no user-defined pieces are compiled")
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        if len(self.byte) not in (0, 256):
            raise ValueError("byte fallback needs a piece for each byte")
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        if self.kind == BPE:
            order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
            self.rank = {p: order[self.scores[i]] for p, i in self.ids.items()}
            self._spines()
        #: Pieces from their last character to their first: states are left behind a position at a time, so arcs are read backwards.
        self.trie: dict = {}
        for p, i in self.ids.items():
            if self.kind == UNIGRAM or i in self.left:
                node = self.trie
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = i
        #: Words can be taken one by one: no piece has a mark after another character, and no run of unknown ones goes over a mark.
        self.by_word = self.prefix and not any(MARK in p.lstrip(MARK) for p in self.ids) and bool(self.byte or MARK in self.ids)

    def _spines(self) -> None:
        """For each piece that merging can make: the parts at its right and left end and the rank at which each goes up."""
        self.right: dict[int, list[tuple[str, int]]] = {}
        self.left: dict[int, list[tuple[str, int]]] = {}
        rank = self.rank
        never = len(rank) + 1
        for piece, i in self.ids.items():
            parts = list(piece)
            right, left = [], []
            while len(parts) > 1:
                best, at = min(((rank.get(parts[k] + parts[k + 1], never), k) for k in range(len(parts) - 1)))
                if best == never:
                    break
                if at == 0:
                    left.append((parts[0], best))
                if at == len(parts) - 2:
                    right.append((parts[-1], best))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 1:
                self.right[i], self.left[i] = [*right, (piece, never)], [*left, (piece, never)]

    def agrees(self, a: int, b: int) -> bool:
        """No merge crosses the place between pieces a and b before both are whole. Of equal ranks the leftmost goes first."""
        right, left, rank = self.right[a], self.left[b], self.rank
        i = j = 0
        while True:
            r, up_r = right[i]
            part, up_l = left[j]
            cross = rank.get(r + part)
            if cross is not None and cross < up_r and cross <= up_l:
                return False
            if i == len(right) - 1 and j == len(left) - 1:
                return True
            if up_r <= up_l:
                i += 1
            else:
                j += 1

    def fallback(self, c: str) -> list[int]:
        return [self.byte[x] for x in c.encode()] if self.byte else [self.unknown]


class Encoder:
    """Paths through the composed transducer. The paths of words are remembered, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        table = [b""] * len(model.pieces)
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            table[i] = p.replace(MARK, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else b""
        table[model.unknown] = " ⁇ ".encode()
        self.table = table
        self.least = min(model.scores[i] for i in model.ids.values()) if model.ids else 0.0

    def _follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= 2 * REMEMBERED:
                self.pairs.clear()
            ok = self.pairs[key] = self.model.agrees(a, b)
        return ok

    def paths(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, piece ids) of some normalised words. They are taken in sorted order: what was found for the beginning that a
        word shares with the one before it holds for it too, since a state depends only on what stands before its position."""
        bpe, ids, follows, top = self.model.kind == BPE, self.model.ids, self._follows, self.model.trie
        scores, least, unknown = self.model.scores, self.least, self.model.unknown
        before, last, came, cost = "", [-1], [0], [0.0]
        for word in sorted(words):
            n = len(word)
            same = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], came[same + 1 :], cost[same + 1 :]
            for e in range(same + 1, n + 1):
                node, s, piece, start, best = top, e, -2, e - 1, math.inf
                while s:
                    s -= 1
                    node = node.get(word[s])
                    if node is None:
                        break
                    b = node.get("")
                    if b is None:
                        continue
                    if bpe:  # one piece at most ends here on a finite path
                        a = last[s]
                        if a < 0 or follows(a, b):
                            piece, start = b, s
                            break
                    elif cost[s] - scores[b] < best:
                        piece, start, best = b, s, cost[s] - scores[b]
                if not bpe:
                    if word[e - 1] not in ids and cost[e - 1] - least + 10 < best:
                        piece, start, best = -2, e - 1, cost[e - 1] - least + 10
                    cost.append(best)
                last.append(piece)
                came.append(start)
            out: list[int] = []
            e = n
            while e:
                if last[e] >= 0:
                    out.append(last[e])
                else:
                    out += self.model.fallback(word[e - 1])[::-1]
                e = came[e]
            out.reverse()
            if not self.model.byte:  # without byte fallback a run of unknown characters is one piece
                out = [x for i, x in enumerate(out) if x != unknown or not i or out[i - 1] != unknown]
            before = word
            yield word, array("i", out).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Piece ids of each text as int32 bytes; none for null and empty texts."""
        model = self.model
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif model.by_word and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
                cut.append(text.split(" "))
            else:  # words that begin with other than one mark are kept with all their marks but the first
                marked = (MARK if model.prefix else "") + text.replace(" ", MARK)
                cut.append([w[1:] for w in _WORDS.findall(marked)] if model.by_word else [marked])
        have = set().union(*cut)
        new = have.difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:  # the words of this batch stay
            self.words = {w: self.words[w] for w in have.intersection(self.words)}
        lead = MARK if model.by_word else ""
        for word, ids in self.paths(lead + w for w in new):
            self.words[word[len(lead) :]] = ids
        return [b"".join(map(self.words.__getitem__, c)) for c in cut]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of piece ids; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
        table = self.table
        raw = b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        return (raw[1:] if self.model.prefix and raw.startswith(b" ") else raw).decode("utf-8", "replace")


def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: Model, check: bool = False, carry: list[str] | None = None) -> DataFrame:
    """The columns of docs in ``carry`` (all, if None), n_tokens and ids, from the whole text. A column of docs that has one of these names keeps it, and the new one gets "_" in front.

    Null texts have null ids and n_tokens null; empty texts none and 0. A word mark U+2581 in a text counts as a space.
    With check, column decodes tells whether decoding the ids gives the text back (null for null).
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # the model has a fixed size of a few MB

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(pickle.loads(sent.value))
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                coded = own.encode(texts)
                sizes = np.array([len(c) // 4 for c in coded], np.int32)
                gone = np.array([t is None for t in texts])
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(gone, False))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), np.int32)))
                new = [pa.array(sizes.astype(np.int64), mask=gone), ids]
                if check:
                    same = [None if t is None else own.decode(np.frombuffer(c, np.int32)) == t for t, c in zip(texts, coded, strict=True)]
                    new.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names)

    carry = docs.columns if carry is None else carry
    kinds = dict(docs.dtypes)
    carried = slim(docs).select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], F.col("text").alias("_text"))
    added = ["n_tokens", "ids"] + ["decodes"] * check
    names = [f"_{i}" for i in range(len(carry))] + added
    new = ["n_tokens bigint", "ids array<int>", "decodes boolean"][: len(added)]
    schema = ", ".join([f"_{i} {kinds[c]}" for i, c in enumerate(carry)] + new)
    return carried.mapInArrow(run, schema).toDF(*carry, *[free(carry, a) for a in added])


def decode(coded: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """All columns of coded and text_decoded. Null ids give null."""
    sent = coded.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(pickle.loads(sent.value))
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    names = [f"_{i}" for i in range(len(coded.columns))] + ["text_decoded"]
    carried = coded.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(coded.columns)], F.col(ids).alias("_ids"))
    schema = ", ".join([f"_{i} {t}" for i, (_, t) in enumerate(coded.dtypes)] + ["text_decoded string"])
    return carried.mapInArrow(run, schema).toDF(*coded.columns, free(coded.columns, "text_decoded"))
