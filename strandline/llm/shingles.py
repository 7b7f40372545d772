"""Five-word shingles of whole texts as 64-bit hashes, for whole Arrow batches at once in numpy, and their comparison as text.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. All steps work on the UTF-8 bytes, which is the same:
none of the bytes concerned occurs inside a longer UTF-8 sequence. Hashes only find what may be equal; ``faithful`` tells whether
equal hashes of some words stand for equal text, and ``exact_shingles`` does without hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIXERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_SEED, _STEP = np.uint64(0x243F6A8885A308D3), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed in numpy, eight at a time; longer words are hashed by BLAKE2b.
_SHORT = 64
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_BLOCK = 1 << 20


class Words(NamedTuple):
    """Words of some bytes: the bytes with white space as spaces, and start, size and hash of each word."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    code: np.ndarray

    def part(self, low: int, high: int) -> Words:
        return Words(self.data, self.start[low:high], self.size[low:high], self.code[low:high])

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; data has eight bytes more than are asked for."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def words_of(raw: bytes, separators: np.ndarray = _SPACE) -> Words:
    """The words of some bytes, which end in a separator."""
    bytes_in = np.frombuffer(raw + bytes(8), np.uint8)
    apart = separators[bytes_in]
    apart[len(raw) :] = True
    data = _LOWER[bytes_in]
    data[apart] = 32
    edge = np.flatnonzero(np.diff((~apart).astype(np.int8), prepend=0, append=0))
    edge = edge.astype(np.int32 if len(data) < 1 << 31 else np.int64)
    start, size = edge[0::2].copy(), edge[1::2] - edge[0::2]
    code = _SEED ^ (size.astype(np.uint64) * _STEP)
    eights = _eights(data)
    some = np.arange(len(start))
    for at in range(0, _SHORT, 8):
        some = some[size[some] > at]
        if not len(some):
            break
        chunk = eights[start[some] + at] & _KEEP[np.minimum(size[some] - at, 8)]
        code[some] = mix((code[some] ^ chunk) * _STEP + np.uint64(at))
    for i in np.flatnonzero(size > _SHORT).tolist():
        digest = hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest()
        code[i] = int.from_bytes(digest, "little")
    return Words(data, start, size, code)


def text_words(texts: pa.Array, separators: np.ndarray = _SPACE) -> Iterator[tuple[int, Words]]:
    """(row, words) of every row; null and empty texts have none. Bytes are taken in blocks of bounded size."""
    rows, size = [], 0
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    for i, n in enumerate(lengths.tolist()):
        rows.append(i)
        size += n + 1
        if size >= _BLOCK:
            yield from _block(texts, rows, lengths, separators)
            rows, size = [], 0
    if rows:
        yield from _block(texts, rows, lengths, separators)


def _block(texts: pa.Array, rows: list[int], lengths: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, Words]]:
    part = texts.slice(rows[0], len(rows)).cast(pa.large_binary()).to_pylist()
    words = words_of(b"".join([(x or b"") + b" " for x in part]), separators)
    cut = np.searchsorted(words.start, np.cumsum(lengths[rows] + 1))
    before = 0
    for row, to in zip(rows, cut.tolist(), strict=True):
        yield row, words.part(before, to)
        before = to


def shingle_codes(words: Words) -> np.ndarray:
    """Hash of the shingle that begins at each word; a text of fewer words is one shingle, one without words none."""
    code = words.code
    n = len(code)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return mix((mix(code + _MIXERS[:n]) * _MIXERS[:n]).sum(keepdims=True) + np.uint64(n))
    h = np.full(n - WORDS + 1, np.uint64(WORDS))
    for i in range(WORDS):
        h = mix(h ^ (code[i : n - WORDS + 1 + i] * _MIXERS[i]))
    return h


def shingles(words: Words) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's words. Where a hash repeats, the texts are compared; if they differ, the set is made from texts."""
    codes = shingle_codes(words)
    found = np.unique(codes)
    if len(found) < len(codes) and not faithful([words]):
        return np.unique(np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in exact_shingles(words)], np.uint64))
    return found


def exact_shingles(words: Words) -> set[bytes]:
    """The distinct shingles as text."""
    texts = [words.text(i) for i in range(len(words.start))]
    if not texts:
        return set()
    return {b" ".join(texts[i : i + WORDS]) for i in range(max(1, len(texts) - WORDS + 1))}


def sequence(words: Words) -> bytes:
    """SHA-256 of the whole sequence of words: texts of one sequence have one set."""
    if not len(words.start):
        return b""
    data = words.data[words.start[0] : words.start[-1] + words.size[-1]]
    gap = data == 32
    return hashlib.sha256(data[~(gap & np.append(False, gap[:-1]))].tobytes()).digest()


def _differ(words: Words, i: np.ndarray, j: np.ndarray) -> bool:
    """Whether some word i is not its word j."""
    if (words.size[i] != words.size[j]).any():
        return True
    size, a, b = words.size[i], words.start[i], words.start[j]
    eights = _eights(words.data)
    for at in range(0, _SHORT, 8):
        some = np.flatnonzero(size > at)
        if not len(some):
            return False
        keep = _KEEP[np.minimum(size[some] - at, 8)]
        if ((eights[a[some] + at] ^ eights[b[some] + at]) & keep).any():
            return True
    return any(words.text(int(x)) != words.text(int(y)) for x, y in zip(i[size > _SHORT], j[size > _SHORT], strict=True))


def faithful(texts: list[Words]) -> bool:
    """Whether equal hashes mean equal text, for all words and shingles of some texts."""
    texts = [t for t in texts if len(t.start)]
    if not texts:
        return True
    if all(t.data is texts[0].data for t in texts):
        data, shift = texts[0].data, [0] * len(texts)
    else:
        # Texts of one block share its bytes, which are taken once.
        parts, at = {id(t.data): t.data for t in texts}, {}
        for key, part in parts.items():
            at[key] = sum(len(parts[k]) for k in at)
        data, shift = np.concatenate(list(parts.values())), [at[id(t.data)] for t in texts]
    whole = Words(data, np.concatenate([t.start + s for t, s in zip(texts, shift, strict=True)]), np.concatenate([t.size for t in texts]), np.concatenate([t.code for t in texts]))
    order = np.argsort(whole.code, kind="stable")
    same = np.flatnonzero(whole.code[order[1:]] == whole.code[order[:-1]])
    if len(same) and _differ(whole, order[same], order[same + 1]):
        return False
    # Words are told apart by their hashes now; so are shingles if equal hashes have equal words.
    sizes = np.array([len(t.code) for t in texts])
    number = np.maximum(sizes - WORDS + 1, 1)
    code = np.concatenate([shingle_codes(t) for t in texts])
    begin = (np.arange(len(code)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(number) + number, number)).astype(np.int32)
    count = np.repeat(np.minimum(sizes, WORDS), number).astype(np.int8)
    order = np.argsort(code, kind="stable")
    same = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    i, j = order[same], order[same + 1]
    if (count[i] != count[j]).any():
        return False
    for n in range(WORDS):
        some = count[i] > n
        if (whole.code[begin[i[some]] + n] != whole.code[begin[j[some]] + n]).any():
            return False
    return True
