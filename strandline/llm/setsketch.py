"""SetSketch registers: exponentially spaced, truncated minima of hashed shingles.

Register i of a set is ``clip(1 + floor(-log_b(m_i)), 0, 65535)`` with m_i the least of the set's i-th exponential hash
values. Sketches of two sets merge by the larger register. P(register of U > register of V) is ``p(u - v J)`` with
``p(x) = -log_b(1 - x (b - 1) / b)`` and u, v the shares of both sizes, so the counts of larger, smaller and equal registers
give a joint likelihood for J.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 64
BASE = 1.001
ROWS = 4
BANDS = REGISTERS // ROWS
_rng = np.random.default_rng(20240613)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_ODD = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_LOG = np.log(BASE)
_COLUMNS = 2048


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 registers of a set of 64-bit hashes; all 0 for the empty set.

    The exponential value falls as its uniform hash rises, so only the largest uniform value of each register is needed.
    """
    if len(hashes) == 0:
        return np.zeros(REGISTERS, np.uint16)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), _COLUMNS):
        np.minimum(out, ((low[None, i : i + _COLUMNS] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=out)
    uniform = (out.astype(np.float64) + 0.5) / 2.0**32
    least = -np.log1p(-uniform)
    return np.clip(1 + np.floor(-np.log(least) / _LOG + 20000), 0, 65535).astype(np.uint16)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / _LOG


_GRID = np.linspace(0.0, 1.0, 101)


def log_likelihood(larger: np.ndarray, smaller: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Rows x 101: log likelihood of J = 0.00 to 1.00 from register comparisons and the two set sizes."""
    u = (n_u / (n_u + n_v))[:, None]
    v = 1 - u
    tiny = 1e-12
    above, below = _p(np.clip(u - v * _GRID, 0, 1)), _p(np.clip(v - u * _GRID, 0, 1))
    same = np.clip(1 - above - below, tiny, 1)
    equal = (REGISTERS - larger - smaller)[:, None]
    return larger[:, None] * np.log(np.clip(above, tiny, 1)) + smaller[:, None] * np.log(np.clip(below, tiny, 1)) + equal * np.log(same)


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, nats: float) -> np.ndarray:
    """False where every J at or above the threshold is worse than the best J by more than ``nats``."""
    fits = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    out = np.zeros(len(fits), bool)
    rows = np.flatnonzero(fits)
    if len(rows):
        x, y = a[rows], b[rows]
        ll = log_likelihood((x > y).sum(1).astype(float), (x < y).sum(1).astype(float), n_a[rows].astype(float), n_b[rows].astype(float))
        out[rows] = ll[:, _GRID >= threshold - 0.005].max(1) >= ll.max(1) - nats
    return out
