"""Word shingles and MinHash values of a batch of texts, with NumPy inside a task.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z.  A word's
64-bit hash is a polynomial over its UTF-8 bytes, read off running sums, so a
whole batch is hashed without a loop over words; the sums restart at every
document, so a text hashes alike wherever it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multiplier of the polynomial (any fixed odd number with mixed bits does).
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``P**i`` and ``P**-i`` modulo 2**64 for ``i < n``, grown by doubling."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        for name, base in (("up", _P), ("down", _P_INV)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, given as its bytes."""
    if not len(raw):
        return np.empty(0, np.uint64)
    low = _LOWER[raw]
    inside = ~_BLANK[low]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(raw: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; the whole sequence when it is shorter than one."""
    h = word_hashes(raw)
    if not len(h):
        return h
    size = min(words, len(h))
    out = h[:len(h) - size + 1].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(_P) + h[k:len(h) - size + 1 + k])
    return np.unique(out + np.uint64(size))


def batch_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The shingle set of each text of an Arrow string column; empty for null."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    none = np.empty(0, np.uint64)
    return [shingle_set(data[a:b], words) if ok else none
            for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), strict=True)]


def min_hashes(sets: list[np.ndarray], k: int, seed: int) -> np.ndarray:
    """``(len(sets), k)`` minima of k permutations, finalised to even 32-bit values; zeros for empty sets.

    Sets are taken in chunks that fit a core's cache.
    """
    draw = np.random.default_rng(seed)
    flip = draw.integers(0, 1 << 32, k, dtype=np.uint32)
    times = draw.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
    out = np.zeros((len(sets), k), np.uint32)
    places = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(places):
        chunk, total = [], 0
        while at < len(places) and (not chunk or total + len(sets[places[at]]) <= 1 << 15):
            chunk.append(places[at])
            total += len(sets[places[at]])
            at += 1
        h = np.concatenate([sets[i] for i in chunk])
        h = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
        first = np.cumsum([0, *(len(sets[i]) for i in chunk[:-1])])
        work = np.empty_like(h)
        for j in range(k):
            np.multiply(np.bitwise_xor(h, flip[j], out=work), times[j], out=work)
            out[chunk, j] = np.minimum.reduceat(work, first)
    return (mix(out.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) >> np.uint64(32)
            ).astype(np.uint32)


def set_identity(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set (its size is kept beside it)."""
    if not len(values):
        return 0, 0
    a, b = mix(values ^ np.uint64(0x2545F4914F6CDD1D)), mix(values + np.uint64(0x9FB21C651E98DF25))
    return int(np.bitwise_xor.reduce(a).view(np.int64)), int(np.add.reduce(b).view(np.int64))
