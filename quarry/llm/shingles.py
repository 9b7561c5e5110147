"""Word shingles of whole texts as sets of 64-bit hashes, MinHash bands and odd sketches, in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A word's hash
is a polynomial of its (mixed) bytes modulo 2**64, taken from running sums over the whole text, and
then mixed; a shingle's hash mixes its words' hashes in order. Everything is vectorised over a text.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_gap = np.zeros(256, bool)
_gap[[9, 10, 11, 12, 13, 32]] = True
#: The value of each byte, lower-cased; 0 for white space.
_value = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_lower]
_value[_gap] = 0
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: MinHash: BANDS bands of ROWS samples; at a similarity of 0.8 a pair shares no band once in about 65,000.
BANDS, ROWS = 28, 5
MINIMA = BANDS * ROWS
_A = _rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_band_mul = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: An odd sketch folds the SAMPLE smallest hashes of a set (a bottom-k MinHash sample, the whole set if it is no larger)
#: into a bitmap of SKETCH_BITS, of which the table has one column for each 64-bit word.
SAMPLE = 1024
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _gap[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_value[raw] * up[: len(raw)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than width make one shingle, none make none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(width, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * _BASE + words[i : len(words) - n + 1 + i])
    return np.unique(h)


def sequence_hash(words: np.ndarray) -> tuple[int, int]:
    """128 bits that identify the word sequence, as two signed 64-bit integers."""
    up, _ = _power(len(words) + 1)
    with np.errstate(over="ignore"):
        a = mix(np.array([(words * up[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))]))[0]
        b = mix(np.array([(mix(words ^ _M1) * up[1 : len(words) + 1]).sum(dtype=np.uint64) ^ _M2]))[0]
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """MINIMA minima of the set under as many hash functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):  # parts that stay in the processor's cache
        out = np.minimum(out, (_A[:, None] * x[None, i : i + 2048] + _B[:, None]).min(axis=1))
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band, different bands apart."""
    rows = sample.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((mix(rows + np.uint64(1)) * _band_mul).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _BASE).astype(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of how many sampled hashes fall on each bit; SKETCH_WORDS signed 64-bit integers. shingles: sorted, as shingle_set gives them."""
    at = mix(shingles[:SAMPLE] ^ _M2) >> np.uint64(64 - (SKETCH_BITS.bit_length() - 1))
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)
