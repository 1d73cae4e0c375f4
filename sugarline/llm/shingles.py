"""Sets of hashed word shingles, computed for many texts at once."""

from __future__ import annotations

import numpy as np

from sugarline.llm.common import blocks

SHINGLE = 5
_SEED = np.random.default_rng(20240101)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> None:
    """Powers of the base, modulo 2^64, and their inverses, at least ``n`` of them."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def word_hashes(data: bytes, piece: int = 1 << 20) -> np.ndarray:
    """Hash of each word of ``data``, whose words all end in one blank, ``piece`` bytes at a time."""
    out = []
    at = 0
    while at < len(data):
        end = data.rfind(b" ", at, at + piece) + 1 or data.index(b" ", at) + 1
        codes = np.frombuffer(data, np.uint8, end - at, at)
        _tables(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_BYTE[codes] * _powers[: len(codes)], out=sums[1:])
        ends = np.flatnonzero(codes == 32)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
        out.append(mixed((sums[ends] - sums[starts]) * _inverse[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def canonical(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, each followed by one blank."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return b" ".join(words) + b" " if words else b""


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """For each canonical text the ascending hashes of its distinct shingles.

    Fewer than ``size`` words make one shingle; no words make none.
    """
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        joined = b"".join(texts[a:b])
        hashes = word_hashes(joined)
        at = 0
        for text in texts[a:b]:
            n = text.count(b" ")
            w = hashes[at : at + n]
            at += n
            h = w[: max(n - size + 1, min(n, 1))].copy()
            for k in range(1, min(size, n)):
                h = mixed(h * np.uint64(31) + w[k : len(h) + k])
            out.append(np.unique(h))
    return out
