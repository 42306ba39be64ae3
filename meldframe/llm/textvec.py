"""Whole batches of texts as numpy arrays: words, their 64-bit hashes, shingles. No Python loop per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 2**64))
_LANE = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for i, m in enumerate((_MUL, _INV)):
            p = np.full(size + 1, m, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with (S[e] - S[s]) * inverse**s a hash of buf[s:e]."""
    up, _ = powers(len(buf))
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _LANE[15])


def bytes_hash(data: bytes) -> int:
    """span_hash of one byte string."""
    b = np.frombuffer(data, np.uint8)
    return int(span_hash(prefix_sums(b), np.array([0]), np.array([len(b)]))[0])


#: Bytes that part words: space and \t to \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(9, 14)]] = True
#: Bytes that part words of letters: all ASCII but letters.
NOT_LETTERS = np.array([not (b >= 128 or chr(b).isalpha()) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a batch of texts. first[i]:first[i + 1] are the words of text i; at[i]:at[i + 1] its bytes in buf."""

    buf: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(texts: list[str | None], parts: np.ndarray = SPACES, lower: bool = True) -> Words:
    """Null texts are empty. lower: A to Z only; lower-case the texts before for more."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        buf = LOWER[buf]
    apart = np.ones(len(buf) + 1, bool)
    apart[1:] = parts[buf]
    start = np.flatnonzero(apart[:-1] & ~apart[1:])
    end = np.flatnonzero(~apart[:-1] & apart[1:])
    if not apart[-1]:
        end = np.append(end, len(buf))
    return Words(buf, at, start, end, span_hash(prefix_sums(buf), start, end), np.searchsorted(start, at))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its n-word shingles; with fewer words, of the whole sequence; without words, empty."""
    w = words(texts)
    count = np.diff(w.first)
    h = np.zeros(max(0, len(w.hash) - n + 1), np.uint64)
    for j in range(n):
        h += w.hash[j : len(w.hash) - n + 1 + j] * _LANE[j]
    h = mix(h)
    out = []
    for i, c in enumerate(count.tolist()):
        s = w.first[i]
        if c >= n:
            out.append(np.unique(h[s : s + c - n + 1]))
        elif c:
            out.append(mix((w.hash[s : s + c] * _LANE[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
