"""Vectorised words of UTF-8 texts: positions and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import functools

import numpy as np

#: White space of the operators' words: space and U+0009 to U+000D; ``bytes.split`` has the same set.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for an ordered pair of names."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(0x2545F4914F6CDD1D)))


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    for out, base in ((up, _BASE), (down, _INVERSE)):
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return up, down


def _ranges(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, down: np.ndarray) -> np.ndarray:
    return (prefix[ends] - prefix[starts]) * down[starts]


def _prefix(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, index of its text), in order."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(solid, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(max(16, int(len(buf)).bit_length()))
    names = _ranges(_prefix(_BYTE[buf], up), starts, ends, down)
    # the length keeps apart what a polynomial alone could confuse
    names = mix(names + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return names, np.searchsorted(offsets, starts, side="right") - 1


def windows(names: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` consecutive names from each start on."""
    up, down = _powers(max(16, int(len(names) + 1).bit_length()))
    return mix(_ranges(_prefix(names, up), starts, starts + width, down))
