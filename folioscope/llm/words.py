"""Word places and word hashes of many texts at once, by whole-array NumPy steps over their bytes.

A word is a run of ASCII letters and digits and of bytes from 0x80; A-Z count as a-z. Hashes are 64-bit polynomials,
mixed; they only ever propose matches or stand for equal words within one verification.
"""

from __future__ import annotations

import numpy as np

_B, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_GRAM = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3], np.uint64)
_NORM = np.zeros(256, np.uint8)
_NORM[48:58] = np.arange(48, 58)
_NORM[97:123] = np.arange(97, 123)
_NORM[65:91] = np.arange(97, 123)
_NORM[128:] = np.arange(128, 256)
#: Words between ASCII white space; what white space leaves free stands for the byte 0.
BETWEEN_SPACES = np.arange(256, dtype=np.uint8)
BETWEEN_SPACES[65:91] = np.arange(97, 123)
BETWEEN_SPACES[0] = 0x20
BETWEEN_SPACES[[9, 10, 11, 12, 13, 0x20]] = 0
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    p = _powers[which]
    while len(p) < n:
        b = _B if which == "up" else pow(_B, -1, 1 << 64)
        p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
        _powers[which] = p
    return p[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes], norm: np.ndarray = _NORM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start byte, end byte) of each word; places are within b"\\n".join(texts) plus a newline at its front. norm: what stands for each byte, 0 between words."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    norm = norm[data]
    inside = (norm > 0).view(np.int8)
    edges = np.diff(inside)
    starts, ends = np.nonzero(edges == 1)[0] + 1, np.nonzero(edges == -1)[0] + 1
    sums = np.cumsum(norm * _power("up", len(norm)), dtype=np.uint64)
    h = _mixed((sums[ends - 1] - sums[starts - 1]) * _power("down", len(norm))[starts] + (ends - starts).astype(np.uint64))
    firsts = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    return h, np.searchsorted(firsts, starts, side="right") - 1, starts, ends


def lowered(texts: list[bytes]) -> list[bytes]:
    """Texts in lower case by Unicode; those of ASCII need nothing, as hashing folds A-Z."""
    return [t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]


def grams(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the first word) of each run of n words within one text."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(h) - n + 1
    g = np.full(m, n, np.uint64)
    for k in range(n):
        g += h[k : k + m] * _GRAM[k]
    at = np.nonzero(owner[:m] == owner[n - 1 :])[0]
    return _mixed(g[at]), at


def pairs(h: np.ndarray, owner: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the first word) of each two words of one text that are `gap` apart; alike for any gap."""
    if len(h) <= gap:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.nonzero(owner[:-gap] == owner[gap:])[0]
    return _mixed(h[at] * _GRAM[0] + h[at + gap] * _GRAM[1]), at
