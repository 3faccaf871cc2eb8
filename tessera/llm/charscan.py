"""Character n-grams of whole texts as hashed integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .bytescan import Texts, slices

SEGMENT = 1 << 20
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lowered(texts: Texts, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of lower-cased texts, each between two spaces: (code points, index of the text, where each text begins).

    A run holds several texts or a part of a long one; parts share ``overlap`` characters so that no n-gram is lost.
    """
    for first, last in slices(texts):
        parts, owners = [], []
        for i in range(first, last):
            text = f" {texts.text(i).lower()} "
            if len(text) > SEGMENT:
                points = code_points(text)
                for at in range(0, len(points) - overlap, SEGMENT):
                    yield points[at : at + SEGMENT + overlap], np.array([i]), np.array([0])
            else:
                parts.append(code_points(text))
                owners.append(i)
        if parts:
            yield np.concatenate(parts), np.array(owners), np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))


def ngram_hashes(points: np.ndarray, begins: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``bits`` bits of all n-grams that stay within one text, and the place of each text's first one."""
    total = len(points) - n + 1
    ends = np.append(begins[1:], len(points))
    if total <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(begins), np.int64)
    h = points[:total] * _FACTORS[0]
    for k in range(1, n):
        h += points[k : k + total] * _FACTORS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h *= _FACTORS[-1] + np.uint32(2 * n)
    counts = np.maximum(ends - begins - n + 1, 0)
    if len(begins) > 1:
        inside = np.ones(total, dtype=bool)
        for k in range(1, n):
            cross = ends[:-1] - k
            inside[cross[(cross >= 0) & (cross < total)]] = False
        h = h[inside]
    return h >> np.uint32(32 - bits), np.concatenate(([0], np.cumsum(counts)[:-1]))
