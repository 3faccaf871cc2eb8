"""Vectorised scans over the UTF-8 bytes of many texts at once.

Every function here works on one contiguous byte buffer that holds a batch of texts back to back, so that the
per-character work runs inside numpy and Python only loops over batches.  Long texts are cut at separators into
slices of at most ``SLICE`` bytes (one longer word makes one longer slice), which bounds the temporary arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and 0x09-0x0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SLICE = 1 << 20

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _random_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1)) * _GOLDEN)


_EXACT_TABLE = _random_table(1)
_LOWER_TABLE = _EXACT_TABLE.copy()
_LOWER_TABLE[ord("A") : ord("Z") + 1] = _EXACT_TABLE[ord("a") : ord("z") + 1]


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = pow(base, -1, 1 << 64)
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, factor, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = Powers(0x9D39247E33776D41 | 1)
_WORD_POWERS = (Powers(0xB492B66FBE98F273 | 1), Powers(0xD6E8FEB86659FD93 | 1))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A polynomial hash of values[start:end] for each span, position independent, mixed with the length."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * _GOLDEN)


@dataclass
class Texts:
    """Texts back to back: text i is data[offsets[i]:offsets[i + 1]]; null texts are empty."""

    data: np.ndarray
    offsets: np.ndarray
    is_null: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """The bytes and offsets of an Arrow string or binary column, without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool))
    is_null = np.asarray(column.is_null())
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    if is_null.any() and lengths[is_null].any():
        data = data[np.repeat(~is_null, lengths)]
        offsets = np.concatenate(([0], np.cumsum(np.where(is_null, 0, lengths))))
    return Texts(data, offsets, is_null)


def slices(texts: Texts, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes; a longer text makes a range of its own."""
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(texts.offsets, texts.offsets[first] + size, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def parts(texts: Texts, size: int = 8 << 20) -> Iterator[tuple[int, Texts]]:
    """Pieces of a batch of about size bytes, each with the index of its first text; bounds what a task holds."""
    for first, last in slices(texts, size):
        begin, end = int(texts.offsets[first]), int(texts.offsets[last])
        yield first, Texts(texts.data[begin:end], texts.offsets[first : last + 1] - begin, texts.is_null[first:last])


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Pieces of the batches with about size bytes in a text column, and the texts: what goes out at once is as small."""
    for batch in batches:
        for first, texts in parts(texts_of(batch.column(column)), size):
            yield batch.slice(first, len(texts)), texts


@dataclass
class Words:
    """Words of a batch in order: byte spans in the batch, the hash of each, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # words of text i are first[i]:first[i + 1]


def _segments(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    while end - begin > SLICE:
        cut = begin + SLICE
        step = 4096
        while cut < end:
            found = np.flatnonzero(_IS_SEP[data[cut : cut + step]])
            if len(found):
                cut += int(found[0])
                break
            cut += step
        cut = min(cut, end)
        yield begin, cut
        begin = cut
    yield begin, end


def words_of(texts: Texts, lower: bool = False, hashed: bool = True) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text; lower takes A-Z as a-z in the hashes."""
    table = _LOWER_TABLE if lower else _EXACT_TABLE
    starts, ends, hashes = [], [], []
    for first, last in slices(texts):
        for begin, end in _segments(texts.data, int(texts.offsets[first]), int(texts.offsets[last])):
            part = texts.data[begin:end]
            if not len(part):
                continue
            inside = ~_IS_SEP[part]
            edges = texts.offsets[first : last + 1] - begin
            edges = edges[(edges > 0) & (edges < len(part))]
            before = np.empty_like(inside)
            before[0] = False
            before[1:] = inside[:-1]
            before[edges] = False
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            after[edges - 1] = False
            s = np.flatnonzero(inside & ~before)
            e = np.flatnonzero(inside & ~after) + 1
            if hashed:
                hashes.append(spans_hash(table[part], s, e, _BYTE_POWERS))
            starts.append(s + begin)
            ends.append(e + begin)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    begins = join(starts, np.int64)
    return Words(begins, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(begins, texts.offsets))


def window_hashes(word_hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each window of ``length`` consecutive words of one text, by its first word."""
    n = len(word_hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, step = [], 1 << 16
    for at in range(0, n, step):
        m = min(step, n - at)
        starts = np.arange(m)
        out.append(spans_hash(word_hashes[at : at + m + length - 1], starts, starts + length, _WORD_POWERS[which]))
    return np.concatenate(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
