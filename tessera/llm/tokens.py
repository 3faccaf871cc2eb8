"""Encoding whole texts by vocabulary files of the tokenizers library, each distinct chunk once.

A text is cut before every ASCII white space that follows something else.  The pre-tokeniser of a byte-level vocabulary
never joins characters across such a place (only a white-space run stays with what follows it), so the ids of a text
are the ids of its chunks in a row.  Natural text repeats its chunks, so the library is asked once for each distinct chunk
and the ids are gathered with numpy.  A cut is left out where another kind of white space stands before it.
"""

from __future__ import annotations

import json
import os
from itertools import chain

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .bytescan import SEPARATORS, Texts, slices
from .work import without_gc

CACHE_CHUNKS = 600_000
SLICE = 1 << 23

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SEPARATORS)] = True


def _other_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space outside ASCII, or a separator control."""
    one = data[at - 1]
    out = (one >= 0x1C) & (one <= 0x1F)
    high = np.flatnonzero(one >= 0x80)
    if len(high):
        p, a = at[high], one[high]
        b, c = data[p - 2], data[np.maximum(p - 3, 0)]
        out[high] = ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((c == 0xE2) & (b == 0x81) & (a == 0x9F)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))
    return out


def chunks_of(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sorted starts of the chunks of the texts that lie between edges, with the end of the data last."""
    space = _IS_SPACE[data]
    cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    flags = np.zeros(len(data) + 1, dtype=bool)
    flags[cut[~_other_space_before(data, cut)]] = True
    flags[edges] = True
    return np.flatnonzero(flags)


def load_tokenizer(spec: bytes, plain_specials: bool = False) -> Tokenizer:
    """A tokenizer from the bytes of its file, without truncation and padding."""
    found = Tokenizer.from_str(spec.decode("utf-8"))
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = plain_specials
    return found


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ChunkEncoder:
    """Ids of whole texts; keeps the ids of chunks that come again, about CACHE_CHUNKS of them.

    A chunk of letters alone, with one space or line feed before it and one full stop or comma after it at most, is
    handed to the merges directly, as the pre-tokeniser would cut it just so; any other goes through the whole library.
    Vocabularies of another kind than byte-level without normaliser are encoded text by text.
    """

    def __init__(self, spec: bytes, plain_specials: bool = False):
        self.tokenizer = load_tokenizer(spec, plain_specials)
        pre = json.loads(spec)
        self.chunked = pre["normalizer"] is None and pre["post_processor"] is None and (pre["pre_tokenizer"] or {}).get("type") == "ByteLevel" and pre["pre_tokenizer"]["use_regex"] and not pre["pre_tokenizer"]["add_prefix_space"] and all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in pre["added_tokens"])
        self.bytes = byte_characters()
        self.single = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in "\n.,"} if self.chunked else {}
        self._clear()

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(chunks)
        other, merge, table = [], self.tokenizer.model.tokenize, self.bytes
        space = table[32]
        for k, chunk in enumerate(chunks):
            first, last = chunk[:1], chunk[-1:]
            if first == " " and chunk[1:].isalpha() and chunk.isascii():  # the most common kind
                out[k] = [t.id for t in merge(space + chunk[1:])]
                continue
            word = chunk[first == "\n" : len(chunk) - (last == "." or last == ",")]
            if (word[1:] if first == " " else word).isalpha():
                word = word.replace(" ", space) if word.isascii() else "".join([table[b] for b in word.encode()])
                ids = [t.id for t in merge(word)]
                out[k] = (self.single["\n"] if first == "\n" else []) + ids + (self.single[last] if last in ".," else [])
            else:
                other.append(k)
        for k, x in zip(other, self.tokenizer.encode_batch_fast([chunks[k] for k in other], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def _clear(self) -> None:
        self.chunks = pa.array([], pa.string())
        self.pool = pa.array([], pa.large_binary())  # the ids of each chunk, 32 bits each
        self.hits = np.zeros(0, dtype=bool)

    def _learn(self, chunks: pa.Array) -> None:
        with without_gc():
            found = self._encode(chunks.to_pylist())
            ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(ends[-1]))
        ids = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(4 * np.concatenate(([0], ends))), pa.py_buffer(flat)])
        self.chunks, self.pool = pa.concat_arrays([self.chunks, chunks]), pa.concat_arrays([self.pool, ids])
        self.hits = np.concatenate((self.hits, np.zeros(len(found), dtype=bool)))

    def _forget(self) -> None:
        """Keeps the chunks that were met again since the last time; most of the others never will be."""
        stay = pa.array(np.flatnonzero(self.hits))
        self.chunks, self.pool = self.chunks.take(stay), self.pool.take(stay)
        self.hits = np.zeros(len(stay), dtype=bool)

    def _slice(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        bounds = chunks_of(data, edges)
        strings = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = strings.dictionary_encode()
        if len(self.chunks) > CACHE_CHUNKS:
            self._forget()
        place = pc.index_in(coded.dictionary, value_set=self.chunks).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        self.hits[place[place >= 0]] = True
        if len(new):
            place[new] = len(self.chunks) + np.arange(len(new))
            self._learn(coded.dictionary.take(pa.array(new)))
        taken = self.pool.take(pa.array(place[np.asarray(coded.indices)]))
        _, offsets, laid = taken.buffers()
        before = np.frombuffer(offsets, np.int64, len(taken) + 1) // 4
        return np.frombuffer(laid or b"", np.uint32, int(before[-1])), np.diff(before[np.searchsorted(bounds, edges)])

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not self.chunked:
            found = [x.ids for x in self.tokenizer.encode_batch([texts.text(i) for i in range(len(texts))], add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first, last in slices(texts, SLICE):
            begin, end = int(texts.offsets[first]), int(texts.offsets[last])
            part, n = self._slice(texts.data[begin:end], texts.offsets[first : last + 1] - begin)
            ids.append(part)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(spec: bytes, plain_specials: bool = False) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    key = (hash(spec), plain_specials)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(spec, plain_specials)
    return _ENCODERS[key]


def vocabulary(name_or_path: str) -> bytes:
    """The bytes of a vocabulary file, read on the driver: a path, or a name among the installed public tokenizers."""
    if os.path.sep in name_or_path:
        with open(name_or_path, "rb") as source:
            return source.read()
    import public_tokenizers

    with open(public_tokenizers.path(name_or_path), "rb") as source:
        return source.read()
