"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

*Lexicon.*  The corpus is counted word by word, and the most frequent words (to 1/16 of a count's power of two) are compiled into a minimal acyclic
automaton: words enter in byte order, and states with equal futures are merged as soon as no later word can change
them, so common endings are stored once.  Every arc carries the number of words that an accepted path skips; the sum along
a word's path is the word's rank, and the rank indexes its ids.  The automaton is a few flat integer arrays in one file, which
workers map into memory, so all workers of a machine share one copy.

*Encoding.*  The distinct words of a batch walk the automaton together, one byte of all of them per step.  Words
that it does not accept are normalised, cut by the vocabulary's pattern and merged exactly by rank: short pieces together,
pieces of more than ``LONG_PIECE`` bytes one by one with a heap of pairs, in O(n log n).
Both ways give the ids of the vocabulary's own library; the lexicon decides about speed only.

*Decoding.*  A vocabulary without a decoder joins its tokens by one space.

Defined results: null and empty texts have no ids and decode to the empty text; special tokens written out in a text get
their own ids, as in the library; rows with equal or null ids are encoded each for themselves; an empty table gives no
rows; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .bytescan import Texts, slices, texts_of, words_of
from .tokens import byte_characters, vocabulary
from .work import discard, local_file, put_bytes, scratch, settle, table, without_gc

LEXICON_WORDS = 1 << 16
#: Pieces of more bytes are merged one by one with a heap of pairs; shorter ones together, in groups of about MERGE_CELLS bytes.
LONG_PIECE = 64
MERGE_CELLS = 1 << 18
CACHE_WORDS = 600_000
COUNT_WORDS = 400_000
SLICE = 1 << 22


_NEVER = np.iinfo(np.int32).max


class WordVocabulary:
    """The parts of a vocabulary file with word ends: normaliser, pattern, merges and specials."""

    def __init__(self, spec: bytes):
        found = json.loads(spec)
        model, steps = found["model"], found["normalizer"]["normalizers"]
        pre = found["pre_tokenizer"]["pretokenizers"]
        known = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " " and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and model["type"] == "BPE" and not model["continuing_subword_prefix"] and found["decoder"] is None and not model["byte_fallback"]
        if not known:
            raise ValueError("this vocabulary is of another kind than lower-case words with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
        self.split = Split(Regex(pre[0]["pattern"]["Regex"]), "removed", invert=True)
        self.normalizer = Tokenizer.from_str(spec.decode()).normalizer
        self.specials = {x["content"]: x["id"] for x in found["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.tokens: list[str] = [""] * (1 + max(max(self.vocab.values()), *self.specials.values()))
        for token, i in [*self.vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        keys = [(self.vocab[a] << 32 | self.vocab[b], rank, self.vocab[a + b]) for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"])]
        keys.sort()
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*keys, strict=True))
        table_ = byte_characters()
        self.inner = np.array([self.vocab[c] for c in table_], dtype=np.int64)
        self.final = np.array([self.vocab[c + self.end] for c in table_], dtype=np.int64)
        self._pairs: dict[int, tuple[int, int]] | None = None

    def pieces(self, word: str) -> list[bytes | int]:
        """What of a word goes to the merges, as bytes, and the ids of specials in between."""
        if word.isascii() and word.isalpha():
            return [word.lower().encode()]
        out: list[bytes | int] = []
        at = 0
        for m in self.special.finditer(word) if self.special and "<|" in word else ():
            out += self._plain(word[at : m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        return out + self._plain(word[at:])

    def _plain(self, text: str) -> list[bytes]:
        if text.isascii():
            return [m.encode() for m in self.pattern.findall(text.lower())]
        # beyond ASCII the library's own tables tell what is a letter, since those of other modules have another version
        return [m.encode() for m, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word: short words of like lengths merge their lowest-ranked pairs together, round after round."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        while order and len(words[order[-1]]) > LONG_PIECE:
            k = order.pop()
            out[k] = self._merge_long(words[k])
        last = 0
        while last < len(order):
            first, last = last, min(last + max(MERGE_CELLS // max(len(words[order[last]]), 1), 1), len(order))
            while last - first > 1 and len(words[order[last - 1]]) > 2 * len(words[order[first]]) + 8:
                last = first + (last - first) // 2
            part = order[first:last]
            lengths = np.array([len(words[k]) for k in part], dtype=np.int64)
            width = int(lengths.max())
            raw = np.zeros((len(part), width), dtype=np.uint8)
            mask = np.arange(width)[None, :] < lengths[:, None]
            raw[mask] = np.frombuffer(b"".join(words[k] for k in part), dtype=np.uint8)
            ids = self.inner[raw]
            ids[np.arange(len(part)), lengths - 1] = self.final[raw[np.arange(len(part)), lengths - 1]]
            # rank[i, k] is that of the pair (k, k + 1) of word i; a merge renews the two pairs that it touches and moves up the rest
            rank = np.full((len(part), max(width - 1, 1)), _NEVER, dtype=np.int32)
            row, col = np.nonzero(mask[:, 1:])
            rank[row, col] = self._pair(ids[row, col], ids[row, col + 1])[0]
            live, column = np.arange(len(part)), np.arange(width)
            while len(live):
                best = rank[live].argmin(axis=1)
                go = rank[live, best] < _NEVER
                live, best = live[go], best[go]
                if not len(live):
                    break
                now, ranks, n = ids[live], rank[live], lengths[live] - 1
                rows = np.arange(len(live))
                merged = self._pair(now[rows, best], now[rows, best + 1])[1]
                after = column[None, :-1] > best[:, None]
                now[:, :-1][after] = now[:, 1:][after]
                after = after[:, :-1]
                ranks[:, :-1][after] = ranks[:, 1:][after]
                now[rows, best] = merged
                ranks[rows, n - 1] = _NEVER
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best + 1 < n)
                ranks[left, best[left] - 1] = self._pair(now[left, best[left] - 1], merged[left])[0]
                ranks[right, best[right]] = self._pair(merged[right], now[right, best[right] + 1])[0]
                ids[live], rank[live], lengths[live] = now, ranks, n
            for k, row, n in zip(part, ids, lengths, strict=True):
                out[k] = row[:n]
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (a, b), _NEVER where it does not merge, and what it merges into."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), self.merged[at]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word, in O(n log n): a heap of pairs by rank and place, over a linked list of symbols."""
        raw = np.frombuffer(word, dtype=np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.final[raw[-1]])
        if self._pairs is None:
            self._pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        pairs, n = self._pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, ids[k], ids[k + 1], found[1]) for k in range(n - 1) if (found := pairs.get(ids[k] << 32 | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, into = heapq.heappop(heap)
            other = after[k] if ids[k] == left else n
            if other >= n or ids[other] != right:  # one side has merged elsewhere since
                continue
            ids[k], ids[other] = into, -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (found := pairs.get(ids[a] << 32 | ids[b])):
                    heapq.heappush(heap, (found[0], a, ids[a], ids[b], found[1]))
        return np.array([i for i in ids if i >= 0], dtype=np.int64)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The exact ids of words without ASCII white space."""
        cut = [self.pieces(w) for w in words]
        distinct = list(dict.fromkeys(p for x in cut for p in x if isinstance(p, bytes)))
        ids = dict(zip(distinct, (x.tolist() for x in self.merge(distinct)), strict=True))
        return [[i for p in x for i in (ids[p] if isinstance(p, bytes) else (p,))] for x in cut]


# The file: magic, counts, then int32 arrays (first arc of each state, accepting flag, arc bytes, arc targets, arc outputs, id offsets, ids).
_MAGIC = b"TSLEX001"


class Transducer:
    """A minimal acyclic automaton whose paths add up to word ranks; see the module's text."""

    def __init__(self, arrays: list[np.ndarray]):
        self.first, self.accept, self.labels, self.targets, self.outputs, self.offsets, self.ids = arrays

    @classmethod
    def compile(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        """words sorted by their bytes and distinct, and the ids of each."""
        states: list[dict[int, int]] = [{}]
        accept = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (state, byte) from the root
        last = b""
        alias: dict[int, int] = {}

        def settle_from(depth: int) -> None:
            while len(path) > depth:
                state, byte = path.pop()
                child = states[state][byte]
                key = (accept[child], tuple(sorted(states[child].items())))
                if key in register:
                    states[state][byte] = register[key]
                    alias[child] = register[key]
                else:
                    register[key] = child

        for word in words:
            common = len(os.path.commonprefix([word, last]))
            settle_from(common)
            state = states[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                states.append({})
                accept.append(False)
                states[state][byte] = len(states) - 1
                path.append((state, byte))
                state = len(states) - 1
            accept[state] = True
            last = word
        settle_from(0)
        live, stack = {0: 0}, [0]
        while stack:
            for child in states[stack.pop()].values():
                if child not in live:
                    live[child] = len(live)
                    stack.append(child)
        order = sorted(live, key=live.get)
        counts: dict[int, int] = {}

        def count(root: int) -> None:
            todo = [root]
            while todo:
                s = todo[-1]
                if s in counts:
                    todo.pop()
                elif missing := [c for c in states[s].values() if c not in counts]:
                    todo += missing
                else:
                    counts[s] = accept[s] + sum(counts[c] for c in states[s].values())
                    todo.pop()

        count(0)
        first, labels, targets, outputs = [0], [], [], []
        for s in order:
            skipped = int(accept[s])
            for byte, child in sorted(states[s].items()):
                labels.append(byte)
                targets.append(live[child])
                outputs.append(skipped)
                skipped += counts[child]
            first.append(len(labels))
        lengths = [len(x) for x in ids]
        make = lambda x: np.array(x, dtype=np.int32)
        return cls([make(first), make([accept[s] for s in order]), make(labels), make(targets), make(outputs), make(np.concatenate(([0], np.cumsum(lengths)))), make([i for x in ids for i in x])])

    def dumps(self) -> bytes:
        arrays = (self.first, self.accept, self.labels, self.targets, self.outputs, self.offsets, self.ids)
        return _MAGIC + struct.pack("<7q", *map(len, arrays)) + b"".join(x.astype("<i4").tobytes() for x in arrays)

    @classmethod
    def map(cls, uri: str) -> Transducer:
        """Maps the file at uri into memory (from a local copy, removed at once, where the store is remote)."""
        path, copied = local_file(uri)
        with open(path, "rb") as source:
            held = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ)
        if copied:
            os.unlink(path)
        if held[:8] != _MAGIC:
            raise ValueError(f"{uri} is no lexicon")
        arrays, at = [], 64
        for n in struct.unpack("<7q", held[8:64]):
            arrays.append(np.frombuffer(held, dtype="<i4", count=n, offset=at))
            at += 4 * n
        return cls(arrays)

    def ranks(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The rank of each word data[start:start + length], -1 where it is not in the lexicon."""
        state, rank = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        out = np.full(len(starts), -1, dtype=np.int64)
        arc = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) * 256 + self.labels  # sorted
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            key = state[live] * 256 + data[starts[live] + step]
            at = np.minimum(np.searchsorted(arc, key), len(arc) - 1) if len(arc) else np.zeros(len(key), np.int64)
            ok = arc[at] == key if len(arc) else np.zeros(len(key), bool)
            live, at = live[ok], at[ok]
            rank[live] += self.outputs[at]
            state[live] = self.targets[at]
            step += 1
            ended = lengths[live] == step
            done = live[ended]
            done = done[self.accept[state[done]] > 0]
            out[done] = rank[done]
            live = live[~ended]
        return out

    def of(self, rank: int) -> list[int]:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, times) of all words of all whole texts; a task adds up before it hands on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "times"])
            found.clear()
            return out

        for batch in batches:
            for distinct, index, _ in _distinct_words(texts_of(batch.column(0))):
                for word, n in zip(distinct.to_pylist(), np.bincount(index, minlength=len(distinct)).tolist(), strict=True):
                    found[word] = found.get(word, 0) + n
                if len(found) > COUNT_WORDS:
                    yield flush()
        if found:
            yield flush()

    return docs.select("text").mapInArrow(scan, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))


def _distinct_words(texts: Texts) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of a batch: its distinct words, the index of each word in order, and where the words of each text begin."""
    for first, last in slices(texts, SLICE):
        begin, end = int(texts.offsets[first]), int(texts.offsets[last])
        part = Texts(texts.data[begin:end], texts.offsets[first : last + 1] - begin, texts.is_null[first:last])
        words = words_of(part, hashed=False)
        lengths = words.ends - words.starts
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        inside = np.zeros(len(part.data) + 1, dtype=np.int8)
        inside[words.starts] += 1
        np.subtract.at(inside, words.ends, 1)
        packed = part.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        strings = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed)))
        coded = strings.dictionary_encode()
        yield coded.dictionary, np.asarray(coded.indices), words.first


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """The ``words`` most frequent words.  The driver gets those and a row per group of counts.

    Counts are grouped to 1/16 of their power of two, so there are at most about 1,000 groups, whatever the corpus.  The groups
    tell the least count that enough words reach; words above its group are taken, and any words of that group fill what is left.
    """
    counted = settle(word_counts(docs), "word-counts")
    power = F.floor(F.log2("times"))
    group = (power * 16 + F.floor(F.col("times") * F.lit(16) / F.pow(F.lit(2.0), power)) - 16).cast("int")
    graded = counted.withColumn("grade", group)
    sizes = sorted(((r["grade"], r["n"]) for r in graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for grade, n in sizes:
        if taken + n > words:
            least = grade
            break
        taken += n
    found = [r["word"] for r in (graded if least is None else graded.where(F.col("grade") > least)).select("word").collect()]
    if least is not None and words > taken:
        found += [r["word"] for r in graded.where(F.col("grade") == least).select("word").limit(words - taken).collect()]
    discard(counted)
    return found


def compile_lexicon(docs: DataFrame, spec: bytes, folder: str, words: int = LEXICON_WORDS) -> str:
    """Compiles the ``words`` most frequent words of docs and returns the file's URI.  The driver holds those words alone."""
    vocab = WordVocabulary(spec)
    chosen = sorted(frequent_words(docs, words), key=lambda w: w.encode())
    uri = f"{folder}/lexicon.bin"
    put_bytes(uri, Transducer.compile([w.encode() for w in chosen], vocab.encode_words(chosen)).dumps())
    return uri


class LexiconEncoder:
    """Ids and joined tokens of words, by the lexicon or by merging; keeps words that come again, about CACHE_WORDS of them."""

    def __init__(self, spec: bytes, uri: str):
        self.vocab, self.lexicon = WordVocabulary(spec), Transducer.map(uri)
        self.listed = _binaries(np.ascontiguousarray(self.lexicon.ids), 4 * self.lexicon.offsets.astype(np.int64))
        # what each id is written as, in digits and as its token, with a space after it
        self.forms = [pa.array(x, pa.large_binary()) for x in ([b"%d " % i for i in range(len(self.vocab.tokens))], [t.encode() + b" " for t in self.vocab.tokens])]
        self.words = pa.array([], pa.string())
        self.counts, self.hits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.pools = [pa.array([], pa.large_binary())] * 2

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Adds distinct words and returns their places: those of the lexicon first, then the merged ones."""
        _, offsets, data = words.buffers()
        bounds = np.frombuffer(offsets, np.int32, len(words) + 1).astype(np.int64)
        ranks = self.lexicon.ranks(np.frombuffer(data or b"", np.uint8), bounds[:-1], np.diff(bounds))
        seen, unseen = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
        with without_gc():
            merged = self.vocab.encode_words(words.take(pa.array(unseen)).to_pylist())
            lengths = np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))
            flat = np.fromiter(chain.from_iterable(merged), dtype=np.int32, count=int(lengths.sum()))
        listed, at = _laid_out(self.listed, ranks[seen])
        flat, lengths = np.concatenate((np.frombuffer(listed, np.int32, int(at[-1]) // 4), flat)), np.concatenate((np.diff(at) // 4, lengths))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        for k, form in enumerate(self.forms):
            text, at = _laid_out(form, flat)
            self.pools[k] = pa.concat_arrays([self.pools[k], _binaries(text, at[ends])])
        places = np.empty(len(words), dtype=np.int64)
        places[np.concatenate((seen, unseen))] = len(self.words) + np.arange(len(words))
        self.words = pa.concat_arrays([self.words, words.take(pa.array(seen)), words.take(pa.array(unseen))])
        self.counts, self.hits = np.concatenate((self.counts, lengths)), np.concatenate((self.hits, np.zeros(len(words), dtype=bool)))
        return places

    def _forget(self) -> None:
        """Keeps the words that were met again since the last time; most of the others never will be."""
        stay = np.flatnonzero(self.hits)
        self.words, self.pools = self.words.take(pa.array(stay)), [p.take(pa.array(stay)) for p in self.pools]
        self.counts, self.hits = self.counts[stay], np.zeros(len(stay), dtype=bool)

    def encode(self, texts: Texts) -> Iterator[tuple[int, memoryview, memoryview]]:
        """(number of ids, ids joined by spaces, tokens joined by spaces) of each text, as UTF-8 bytes.

        Every distinct word of a slice brings its ids and tokens as text that ends with a space; taking them in the order of the
        words lays whole texts out at once, and each text is cut out without its last space.
        """
        for distinct, index, first in _distinct_words(texts):
            if len(self.words) > CACHE_WORDS:
                self._forget()
            place = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.flatnonzero(place < 0)
            self.hits[place[place >= 0]] = True
            if len(new):
                place[new] = self._learn(distinct.take(pa.array(new)))
            total = np.concatenate(([0], np.cumsum(self.counts[place][index])))[first]
            laid = [(memoryview(data), at[first].tolist()) for data, at in (_laid_out(pool, place[index]) for pool in self.pools)]
            for i, n in enumerate(np.diff(total).tolist()):
                yield n, *(data[at[i] : max(at[i + 1] - 1, at[i])] for data, at in laid)


def _binaries(data: object, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(data)])


def _laid_out(pool: pa.Array, places: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The parts at these places of the pool one after the other, and where each begins (and the last ends)."""
    taken = pool.take(pa.array(places))
    _, offsets, data = taken.buffers()
    return data if data is not None else pa.py_buffer(b""), np.frombuffer(offsets, np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)


_ENCODERS: dict[str, LexiconEncoder] = {}


def encoded(docs: DataFrame, spec: bytes, uri: str, texts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document; texts adds the ids and the decoded text."""
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if uri not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[uri] = LexiconEncoder(held.value, uri)
        for batch in batches:
            n, ids, decoded, own_ids, own_texts = [], [], [], [], []
            for count, a, b in _ENCODERS[uri].encode(texts_of(batch.column(1))):
                n.append(count)
                ids.append(hashlib.sha256(a).hexdigest())
                decoded.append(hashlib.sha256(b).hexdigest())
                if texts:
                    own_ids.append(list(map(int, bytes(a).split())))
                    own_texts.append(bytes(b).decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                columns += [pa.array(own_ids, pa.list_(pa.int32())), pa.array(own_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<int>, decoded string" if texts else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op5_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with a lexicon of their most frequent words."""
    docs, spec = table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")
    uri = compile_lexicon(docs, spec, scratch(spark, "lexicon"))
    return encoded(docs, spec, uri)
