"""Substring dedup by level-wise doubling.

A window is ``window`` consecutive words of one document.  The operator finds every window whose word sequence starts at
another place too (same document included) and removes the words that such windows cover.  Windows repeated at one
length alone are extended to twice that length:

1.  *Seeds.*  Each window of ``window`` words holds shorter windows of a quarter of its length (9 words of 35).  The
    smallest hash among those marks the window's seed; it depends on the words alone, so equal windows have seeds at
    equal places.  About 7 % of all places are seeds.  Only seeds whose words occur at two or more places survive.
2.  *Doubling.*  A surviving seed is extended to twice its length, to the right and to the left.  A repeated window
    that holds the seed holds one of the two extensions as well, so a seed lives on only if one of them is repeated.
3.  *Full length.*  The last doubling is cut at the wanted length: all windows that hold a surviving seed are sorted by
    96 bits of hash, and those that equal a neighbour are the answer.

No level drops a repeated window, so the result is that of comparing all windows with all others.  The first two levels
count their keys with map-side partial sums, and the occurrences then meet the repeated keys in a join.  Occurrences of a
key that holds more than one in ``HOT_SHARE`` of them are known to be repeated by a broadcast list of such keys (fewer
than ``HOT_SHARE``, whatever the input); they are dealt evenly instead of by their key.  At the last level a piece of a batch sends a window once however often it holds it.  No group is ever
gathered.  A window of ``window`` words is found whole within one document, whatever
its length (up to 2**30 words); the arrays of one task follow the longest document, not the corpus.

Defined results: null or empty texts have no words and nothing is removed from them; texts with fewer words than a window
keep all of them; rows repeated with equal id and text are documents of their own, and so repeat each other; null ids
are kept; an empty table gives no rows; further columns of the input pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import Words, mix64, parts as parts_of, signed, texts_of, window_hashes, words_of
from .work import columns, discard, private, row_key, settle, table

WINDOW = 35
FLUSH_ROWS = 200_000
HOT_SHARE = 1024


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each run of width values, by doubling runs."""
    done, out = 1, x
    while 2 * done <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    return best(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def seeds_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the smallest of a run of ``width`` places; ties all count."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(hashes, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), width, np.maximum) == hashes)


def seed_length(window: int) -> int:
    """A quarter of the window, rounded up: two doublings reach it."""
    return max(1, -(-window // 4))


def _rows(names: list[str], kinds: list[pa.DataType], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), k) for p, k in zip(parts, kinds, strict=True)], names)


def seed_rows(keyed: DataFrame, window: int) -> DataFrame:
    """(seed, left, right, key, place) of each seed: hashes of its words and of both extensions to twice the length.

    An extension that would leave the document takes the value of the seed mixed with the side, so it never vanishes.
    """
    short = seed_length(window)
    twice = min(2 * short, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["seed", "left", "right", "key", "place"], [pa.int64()] * 4 + [pa.int32()]
        parts: list[list[np.ndarray]] = [[] for _ in names]
        held = 0
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for first, texts in parts_of(texts_of(batch.column(1))):
                words = words_of(texts)
                for i in range(len(texts)):
                    own = words.hashes[words.first[i] : words.first[i + 1]]
                    if len(own) < window:
                        continue
                    base, double = window_hashes(own, short), window_hashes(own, twice)
                    at = seeds_of(base, window - short + 1)
                    right, left = double[np.minimum(at, len(double) - 1)], double[np.maximum(at + short - twice, 0)]
                    right[at + twice > len(own)] = 0
                    left[at + short < twice] = 0
                    for p, x in zip(parts, (signed(base[at]), signed(left), signed(right), np.full(len(at), keys[first + i]), at.astype(np.int32)), strict=True):
                        p.append(x)
                    held += len(at)
                    if held >= FLUSH_ROWS:
                        yield _rows(names, kinds, parts)
                        parts, held = [[] for _ in names], 0
        if held:
            yield _rows(names, kinds, parts)

    return keyed.mapInArrow(scan, "seed long, left long, right long, key long, place int")


_WINDOW_ROWS = "h1 long, tail long, key long"
#: ``tail`` holds 32 further bits of the hash, two flags and the place, so that a row has three numbers only.
_KNOWN, _TOLD, _PLACE = 1 << 31, 1 << 30, (1 << 30) - 1


def window_rows(keyed: DataFrame, window: int) -> DataFrame:
    """The windows that hold a listed seed; keyed has key, text and the seeds' places.

    Each piece of a batch adds up its own windows before they travel.  A window that it holds once goes out with its place,
    to be asked about.  One that it holds several times is known to be repeated: a single row tells the others of it,
    and its places travel on as known ones, dealt by themselves and not by the window.  So a very common window makes a
    row per piece where windows meet, not one per occurrence.
    """
    short = seed_length(window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _WINDOW_ROWS.split(", ")]
        for lead, texts, keys, seeds in ((first, texts, np.asarray(batch.column(0)), batch.column(2)) for batch in batches for first, texts in parts_of(texts_of(batch.column(1)))):
            words = words_of(texts)
            found: list[tuple[np.ndarray, ...]] = []
            for i in range(len(texts)):
                own = words.hashes[words.first[i] : words.first[i + 1]]
                total = len(own) - window + 1
                at_seeds = np.asarray(seeds[lead + i].values).astype(np.int64)
                mark = np.zeros(len(own) + window + 2, dtype=np.int32)
                np.add.at(mark, np.maximum(at_seeds + short - window, 0), 1)
                np.add.at(mark, at_seeds + 1, -1)
                at = np.flatnonzero(np.cumsum(mark)[:total] > 0)
                h1, h2 = window_hashes(own, window)[at], window_hashes(own, window, 1)[at]
                found.append((signed(h1), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(at), lead + i, dtype=np.int32), at.astype(np.int32)))
            h1, h2, owner, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
            order = np.lexsort((h2, h1))
            equal = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            first, several = np.ones(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
            first[1:] = ~equal
            several[1:] |= equal
            several[:-1] |= equal
            ask, tell, known = order[~several], order[several & first], order[several]
            high = h2.astype(np.int64) << 32
            own = mix64(keys[owner[known]].view(np.uint64) + place[known].astype(np.uint64))
            rows = ((ask, h1[ask], 0), (tell, h1[tell], _TOLD), (known, signed(own), _KNOWN))
            for at, lead_hash, flag in rows:
                for k in range(0, len(at), FLUSH_ROWS):
                    part = at[k : k + FLUSH_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(lead_hash[k : k + FLUSH_ROWS]), pa.array(high[part] | place[part].astype(np.int64) | flag), pa.array(keys[owner[part]])], names)

    return keyed.mapInArrow(scan, _WINDOW_ROWS)


def repeated_places(windows: DataFrame) -> DataFrame:
    """(key, place) of the windows that occur twice or more; windows are compared with their neighbours after one sort."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        twin = False

        def out(key: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array((tail & _PLACE).astype(np.int32))], ["key", "place"])

        for batch in batches:
            columns = [np.asarray(batch.column(i)) for i in range(3)]
            known = columns[1] & _KNOWN != 0
            if known.any():
                yield out(columns[2][known], columns[1][known])
            h1, tail, key = (np.concatenate((h, c[~known])) for h, c in zip(held, columns, strict=True))
            if not len(h1):
                continue
            equal = (h1[1:] == h1[:-1]) & (tail[1:] >> 32 == tail[:-1] >> 32)
            repeated = np.concatenate(([twin], equal))
            repeated[:-1] |= equal
            go = repeated[:-1] & (tail[:-1] & _TOLD == 0)
            yield out(key[:-1][go], tail[:-1][go])
            held, twin = (h1[-1:], tail[-1:], key[-1:]), bool(repeated[-1])
        if twin and held[1][0] & _TOLD == 0:
            yield out(held[2], held[1])

    return windows.repartition("h1").sortWithinPartitions("h1", "tail").mapInArrow(compare, "key long, place int")


def _recurring(rows: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose values of names occur twice or more, and the settled table they are found by; rows has key and place."""
    times = settle(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "times")
    all_times = times.agg(F.sum("times")).first()[0] or 0
    hot = times.where(F.col("times") > F.lit(all_times / HOT_SHARE)).select(*names, F.lit(True).alias("hot"))
    listed = times.select(*(F.col(n).alias(f"listed_{n}") for n in names))
    marked = rows.join(F.broadcast(hot), [*names], "left").withColumn("dealt", F.when(F.col("hot"), F.xxhash64("key", "place")).otherwise(F.col(names[-1])))
    same = F.col("dealt") == F.col(f"listed_{names[-1]}")
    for n in names[:-1]:
        same = same & (F.col(n) == F.col(f"listed_{n}"))
    return marked.join(listed, same, "left").where(F.col("hot") | F.col(f"listed_{names[-1]}").isNotNull()).select(*rows.columns), times


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, places): the first words of all repeated windows of each document that has any; key is row_key(doc_id, text)."""
    spark = docs.sparkSession
    keyed = docs.where("text IS NOT NULL").select(row_key("doc_id", "text").alias("key"), "text")
    seeds = seed_rows(keyed, window)
    again, times = _recurring(seeds, "seed")
    first = settle(again, "seeds")
    discard(times)
    sides = first.select("key", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("hash")), F.struct(F.lit(1).alias("side"), F.col("right").alias("hash")))).alias("x")).where("x.hash != 0").select("key", "place", "x.side", "x.hash")
    again, times = _recurring(sides, "side", "hash")
    places = settle(again.groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("seeds")), "doubled")
    discard(first, times)
    windows = window_rows(keyed.join(places, "key").select("key", "text", "seeds"), window)
    found = settle(repeated_places(windows).groupBy("key").agg(F.array_sort(F.collect_list("place")).alias("places")), "repeated")
    discard(places)
    return found


def covered(n_words: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows at places cover."""
    mark = np.zeros(n_words + window + 1, dtype=np.int32)
    np.add.at(mark, places, 1)
    np.add.at(mark, places + window, -1)
    return np.cumsum(mark)[:n_words] > 0


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words at the given byte spans joined by one space."""
    if not len(starts):
        return b""
    low, high = int(starts[0]), int(ends[-1])
    part = np.empty(high - low + 1, dtype=np.uint8)
    part[:-1] = data[low:high]
    part[ends - low] = 0x20
    mark = np.zeros(high - low + 2, dtype=np.int8)
    mark[starts - low] += 1
    mark[ends - low + 1] -= 1
    return part[np.cumsum(mark[:-1], dtype=np.int8) > 0][:-1].tobytes()


def without_words(data: np.ndarray, words: Words, first: int, last: int, begin: int, end: int, drop: np.ndarray) -> bytes:
    """The bytes begin:end without the dropped words and the white space before each of them."""
    keep = np.ones(end - begin, dtype=bool)
    starts, ends = words.starts[first:last] - begin, words.ends[first:last] - begin
    before = np.concatenate(([0], ends[:-1]))
    for i in np.flatnonzero(drop):
        keep[before[i] : ends[i]] = False
    return data[begin:end][keep].tobytes()


def with_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with one more column: the first words of the repeated windows of each document, null where there are none."""
    key, places = private("key", docs), private("places", docs)
    found = repeated_windows(docs, window).select(F.col("key").alias(key), F.col("places").alias(places))
    return docs.withColumn(key, row_key("doc_id", "text")).join(found, key, "left").select(*columns(docs), F.col(places))


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64), []
            for first, texts in parts_of(texts_of(batch.column(1))):
                words = words_of(texts, hashed=False)
                for i in range(len(texts)):
                    starts, ends = words.starts[words.first[i] : words.first[i + 1]], words.ends[words.first[i] : words.first[i + 1]]
                    places, total[first + i] = batch.column(2)[first + i], len(starts)
                    if places.is_valid:
                        keep = ~covered(len(starts), np.asarray(places.values).astype(np.int64), window)
                        removed[first + i] = len(starts) - int(keep.sum())
                        starts, ends = starts[keep], ends[keep]
                    digests.append(hashlib.sha256(kept_words(texts.data, starts, ends)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    slim = docs.select("doc_id", "text")
    return with_repeats(slim, window).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every word covered by a repeated window cut out of ``text``; other texts stay byte for byte."""
    schema, at = docs.schema, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lead, texts in parts_of(texts_of(batch.column(at))):
                words = words_of(texts, hashed=False)
                for i in range(len(texts)):
                    places = batch.column(batch.num_columns - 1)[lead + i]
                    if places.is_valid:
                        first, last = int(words.first[i]), int(words.first[i + 1])
                        drop = covered(last - first, np.asarray(places.values).astype(np.int64), window)
                        out.append(without_words(texts.data, words, first, last, int(texts.offsets[i]), int(texts.offsets[i + 1]), drop).decode("utf-8", "replace"))
                    else:
                        out.append(None if texts.is_null[i] else texts.text(i))
            columns = [pa.array(out, batch.schema.field(at).type) if j == at else batch.column(j) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return with_repeats(docs, window).mapInArrow(cut, schema)


def op2_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in each document without its repeated windows of 35 words."""
    return removal_digests(table(spark, sf_dir, "documents"), WINDOW)
