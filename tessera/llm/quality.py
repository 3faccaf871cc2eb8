"""Quality rules: plain counts of each text, and a calibrated logistic regression on hashed n-grams.

*Model.*  Features are the relative frequencies of a text's lower-cased words and word pairs, hashed to ``2**BITS``
places, and of its character 4-grams, hashed likewise.  Logistic regression is trained on labelled rows with both
classes weighted alike, on a sample bounded by ``LABELLED`` rows (one of each id, those with the smallest hashes of their ids).  A
fifth of the sample is left out of the training and calibrates the scores: a logistic curve turns them into
probabilities at the true class shares.

*Scoring.*  Texts are scored in Arrow batches: a text's score is the mean weight of its words, pairs and 4-grams, so
whole texts of any length need two table lookups per character.  A text is kept when its probability of good quality
reaches ``KEEP``, a fixed threshold, and no base rule failed.

Defined results: null and empty texts have no words and fail the base rule; without labelled rows of both classes the
model keeps everything; rows with equal or null ids are scored each for themselves; labels without a document, null
labels and labels of null ids are left out, and of several labels of an id the lowest counts; an empty table gives no
rows; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import Texts, _EXACT_TABLE, _BYTE_POWERS, _IS_SEP, mix64, pieces, slices, spans_hash, texts_of, window_hashes, words_of
from .charscan import lowered, ngram_hashes
from .work import smallest_hashes, table

BITS = 18
NGRAM = 4
LABELLED = 3000
KEEP = 0.5
STEPS = 150
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

_PLACES = 1 << BITS
_SCALE = 40.0
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    out = {name: np.zeros(len(texts), dtype=np.int64) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for first, last in slices(texts):
        begin, end = int(texts.offsets[first]), int(texts.offsets[last])
        part = Texts(texts.data[begin:end], texts.offsets[first : last + 1] - begin, texts.is_null[first:last])
        here = slice(first, last)
        data, edges = part.data, part.offsets
        if not len(data):
            continue
        running = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[edges])
        out["word_chars"][here] = running(((data & 0xC0) != 0x80) & ~_IS_SEP[data])
        out["n_symbols"][here] = running(_IS_SYMBOL[data])
        words = words_of(part)
        out["n_words"][here] = np.diff(words.first)
        # lines: cut after every line feed and at the texts' borders
        cuts = np.union1d(np.flatnonzero(data == 0x0A) + 1, edges)
        starts, ends = cuts[:-1], cuts[1:].copy()
        ends[data[ends - 1] == 0x0A] -= 1
        filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        starts, ends = starts[filled], ends[filled]
        owner = np.searchsorted(edges, starts, side="right") - 1
        lines = np.concatenate([spans_hash(_EXACT_TABLE[data[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], ends[a:b] - starts[a], _BYTE_POWERS) for a, b in _runs(starts, ends)]) if len(starts) else np.zeros(0, np.uint64)
        order = np.lexsort((lines, owner))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (lines[order][1:] == lines[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        out["n_dup_lines"][here] = np.bincount(owner[order][same], minlength=last - first)
        # words in windows of three that occur twice or more
        if len(words.hashes) >= 3:
            of = np.repeat(np.arange(last - first), np.diff(words.first))
            within = of[2:] == of[:-2]
            keys = mix64(window_hashes(words.hashes, 3) + of[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            twin = np.zeros(len(keys), dtype=bool)
            equal = ordered[1:] == ordered[:-1]
            twin[order[1:][equal]] = True
            twin[order[:-1][equal]] = True
            twin &= within
            covered = np.zeros(len(words.hashes), dtype=bool)
            for k in range(3):
                covered[k : k + len(twin)] |= twin
            out["n_repeat_words"][here] = np.bincount(of[covered], minlength=last - first)
    return out


def _runs(starts: np.ndarray, ends: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + size, side="right")))
        yield a, b
        a = b


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def word_features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Places of words and word pairs in order of the texts, and where those of each text begin (and the last end)."""
    words = words_of(texts, lower=True)
    single = (words.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    pair = (mix64(words.hashes[:-1] * np.uint64(3) + words.hashes[1:]) >> np.uint64(64 - BITS)).astype(np.int64)
    places = np.empty(2 * len(single), dtype=np.int64)
    places[::2] = single
    places[1:-1:2] = pair
    lasts = words.first[1:][np.diff(words.first) > 0]
    keep = np.ones(len(places), dtype=bool)
    keep[2 * lasts - 1] = False  # the pair over a text's end
    counts = np.maximum(2 * np.diff(words.first) - 1, 0)
    return places[keep], np.concatenate(([0], np.cumsum(counts)))


def sparse_features(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text; 4-grams have the upper half of the places."""
    counts = [np.zeros(0, np.int64)] * len(texts)
    for points, owners, begins in lowered(texts, NGRAM - 1):
        hashes, at = ngram_hashes(points, begins, NGRAM, BITS)
        for k, (a, b) in enumerate(zip(at, np.append(at[1:], len(hashes)), strict=True)):
            counts[owners[k]] = np.concatenate((counts[owners[k]], hashes[a:b].astype(np.int64)))
    places, first = word_features(texts)
    out = []
    for i in range(len(texts)):
        found = []
        for own, shift in ((places[first[i] : first[i + 1]], 0), (counts[i], _PLACES)):
            ids, n = np.unique(own, return_counts=True)
            found.append((ids + shift, n * (_SCALE / max(len(own), 1))))
        out.append((np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, slope, intercept): the probability of label 1 is logistic(slope * (x . weights) + intercept)."""
    weights = np.zeros(2 * _PLACES)
    if len(set(labels.tolist())) < 2:
        return weights, 0.0, 30.0
    held = np.arange(len(rows)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    ids = np.concatenate([rows[i][0] for i in train])
    values = np.concatenate([rows[i][1] for i in train])
    owner = np.repeat(np.arange(len(train)), [len(rows[i][0]) for i in train])
    used = np.flatnonzero(np.bincount(ids, minlength=2 * _PLACES))
    column = np.zeros(2 * _PLACES, dtype=np.intp)
    column[used] = np.arange(len(used))
    column = column[ids]
    del ids
    y = labels[train].astype(float)
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(len(used)), 0.0
    m1, m2, decay = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 1e-6
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, values * w[column], minlength=len(train)) + b
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y) * balance
        grad = np.append(np.bincount(column, values * error[owner], minlength=len(used)) + decay * w, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[used] = w
    check = np.flatnonzero(held) if held.any() else train
    score = np.array([rows[i][1] @ weights[rows[i][0]] for i in check]) + b
    # a logistic curve over the scores; smoothed targets keep it finite where the classes part cleanly
    y = labels[check].astype(float)
    positive, negative = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack((score, np.ones_like(score)), axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step_ = np.linalg.solve(hessian, x.T @ (p - target))
        line = line - step_ / max(1.0, np.abs(step_).max())
    return weights, float(line[0]), float(line[0] * b + line[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> dict:
    """The model, trained in one task on at most ``rows`` labelled documents."""
    valid = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    ids = smallest_hashes(valid, "doc_id", rows, rows)
    chosen = valid.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # one row of each id: of rows that share it, that whose text has the smallest hash
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))
    labelled = found.select("doc_id", F.col("x.text").alias("text"), "quality")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                found = sparse_features(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x[0].astype("<i4").tobytes() for x in found], pa.binary()), pa.array([x[1].astype("<f4").tobytes() for x in found], pa.binary())], ["doc_id", "quality", "places", "amounts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_, y, ids = [], [], []
        for batch in batches:
            for doc_id, quality, places, amounts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids.append(doc_id)
                y.append(quality)
                rows_.append((np.frombuffer(places, "<i4"), np.frombuffer(amounts, "<f4")))
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        weights, slope, intercept = fit([rows_[i] for i in order], np.array(y, dtype=np.int64)[order])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([slope]), pa.array([intercept])], ["weights", "slope", "intercept"])

    sparse = labelled.mapInArrow(features, "doc_id long, quality int, places binary, amounts binary")
    found = sparse.repartition(1).mapInArrow(learn, "weights binary, slope double, intercept double").first()
    return found.asDict() if found else {"weights": np.zeros(2 * _PLACES, "<f4").tobytes(), "slope": 0.0, "intercept": 30.0}


def probabilities(texts: Texts, weights: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    """The calibrated probability of good quality of each text."""
    total, grams = np.zeros(len(texts)), np.zeros(len(texts))
    for points, owners, begins in lowered(texts, NGRAM - 1):
        hashes, at = ngram_hashes(points, begins, NGRAM, BITS)
        sums = np.concatenate(([0.0], np.cumsum(weights[_PLACES:][hashes])))
        ends = np.append(at[1:], len(hashes))
        np.add.at(total, owners, sums[ends] - sums[at])
        np.add.at(grams, owners, ends - at)
    score = total / np.maximum(grams, 1)
    for first, last in slices(texts):
        begin, end = int(texts.offsets[first]), int(texts.offsets[last])
        places, at = word_features(Texts(texts.data[begin:end], texts.offsets[first : last + 1] - begin, texts.is_null[first:last]))
        sums = np.concatenate(([0.0], np.cumsum(weights[places])))
        score[first:last] += (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
    return 1 / (1 + np.exp(-np.clip(slope * _SCALE * score + intercept, -50, 50)))


_RULES = [(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("quality_score", T.DoubleType())]


def judged(docs: DataFrame, model: dict, keep: float = KEEP) -> DataFrame:
    """docs with the counts, base_failed, kept and quality_score of each text; columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n, _ in _RULES]
    own = [c for c in docs.columns if c not in names]
    at = own.index("text")
    slim = docs.select(*own)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(held.value["weights"], dtype="<f4")
        for batch, texts in pieces(batches, at):
            counts = base_counts(texts)
            failed = base_failed(counts["n_words"], counts["n_repeat_words"])
            p = probabilities(texts, weights, held.value["slope"], held.value["intercept"])
            found = [*(counts[n] for n in names[:5]), failed, ~failed & (p >= keep), p]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*own, *names])

    return slim.mapInArrow(judge, T.StructType([*slim.schema.fields, *(T.StructField(n, k) for n, k in _RULES)]))


def good_rows(docs: DataFrame, model: dict, keep: float = KEEP) -> DataFrame:
    """The rows of docs that ``judged`` would keep, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(held.value["weights"], dtype="<f4")
        for batch, texts in pieces(batches, at):
            counts = base_counts(texts)
            failed = base_failed(counts["n_words"], counts["n_repeat_words"])
            yield batch.filter(pa.array(~failed & (probabilities(texts, weights, held.value["slope"], held.value["intercept"]) >= keep)))

    return docs.mapInArrow(choose, docs.schema)


def op7_hashed_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents; the model is trained on the labels table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged(docs, model).drop("text")
