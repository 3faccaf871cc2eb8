"""Language identification with string kernels.

*Kernel.*  A text is the set of its n-grams of 1 to ``LONGEST`` characters (the blended spectrum, presence only, lower case,
hashed to ``2**BITS`` places).  The kernel of a text x and a landmark l is the number of n-grams that both hold, divided by
the square root of the product of their set sizes, where sets are taken within the n-grams of all landmarks.

*Nyström landmarks.*  ``LANDMARKS`` texts of the training sample, spread evenly over the languages, stand for the
whole kernel matrix.  *One-versus-rest kernel ridge regression* gives a column of weights per language.

*Scoring.*  A batch of texts becomes a presence matrix P over the landmarks' n-grams.  With the landmarks' presence
matrix L and the weights A, the scores are (P L') A scaled by set sizes, computed as P (L' A) since matrix products
may be bracketed freely: one product of the batch with a narrow matrix.

*Evidence.*  Scores compare languages with each other: the margins of L languages add up to about 2 - L for any text, so the
best score is at least about 1/L, whatever the text is.  A text fits its language only if enough of its longer n-grams
(``LONGEST`` - 1 and ``LONGEST`` characters) occur in landmarks at all.  How many are enough is learned per language: ``SLACK``
times the share that all but ``OUTLIERS`` of its training texts reach, where no text counts as its own landmark.

The training sample is bounded: ``SAMPLE`` rows per language, ``TRAIN_ROWS`` of all, those with the smallest hashes of their ids
and one of each id; ``LANGUAGES`` languages, those with most rows.  There is a landmark of each language at least.  The model
is bounded by ``CELLS``: where languages are many, the kernel is taken within the n-grams with the smallest hashes.

Defined results: ``und`` with score 0 where the text is null or has no letter (Unicode category L; number forms such as
``½`` and ``Ⅷ`` are none), or where nothing could be learned; null
languages are not learned from; a null id is never held out and never learned from; rows with equal ids are predicted each
for themselves; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import Texts, mix64, pieces, texts_of
from .charscan import lowered, ngram_hashes
from .work import smallest_hashes, table

LONGEST = 4
BITS = 22
SAMPLE = 400
TRAIN_ROWS = 12_000
LANGUAGES = 1200
CELLS = 1 << 24
LANDMARKS = 120
RIDGE = 1e-3
UNKNOWN = "und"
BATCH = 64
MIN_SCORE = 0.25
SLACK = 1 / 3
OUTLIERS = 0.05
#: n-grams that every text is taken to know, so that a few characters are no evidence against it.
PRIOR = 8


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def presence(texts: Texts, places: np.ndarray, out: np.ndarray, evidence: np.ndarray | None = None) -> None:
    """Sets out[i, v] where text i holds the n-gram of column v; places maps hashes to columns, the last column is waste.

    evidence[i] grows by the occurrences of known longer n-grams and of all longer n-grams.
    """
    for points, owners, begins in lowered(texts, LONGEST - 1):
        for n in range(1, LONGEST + 1):
            hashes, at = ngram_hashes(points, begins, n, BITS)
            column = places[hashes]
            of = np.repeat(owners, np.diff(np.append(at, len(hashes))))
            out[of, column] = 1
            if evidence is not None and n >= LONGEST - 1:
                evidence[:, 0] += np.bincount(of[column < out.shape[1] - 1], minlength=len(evidence))
                evidence[:, 1] += np.bincount(of, minlength=len(evidence))


def gram_sets(texts: Texts) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for points, owners, begins in lowered(texts, LONGEST - 1):
        for n in range(1, LONGEST + 1):
            hashes, at = ngram_hashes(points, begins, n, BITS)
            for owner, a, b in zip(owners, at, np.append(at[1:], len(hashes)), strict=True):
                found[owner].append(np.unique(hashes[a:b]))
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint32) for x in found]


def long_grams(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct longer n-grams of each text and how often it holds them."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for points, owners, begins in lowered(texts, LONGEST - 1):
        for n in (LONGEST - 1, LONGEST):
            hashes, at = ngram_hashes(points, begins, n, BITS)
            for owner, a, b in zip(owners, at, np.append(at[1:], len(hashes)), strict=True):
                found[owner].append(hashes[a:b])
    return [np.unique(np.concatenate(x or [np.zeros(0, np.uint32)]), return_counts=True) for x in found]


def _among(columns: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The places in columns of those of the sorted values own that it holds."""
    at = np.minimum(np.searchsorted(columns, own), len(columns) - 1)
    return at[columns[at] == own]


def known_share(known: np.ndarray, total: np.ndarray) -> np.ndarray:
    return (known + PRIOR) / (total + PRIOR)


def least_known(longer: list[tuple[np.ndarray, np.ndarray]], of: np.ndarray, sets: list[np.ndarray], chosen: list[int], columns: np.ndarray) -> list[float]:
    """Per language the share of known longer n-grams that a text needs; landmarks are held against the others only."""
    holders = np.zeros(len(columns), dtype=np.int64)
    for i in chosen:
        holders[_among(columns, sets[i])] += 1
    own, shares = set(chosen), np.ones(len(longer))
    for i, (grams, times) in enumerate(longer):
        at = np.minimum(np.searchsorted(columns, grams), len(columns) - 1)
        others = np.where(columns[at] == grams, holders[at], 0) - (i in own)
        shares[i] = known_share(times[others > 0].sum(), times.sum())
    return [float(SLACK * np.quantile(shares[of == k], OUTLIERS)) for k in range(of.max() + 1)]


def fit(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, longer: list[tuple[np.ndarray, np.ndarray]] | None = None) -> dict:
    """The model of the training sample: hashes of the columns, L' A, the languages and, from longer, what texts have to know."""
    labels = sorted(set(langs))
    of = np.array([labels.index(x) for x in langs], dtype=np.int64)
    turns = np.zeros(len(langs), dtype=np.int64)
    for k in range(len(labels)):
        turns[of == k] = np.arange((of == k).sum())
    chosen = [i for i in np.lexsort((of, turns)) if len(sets[i])][: max(landmarks, len(labels))]
    if not chosen:
        return {"hashes": b"", "matrix": b"", "languages": []}
    columns = np.unique(np.concatenate([sets[i] for i in chosen]))
    if len(columns) > CELLS // max(len(labels), len(chosen) // 8):
        columns = np.sort(columns[np.argsort(mix64(columns.astype(np.uint64)), kind="stable")[: CELLS // max(len(labels), len(chosen) // 8)]])
    mark = np.zeros((len(chosen), len(columns)), dtype=np.float32)
    for row, i in enumerate(chosen):
        mark[row, _among(columns, sets[i])] = 1
    mark /= np.sqrt(np.maximum(mark.sum(axis=1, keepdims=True), 1))
    kernel = np.zeros((len(sets), len(chosen)))
    for i, own in enumerate(sets):
        at = _among(columns, own)
        if len(at):
            kernel[i] = mark[:, at].sum(axis=1) / np.sqrt(len(at))
    inner = kernel[chosen]
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate((kernel @ root, np.ones((len(sets), 1))), axis=1)
    weight = np.sqrt(len(sets) / (len(labels) * np.bincount(of, minlength=len(labels))[of]))[:, None]
    target = np.where(of[:, None] == np.arange(len(labels))[None, :], 1.0, -1.0)
    x = features * weight
    solved = np.linalg.solve(x.T @ x + ridge * len(sets) * np.eye(x.shape[1]), x.T @ (target * weight))
    return {"hashes": columns.astype("<u4").tobytes(), "matrix": (mark.T @ (root @ solved[:-1])).astype("<f4").tobytes(), "bias": solved[-1].tolist(), "languages": labels, "least": least_known(longer, of, sets, chosen, columns) if longer else []}


def train(docs: DataFrame, sample: int = SAMPLE, rows: int = TRAIN_ROWS) -> dict:
    """The model from (doc_id, text, lang), without the rows that are held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    ids = smallest_hashes(known.select("lang", "doc_id"), "doc_id", sample, rows, "lang", LANGUAGES)
    # one row of each id: of rows that share it, that whose text has the smallest hash
    found = known.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))
    rows_ = found.select("doc_id", "lang", F.col("x.text").alias("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                part = batch.slice(first, BATCH)
                texts = texts_of(part.column(2))
                longer = long_grams(texts)
                columns = ([s.tobytes() for s in x] for x in ([s.astype("<u4") for s in gram_sets(texts)], [g.astype("<u4") for g, _ in longer], [t.astype("<u4") for _, t in longer]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.binary()) for c in columns)], ["doc_id", "lang", "grams", "longer", "times"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        sets, longer = [np.frombuffer(x[2], "<u4") for x in found], [(np.frombuffer(x[3], "<u4"), np.frombuffer(x[4], "<u4")) for x in found]
        model = fit(sets, [x[1] for x in found], longer=longer) if found else {"hashes": b"", "matrix": b"", "languages": []}
        yield pa.RecordBatch.from_arrays([pa.array([model["hashes"]], pa.binary()), pa.array([model["matrix"]], pa.binary()), pa.array([model.get("bias", [])], pa.list_(pa.float64())), pa.array([model["languages"]], pa.list_(pa.string())), pa.array([model.get("least", [])], pa.list_(pa.float64()))], ["hashes", "matrix", "bias", "languages", "least"])

    found = rows_.mapInArrow(grams, "doc_id long, lang string, grams binary, longer binary, times binary").repartition(1).mapInArrow(learn, "hashes binary, matrix binary, bias array<double>, languages array<string>, least array<double>").first()
    return found.asDict() if found else {"hashes": b"", "matrix": b"", "bias": [], "languages": [], "least": []}


class Scorer:
    """Predicts batches of texts with a model."""

    def __init__(self, model: dict):
        self.languages = list(model["languages"])
        hashes = np.frombuffer(model["hashes"], "<u4")
        self.width = len(hashes)
        self.places = np.full(1 << BITS, self.width, dtype=np.int32)
        self.places[hashes] = np.arange(self.width)
        if self.languages:
            self.matrix = np.frombuffer(model["matrix"], "<f4").reshape(self.width, len(self.languages))
            self.bias = np.array(model["bias"])
            self.least = dict(zip(self.languages, model["least"], strict=True))

    def fits(self, texts: Texts) -> np.ndarray:
        """Whether each text has a language, by its score and by the n-grams it shares with landmarks."""
        evidence = np.zeros((len(texts), 2))
        names, scores = self.predict(texts, evidence)
        least = np.array([2.0 if name == UNKNOWN else self.least[name] for name in names])
        return (scores >= MIN_SCORE) & (known_share(evidence[:, 0], evidence[:, 1]) >= least)

    def predict(self, texts: Texts, evidence: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        block = np.zeros((BATCH, self.width + 1), dtype=np.float32)
        for first in range(0, len(texts), BATCH):
            last = min(first + BATCH, len(texts))
            part = Texts(texts.data[texts.offsets[first] : texts.offsets[last]], texts.offsets[first : last + 1] - texts.offsets[first], texts.is_null[first:last])
            block[:] = 0
            presence(part, self.places, block, None if evidence is None else evidence[first:last])
            found = block[: last - first, : self.width]
            size = found.sum(axis=1)
            margins = (found @ self.matrix) / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
            best = margins.argmax(axis=1)
            for i in range(first, last):
                if not texts.is_null[i] and any(c.isalpha() for c in texts.text(i)):
                    names[i] = self.languages[best[i - first]]
                    scores[i] = min(1.0, max(0.0, (1 + margins[i - first, best[i - first]]) / 2))
        return names, scores


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: dict) -> Scorer:
    key = hash(model["matrix"])
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score of each text; columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = own.index("text")
    slim = docs.select(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, at):
            names, scores = _scorer(held.value).predict(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*own, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, *added]))


def in_a_language(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs whose text fits one of the model's languages."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, at):
            yield batch.filter(pa.array(_scorer(held.value).fits(texts)))

    return docs.mapInArrow(run, docs.schema)


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return identified(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
