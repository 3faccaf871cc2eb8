"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents.  The queues are dealt to packing partitions so that each partition holds the same
share of every queue's tokens, cut at the token; a partition then fills its windows one after another.  In each window a
source earns its share of the window's tokens; it is served, in turn, once it has earned a piece worth cutting
(``grain`` tokens); what it has not taken yet, or took in advance, stays on its account for the next window.  The
accounts a partition opens with are what the cuts at its start left over, so deficits carry over from one partition to
the next and every window follows the target proportions.

Without ``targets`` each source's target is its own share of all tokens, the only proportions at which all queues end
together.  ``targets`` gives weights for named sources; the others share the remaining weight by size, and where a queue
runs dry the rest keep their proportions to each other.

Queue places come from prefix sums in two levels (buckets of a queue, then documents of a bucket), so no task sorts a
whole queue; a hot source is cut over all partitions.  Plans carry no ids: tokens are written once and meet their
pieces in one join.

Defined results: a null text is an empty one (its end id alone is packed); a null source is a queue of its own; rows with
equal or null ids are packed each for themselves; an empty table gives no pieces; further columns do not matter.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import parts as parts_of
from .bytescan import texts_of
from .tokens import encoder, vocabulary
from .work import settle, table

LENGTH = 1024
PARTITION_TOKENS = 4 << 20
BUCKET_ROWS = 10_000
GRAIN = 128
END_ID = 0


def tokenized(docs: DataFrame, spec: bytes, end_id: int = END_ID) -> DataFrame:
    """(doc_id, source, n, ids) of each document, settled, with a row number ``row``; ids as little-endian 32-bit or 16-bit bytes."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        kind = np.uint16 if own.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32
        for batch in batches:
            for first, texts in parts_of(texts_of(batch.column(1))):
                ids, counts = own.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(kind)
                offsets = np.concatenate(([0], np.cumsum(counts + 1))) * ids.itemsize
                raw = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
                names = (batch.column(k).slice(first, len(texts)) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([*names, pa.array(counts + 1), pa.array(np.full(len(texts), ids.itemsize, np.int32)), raw], ["doc_id", "source", "n", "width", "ids"])

    found = docs.select("doc_id", "text", F.col("source").cast("string").alias("source")).mapInArrow(encode, "doc_id long, source string, n long, width int, ids binary")
    return settle(found.withColumn("row", F.monotonically_increasing_id()), "tokens")


def queue_places(tokens: DataFrame) -> DataFrame:
    """(row, source, n, at, total): where each document stands in its source's queue, in tokens, and the queue's length."""
    light = tokens.select("row", "source", "n")
    buckets = max(1, light.count() // BUCKET_ROWS)
    light = light.withColumn("order", F.xxhash64("row")).withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 1), F.lit(buckets)))
    sums = light.groupBy("source", "bucket").agg(F.sum("n").alias("tokens"))
    queue = Window.partitionBy("source").orderBy("bucket")
    before = sums.select("source", "bucket", (F.sum("tokens").over(queue.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("before"), F.sum("tokens").over(Window.partitionBy("source")).alias("total"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, 0)
    ranked = light.withColumn("run", F.sum("n").over(inside) - F.col("n"))
    same = ranked["source"].eqNullSafe(before["source"]) & (ranked["bucket"] == before["bucket"])
    return ranked.join(before, same).select("row", ranked["source"], "n", (F.col("before") + F.col("run")).alias("at"), "total")


class Schedule:
    """How much of its queue a source has given when a fraction of all tokens is packed."""

    def __init__(self, totals: dict | None, targets: dict[str, float] | None, all_tokens: int):
        self.times, self.given = np.array([0.0, 1.0]), {None: np.array([0.0, 1.0])}
        if not targets:
            return
        left = {s: float(totals.get(s, 0)) for s in targets if totals.get(s, 0)}
        rest = float(all_tokens - sum(left.values()))
        weight = {s: targets[s] for s in left}
        if rest > 0:
            left[None], weight[None] = rest, max(1.0 - sum(targets.values()), 1e-9)
        size, times, given = dict(left), [0.0], {s: [0.0] for s in left}
        while left:
            total = sum(weight[s] for s in left)
            step = min(left[s] * total / weight[s] for s in left)
            times.append(times[-1] + step)
            for s in list(left):
                left[s] -= step * weight[s] / total
                if left[s] <= 1e-6 * size[s]:
                    del left[s]
            for s in given:
                given[s].append((size[s] - left.get(s, 0.0)) / size[s])
        self.times = np.array(times) / times[-1]
        self.given = {s: np.array(g) for s, g in given.items()}

    def share(self, source: str | None, time: np.ndarray) -> np.ndarray:
        """The fraction of the source's queue that is given at each time."""
        return np.interp(time, self.times, self.given.get(source, self.given.get(None)))

    def when(self, source: str | None, share: np.ndarray) -> np.ndarray:
        given = self.given.get(source, self.given.get(None))
        return np.interp(share, given, self.times)


def _cut_queue(source: str | None, at: np.ndarray, n: np.ndarray, total: int, parts: int, plan: Schedule) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, partition, start, length, queue place, earned) of each cut of the documents of one queue."""
    cut = lambda p: np.floor(plan.share(source, np.asarray(p) / parts) * total).astype(np.int64)
    p = np.clip((plan.when(source, at / total) * parts).astype(np.int64), 0, parts - 1)
    while (up := (cut(p + 1) <= at) & (p < parts - 1)).any():
        p[up] += 1
    while (down := cut(p) > at).any():
        p[down] -= 1
    who, pos = np.arange(len(at)), at.copy()
    while len(who):
        end = np.where(p == parts - 1, at[who] + n[who], np.minimum(cut(p + 1), at[who] + n[who]))
        full = end > pos
        yield who[full], p[full], (pos - at[who])[full], (end - pos)[full], pos[full], (plan.share(source, p / parts) * total - cut(p))[full]
        more = end < at[who] + n[who]
        who, pos, p = who[more], end[more], p[more] + 1


def deficit_round_robin(sources: list[np.ndarray], earned: np.ndarray, length: int = LENGTH, grain: int = GRAIN) -> Iterator[tuple[int, int, int, int]]:
    """(queue, tokens taken, window, offset) of each service; sources[i] are the document cuts of queue i, by length.

    Every window pays each queue its share of the window's tokens.  Turns come in the order in which queues have earned a
    piece; a queue takes all that it has earned by then.  Where a window has room left, the queue whose turn is next takes
    a piece in advance, and its account goes below zero.
    """
    left = [int(s.sum()) for s in sources]
    total = sum(left)
    pay = [x / max(total, 1) * length for x in left]
    owed = [float(x) for x in earned]  # what the queue had earned before, less what it has taken
    turns = [((min(grain, left[q]) - owed[q]) / pay[q], q) for q in range(len(left)) if left[q]]
    heapq.heapify(turns)
    window = 0
    while total > 0:
        size = min(length, total)
        room = size
        while room:
            _, q = turns[0]
            take = min(max(int(owed[q] + pay[q] * (window + 1)), min(grain, left[q])), left[q], room)
            yield q, take, window, size - room
            owed[q] -= take
            left[q] -= take
            room -= take
            if left[q]:
                heapq.heapreplace(turns, ((min(grain, left[q]) - owed[q]) / pay[q], q))
            else:
                heapq.heappop(turns)
        total -= size
        window += 1


def _pack(group: pd.DataFrame, length: int, grain: int) -> pd.DataFrame:
    group = group.sort_values(["source", "place"], na_position="first", kind="stable")
    codes, _ = pd.factorize(group["source"], use_na_sentinel=False)
    lengths, starts, rows = group["length"].to_numpy(), group["start"].to_numpy(), group["row"].to_numpy()
    begins = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    bounds = np.concatenate((begins, [len(group)]))
    queues = [lengths[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    at, used = bounds[:-1].copy(), np.zeros(len(queues), dtype=np.int64)
    out = []
    for q, take, window, offset in deficit_round_robin(queues, group["earned"].to_numpy()[begins], length, grain):
        while take:
            k = at[q]
            n = int(min(take, lengths[k] - used[q]))
            if out and out[-1][0] == rows[k] and out[-1][3] == window and out[-1][1] + out[-1][2] == starts[k] + used[q]:
                out[-1][2] += n
            else:
                out.append([rows[k], starts[k] + used[q], n, window, offset])
            offset, take, used[q] = offset + n, take - n, used[q] + n
            if used[q] == lengths[k]:
                at[q], used[q] = k + 1, 0
    found = pd.DataFrame(out, columns=["row", "start", "length", "sequence_id", "offset"])
    found["sequence_id"] += int(group["part"].iloc[0]) << 32
    return found


def pack(docs: DataFrame, spec: bytes, length: int = LENGTH, grain: int = GRAIN, targets: dict[str, float] | None = None, end_id: int = END_ID, partition_tokens: int = PARTITION_TOKENS, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, source, start, length, ids (bytes, null unless asked for), ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = tokenized(docs, spec, end_id)
    all_tokens = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, round(all_tokens / partition_tokens))
    totals = None
    if targets:  # as many rows as there are named sources
        totals = {r["source"]: r["n"] for r in tokens.where(F.col("source").isin(list(targets))).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    plan = Schedule(totals, targets, all_tokens)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, own in batch.groupby("source", dropna=False):
                name = None if pd.isna(source) else source
                for who, p, start, size, place, earned in _cut_queue(name, own["at"].to_numpy(), own["n"].to_numpy(), int(own["total"].iloc[0]), parts, plan):
                    yield pd.DataFrame({"part": p, "source": own["source"].to_numpy()[who], "place": place, "row": own["row"].to_numpy()[who], "start": start, "length": size, "earned": earned})

    cuts = queue_places(tokens).mapInPandas(cut, "part long, source string, place long, row long, start long, length long, earned double")
    pieces = cuts.groupBy("part").applyInPandas(lambda g: _pack(g, length, grain), "row long, start long, length long, sequence_id long, offset long")
    own = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            listed = batch.column(5)
            parents = np.asarray(listed.value_parent_indices())
            fields = [np.asarray(x) for x in listed.flatten().flatten()]
            order = np.lexsort((fields[0], parents))
            parents, (start, size, sequence, offset) = parents[order], [x[order] for x in fields]
            width, raws = np.asarray(batch.column(3)), batch.column(4)
            ids, crcs, last, wide = [], [], -1, b""
            for k, a, n in zip(parents.tolist(), start.tolist(), size.tolist(), strict=True):
                if k != last:
                    last, wide = k, np.frombuffer(raws[k].as_py(), np.uint16 if width[k] == 2 else np.uint32).astype("<u4").tobytes()
                piece = wide[4 * a : 4 * (a + n)]
                ids.append(piece if with_ids else None)
                crcs.append(zlib.crc32(piece))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parents)), batch.column(1).take(pa.array(parents)), pa.array(start), pa.array(size), pa.array(ids, pa.binary()), pa.array(crcs, pa.int64()), batch.column(2).take(pa.array(parents)), pa.array(sequence), pa.array(offset)], names)

    joined = tokens.join(own, "row").select("doc_id", "source", "n", "width", "ids", "pieces")
    return joined.mapInArrow(crc, "doc_id long, source string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op4_deficit_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens in the proportions of their sources."""
    return digest(pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False))
