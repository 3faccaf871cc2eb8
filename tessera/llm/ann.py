"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

*Building.*  Vectors are dealt to shards by the hash of their id: ``SHARDS`` of them, of ``LEAST_ROWS`` vectors at least and of
``MOST_ROWS`` or ``SHARD_BYTES`` at most, after which their number grows.  A shard starts from a random
graph; its points are then inserted again in batches: a greedy beam search from the medoid and a few random points proposes neighbours, and
relaxed distance pruning (keep the nearest, drop what is ``ALPHA`` times nearer to it than to the point, go on) keeps
``DEGREE`` diverse ones.  Reverse edges are added and pruned alike.  Each point is inserted twice, first with a factor
of 1.  Every shard is a file in the shared folder, and the index is a table that names the files.

*Searching.*  Queries are written once, in blocks.  Each task takes one shard (mapped into memory where the store is a local
one) and one block, and runs a beam search of width ``BEAM`` (times the root of the shard's size in ``LEAST_ROWS``) from several points; the beam's vectors are measured in double precision, the best
``k`` of each shard go on, and the best of all shards are ranked.

Equal vectors are one point that carries the smallest ids of its rows, as many as a result can name, so a very
common vector neither crowds the graph nor loses a result.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids;
vectors of different lengths are no candidates for each other; each row is a candidate and, if asked for, a query of its own,
rows with an id in common included, so an id can be named twice and equal rows name each other; ties go to
the smaller id; with fewer candidates than asked for all are returned; an empty table gives no rows; further columns do not
matter.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import mapped, put_bytes, scratch, settle, table

SHARDS = 64
LEAST_ROWS, MOST_ROWS = 4096, 1 << 16
SHARD_BYTES = 64 << 20
DEGREE = 40
ALPHA = 1.2
BUILD_BEAM = 64
#: In a shard of LEAST_ROWS; wider in larger ones, with the root of their size.
BEAM = 112
STARTS = 31
EXPAND = 4
INSERT = 512
QUERY_BLOCK = 1 << 16
#: Cells of the table of visited points that a batch of searches holds.
SEEN_CELLS = 1 << 26
QUERY_EVERY = 50


def _distances(queries: np.ndarray, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return 1.0 - np.matmul(points[ids], queries[:, :, None])[:, :, 0]


def beam_search(points: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each query, nearest first: ids (-1 where it is not full) and cosine distances; all queries step together."""
    m, n = len(queries), len(points)
    beam = min(beam, n)
    starts = starts[:beam]
    entries = 1.0 - queries @ points[starts].T
    near = np.argsort(entries, axis=1, kind="stable")
    ids = np.full((m, beam), -1, dtype=np.int64)
    far = np.full((m, beam), np.inf, dtype=np.float32)
    ids[:, : len(starts)], far[:, : len(starts)] = starts[near], np.take_along_axis(entries, near, axis=1)
    done = np.zeros((m, beam), dtype=bool)
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, starts] = seen[:, n] = True
    live = np.arange(m)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        some = open_.any(axis=1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        turn = np.cumsum(open_, axis=1)
        take = open_ & (turn <= expand)
        done[live] |= take
        row, col = np.nonzero(take)
        chosen = np.full((len(live), expand), -1, dtype=np.int64)
        chosen[row, turn[row, col] - 1] = ids[live[row], col]
        near = np.where(chosen[:, :, None] >= 0, graph[chosen], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[live[:, None], near], n, near)
        seen[live[:, None], near] = True
        width = int((near < n).sum(axis=1).max(initial=0))
        near.sort(axis=1)
        near = near[:, : max(width, 1)]
        new = np.where(near < n, _distances(queries[live], points, np.minimum(near, n - 1)), np.inf).astype(np.float32)
        all_far = np.concatenate((far[live], new), axis=1)
        all_ids = np.concatenate((ids[live], np.where(near < n, near, -1)), axis=1)
        all_done = np.concatenate((done[live], np.zeros_like(near, dtype=bool)), axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[live], ids[live], done[live] = (np.take_along_axis(x, order, axis=1) for x in (all_far, all_ids, all_done))
    return ids, far


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse neighbours of each of the points ``own`` among its candidates (-1 for none), padded with -1."""
    rows = np.arange(len(own))
    candidates = np.sort(np.where(candidates == own[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    vectors = points[candidates]
    far = np.where(candidates >= 0, 1.0 - np.matmul(vectors, points[own][:, :, None])[:, :, 0], np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(far, order, axis=1)
    vectors = points[candidates]
    between = 1.0 - np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = candidates >= 0
    out = np.full((len(own), degree), -1, dtype=np.int64)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = candidates[rows[some], first[some]]
        alive &= alpha * alpha * between[rows, first] > far
        alive[rows, first] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each unit vector (-1 for none), and where searches start: the medoid and ``STARTS`` random points.

    The medoid alone may lie in a cluster of near copies wider than a beam, out of which a search finds no way.
    """
    n = len(points)
    rng = np.random.default_rng(seed)
    start = np.array([(points @ points.mean(axis=0)).argmax()])
    start = np.unique(np.concatenate((start, rng.permutation(n)[:STARTS])))
    graph = rng.integers(0, max(n, 1), (n, degree), dtype=np.int32)
    graph[graph == np.arange(n)[:, None]] = -1
    if n <= degree + 1:
        graph = np.tile(np.arange(n), (n, 1))
        graph = np.where(graph == np.arange(n)[:, None], -1, graph)
        return np.pad(graph, ((0, 0), (0, degree - graph.shape[1])), constant_values=-1) if graph.shape[1] < degree else graph, start
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        step = min(INSERT, max(SEEN_CELLS // n, 32))
        for at in range(0, n, step):
            own = order[at : at + step]
            found, _ = beam_search(points, graph, start, points[own], beam)
            graph[own] = robust_prune(points, own, np.concatenate((found, graph[own]), axis=1), factor, degree)
            to = graph[own].ravel()
            source = np.repeat(own, degree)[to >= 0]
            to = to[to >= 0]
            back = np.lexsort((1.0 - np.einsum("ij,ij->i", points[to], points[source]), to))
            to, source = to[back], source[back]
            heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            place = np.arange(len(to)) - np.repeat(heads, np.diff(np.append(heads, len(to))))
            few = place < degree
            extra = np.full((len(heads), degree), -1, dtype=np.int64)
            extra[np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(to))))[few], place[few]] = source[few]
            targets = to[heads]
            for part in range(0, len(targets), INSERT):
                own_ = targets[part : part + INSERT]
                graph[own_] = robust_prune(points, own_, np.concatenate((graph[own_], extra[part : part + INSERT]), axis=1), factor, degree)
    return graph, start


def valid_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, dim, vector) of the rows that take part."""
    base = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return base.where(fine).select("id", F.size("vector").alias("dim"), "vector")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one length as rows, in double precision; rows whose norm would leave the range are scaled."""
    raw = np.asarray(pa.concat_arrays([c.flatten() for c in column.chunks]), dtype=np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", under="ignore"):
        squares = np.einsum("ij,ij->i", raw, raw)
    odd = ~np.isfinite(squares) | (squares < 1e-290)
    if odd.any():
        raw = raw.copy()
        raw[odd] /= np.abs(raw[odd]).max(axis=1, keepdims=True)
    return raw


_HEAD = "<5q"


def build_index(valid: DataFrame, k: int, folder: str | None = None, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The settled index, a row per shard: (dim, shard, file, n); its files lie below folder.  valid is (id, dim, vector)."""
    folder = folder or scratch(valid.sparkSession, "graphs")
    ranked = valid.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("rank") <= k + 1)
    nodes = settle(ranked.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "nodes")
    most = F.least(F.lit(MOST_ROWS), F.greatest(F.lit(SHARD_BYTES / 4) / F.col("dim"), F.lit(1)))
    rows = F.least(most, F.greatest(F.lit(least_rows), F.col("n") / SHARDS))
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / rows).cast("int").alias("shards"))

    def build(part: pa.Table) -> pa.Table:
        order = np.argsort([x[0] for x in part["ids"].to_pylist()], kind="stable")
        part = part.take(pa.array(order))
        dim, shard = part["dim"][0].as_py(), part["shard"][0].as_py()
        raw = _matrix(part["vector"], dim)
        points = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
        graph, start = build_graph(points)
        ids = part["ids"].to_pylist()
        counts, flat = np.array([len(x) for x in ids], "<i8"), np.array([i for x in ids for i in x], "<i8")
        uri = f"{folder}/shard-{dim}-{shard}-{uuid.uuid4().hex}.bin"
        put_bytes(uri, struct.pack(_HEAD, len(raw), dim, graph.shape[1], len(start), len(flat)), raw.astype("<f8").tobytes(), counts.tobytes(), flat.tobytes(), start.astype("<i8").tobytes(), graph.astype("<i4").tobytes())
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [uri], "n": pa.array([len(raw)], pa.int64())})

    dealt = nodes.join(sizes, "dim").select("dim", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("shards")).cast("int").alias("shard"), "vector", "ids")
    tasks = _tasks(valid.sparkSession, sizes.agg(F.sum("shards")).first()[0])
    return settle(dealt.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, file string, n long"), "graphs")


def _tasks(spark: SparkSession, groups: int | None) -> int:
    """Partitions for this many groups of much work and few rows, which Spark would put together for their size."""
    return max(min(4 * (groups or 0), 1 << 15), int(spark.conf.get("spark.sql.shuffle.partitions")), 2)


class Shard:
    """One shard of the index, read from its file."""

    def __init__(self, uri: str):
        data = mapped(uri)
        n, dim, degree, starts, total = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)

        def part(kind: str, size: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, size, at)
            at += found.nbytes
            return found

        self.raw = part("<f8", n * dim).reshape(n, dim)
        self.counts = part("<i8", n)
        self.ids = part("<i8", total)
        self.starts = part("<i8", starts)
        self.graph = part("<i4", n * degree).reshape(n, degree)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.norms = np.linalg.norm(self.raw, axis=1)
        self.points = (self.raw / self.norms[:, None]).astype(np.float32)

    def nearest(self, own: int, q: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows on the beam, without one row that has the query's id and vector."""
        length = np.sqrt(q @ q)
        score = (self.raw[found] * q).sum(axis=1) / (self.norms[found] * length)
        order = np.lexsort((self.ids[self.first[found]], -score))[: k + 1]
        best, score = found[order], score[order]
        rows = [self.ids[self.first[b] : self.first[b + 1]] for b in best]
        for j in np.flatnonzero((self.raw[best] == q).all(axis=1)):
            at = np.flatnonzero(rows[j] == own)
            if len(at):
                rows[j] = np.delete(rows[j], at[0])
                break
        ids, scores = np.concatenate(rows), np.repeat(score, [len(r) for r in rows])
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, folder: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each query (id, dim, vector) other than its own row."""
    spark = queries.sparkSession
    folder = folder or scratch(spark, "queries")
    sizes = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))

    def write(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        uri = f"{folder}/block-{uuid.uuid4().hex}.bin"
        put_bytes(uri, *(np.asarray(part[n].combine_chunks()).astype("<i8").tobytes() for n in ("q", "id")), _matrix(part["vector"], dim).astype("<f8").tobytes())
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([part["block"][0].as_py()], pa.int32()), "queries": [uri], "m": pa.array([part.num_rows], pa.int64())})

    asked = queries.withColumn("q", F.monotonically_increasing_id()).join(sizes, "dim").select("dim", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("block"), "q", "id", "vector")
    blocks = settle(asked.groupBy("dim", "block").applyInArrow(write, "dim int, block int, queries string, m long"), "query-blocks")
    meetings = settle(index.join(blocks, "dim").select("file", "queries", "m", "dim", "shard", "block"), "meetings")  # a row per shard and block
    tasks = _tasks(spark, meetings.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["q", "query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            for uri, queries_, m, dim in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                shard, data = Shard(uri), mapped(queries_)
                numbers, own = np.frombuffer(data, "<i8", m), np.frombuffer(data, "<i8", m, 8 * m)
                vectors = np.frombuffer(data, "<f8", m * dim, 16 * m).reshape(m, dim)
                step = min(INSERT, max(SEEN_CELLS // len(shard.raw), 32))
                wide = max(int(beam * max(1.0, (len(shard.raw) / LEAST_ROWS) ** 0.5)), 2 * k)
                for at in range(0, m, step):
                    q = vectors[at : at + step]
                    found, _ = beam_search(shard.points, shard.graph, shard.starts, (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32), wide)
                    near = [shard.nearest(own[at + i], q[i], found[i][found[i] >= 0], k) for i in range(len(q))]
                    size = [len(x[0]) for x in near]
                    columns = [np.repeat(numbers[at : at + step], size), np.repeat(own[at : at + step], size), np.concatenate([x[0] for x in near]), np.concatenate([x[1] for x in near])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = meetings.repartition(tasks, "dim", "shard", "block").mapInArrow(run, "q long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest embeddings of every embedding whose id is divisible by 50."""
    valid = settle(valid_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return search(build_index(valid, 5), valid.where(F.col("id") % QUERY_EVERY == 0), 5)
