"""Near-duplicate documents by an inverted join on signature coordinates.

*Sets.*  A document's set holds the hashes of its distinct shingles.  Documents with equal sets form one class, whose
smallest id stands for it from there on, so exact copies cost nothing beyond the grouping.

*Inverted join.*  Classes are posted under each (coordinate, value) pair of their MinHash signature of ``coordinates``
values.  Pairs that one class alone holds are dropped.  Two sets above the threshold agree in at least ``T`` coordinates
(``T`` is chosen so that the chance to miss a pair at the threshold itself is below 1e-6).  Each class keeps only
the prefix of its rarest pairs that any partner with ``T`` matches has to touch; a class that shares fewer than ``T``
pairs with others is done.  That is prefix filtering; long posting lists are skipped, as they are last in the order.

*Counting collisions.*  Clusters grow in rounds.  In each round a posting list whose waiting members lie in several clusters
names a leader, out of the cluster that has the fewest members there; members of its other clusters are held against it, and
the equal coordinates are counted.  With ``c`` or more matches a member's cluster joins the leader's.  The leader is done then, and
so is a member with ``c + K - T`` matches: a partner with ``T`` matches to it matches the leader in ``c`` coordinates at
least, so it has joined too.  Lists whose members lie in one cluster are done.  What still lies apart in a list after ``ROUNDS``
leaders is put into one cluster unseen, by an edge per member.  So a round makes at most a row per posting, two sets
with ``T`` matches always end in one cluster, and a cluster that is too large costs work but changes no result.

*Confirming.*  Clusters are cut into blocks of about ``BLOCK_BYTES`` of shingle sets, and the cluster's first member is sent along with
each block.  Within a block, tiles of ``TILE`` sets meet: pairs that are linked already are skipped, in large blocks also pairs with
fewer than ``T`` equal coordinates, and the others' intersections of full sets are one matrix product.  That
settles a group of near copies in one pass, since all of it is linked to what is sent along.  Only where a cluster of several
blocks still falls into several components, the sets outside its largest component meet all other blocks.  Each meeting
returns a spanning forest of the links found, at most one row per member.  Connected components of those links are the answer.

Defined results: null texts and texts without words have an empty set and are linked with nothing; texts with fewer
words than a shingle have their whole word sequence as one shingle; rows with equal ids stay separate rows; null ids
can't name a component unless the component has no other id; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import mix64, parts, spans_hash, texts_of, window_hashes, words_of, _WORD_POWERS
from .components import components
from .work import columns, discard, private, row_key, settle, table

COORDINATES = 64
TILE = 192
BLOCK_BYTES = 4 << 20
ROUNDS = 8
MISS = 1e-6


def least_matches(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest T with P(Binomial(coordinates, threshold) < T) <= miss."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * threshold**t * (1 - threshold) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text's words."""
    if not len(hashes):
        return hashes
    if len(hashes) < size:
        return spans_hash(hashes, np.array([0]), np.array([len(hashes)]), _WORD_POWERS[0])
    return np.unique(window_hashes(hashes, size))


_rng = np.random.default_rng(20240229)
_FACTORS = (_rng.integers(0, 1 << 31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_SHIFTS = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """For each coordinate k the least of (k-th factor * x + k-th shift), posted as (k << 32 | value)."""
    x = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, (_FACTORS[:coordinates, None] * x[None, at : at + 2048] + _SHIFTS[:coordinates, None]).min(axis=1))
    return (np.arange(coordinates, dtype=np.int64) << 32) | out.astype(np.int64)


def _sets(batch: pa.RecordBatch, column: int, size: int) -> Iterator[np.ndarray]:
    for _, texts in parts(texts_of(batch.column(column))):
        words = words_of(texts, lower=True)
        for i in range(len(texts)):
            yield shingle_set(words.hashes[words.first[i] : words.first[i + 1]], size)


def signed_documents(keyed: DataFrame, size: int, coordinates: int) -> DataFrame:
    """(key, doc_id, n, content, pairs) of each row: set size, 128-bit hash of the set, and signature pairs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, content, pairs = [], [], []
            for found in _sets(batch, 2, size):
                n.append(len(found))
                if len(found):
                    with np.errstate(over="ignore"):
                        content.append(np.array([mix64(found).sum(), mix64(found ^ np.uint64(0x5851F42D4C957F2D)).sum()], dtype=np.uint64).tobytes())
                    pairs.append(signature(found, coordinates))
                else:
                    content.append(None)
                    pairs.append(np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in pairs]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pairs) if pairs else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(content, pa.binary()), listed], ["key", "doc_id", "n", "content", "pairs"])

    return keyed.mapInArrow(scan, "key long, doc_id long, n long, content binary, pairs array<long>")


def prefixes(classes: DataFrame, least: int) -> DataFrame:
    """(pair, node): the postings of each class under the rarest of the pairs that it shares with others."""
    posted = classes.select("node", F.explode("pairs").alias("pair"))
    shared = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = posted.join(shared, "pair").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "pair"))).alias("pairs")).where(F.size("pairs") >= least)
    return own.select("node", F.explode(F.slice("pairs", F.lit(1), F.size("pairs") - least + 1)).alias("x")).select(F.col("x.pair").alias("pair"), "node")


def clusters(classes: DataFrame, postings: DataFrame, coordinates: int, least: int) -> DataFrame:
    """(node, root): clusters such that classes with ``least`` matches are always together; root is the smallest node."""
    join = max(coordinates // 6, 1)
    done = min(join + coordinates - least, coordinates)
    waiting = settle(postings, "postings")
    signatures = settle(classes.select("node", "pairs").join(waiting.select("node").distinct(), "node", "left_semi"), "posted")
    theirs = signatures.select(F.col("node").alias("leader"), F.col("pairs").alias("theirs"))
    labels = settle(signatures.select("node", F.col("node").alias("root")), "labels")
    for turn in range(ROUNDS + 1):
        held = waiting.join(labels, "node")
        shares = held.groupBy("pair", "root").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("node"))
        leaders = shares.groupBy("pair").agg(F.min(F.struct("members", "node", "root")).alias("x"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        meet = settle(held.join(leaders.select("pair", F.col("x.node").alias("leader"), F.col("x.root").alias("leader_root")), "pair"), "meet")
        if meet.isEmpty():
            discard(meet)
            break
        apart = meet.where("root != leader_root")
        counted = None
        if turn == ROUNDS:  # what lies apart after all those leaders joins unseen
            edges = apart.select("root", "leader_root").distinct()
        else:
            tried = apart.select("node", "root", "leader", "leader_root").distinct()
            matches = F.size(F.array_intersect("pairs", "theirs"))
            counted = settle(tried.join(signatures, "node").join(theirs, "leader").select("node", "root", "leader", "leader_root", matches.alias("matches")).where(F.col("matches") >= join), "matches")
            edges = counted.select("root", "leader_root")
        joined = components(edges, "root", "leader_root")
        merged = labels.join(joined.select(F.col("node").alias("root"), F.col("root").alias("into")), "root", "left").select("node", F.coalesce("into", "root").alias("root"))
        last, labels = labels, settle(merged, "labels")
        discard(last, joined)
        if counted is None:
            discard(meet)
            break
        finished = counted.where(F.col("matches") >= done).select("node", "leader")
        last, waiting = waiting, settle(meet.where("leader != node").join(finished, ["node", "leader"], "left_anti").select("pair", "node"), "waiting")
        discard(last, meet, counted)
    several = labels.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("root")
    found = settle(labels.join(several, "root", "left_semi").select("node", "root"), "clusters")
    discard(waiting, signatures, labels)
    return found


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of the sorted sets on the left with those on the right, by matrix products."""
    every = [np.concatenate(x) for x in (left, right)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    shared = np.intersect1d(*every)
    sides = []
    for values, of in zip(every, owner, strict=True):
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], of[hit][order]))
    out = np.zeros((len(left), len(right)))
    for first in range(0, len(shared), 4096):
        width = min(4096, len(shared) - first)
        marks = []
        for (at, of), n in zip(sides, out.shape, strict=True):
            low, high = np.searchsorted(at, (first, first + width))
            mark = np.zeros((n, width), dtype=np.float32)
            mark[of[low:high], at[low:high] - first] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return np.rint(out).astype(np.int64)


def _links(nodes: list[int], sides: list[int], groups: list[int], sets: list[np.ndarray], threshold: tuple[int, int], least: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one block, or between its two sides; equal groups are linked already."""
    num, den = threshold
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    label = np.unique(np.array(groups), return_inverse=True)[1]
    signed = np.stack([signature(s).astype(np.uint32) for s in sets]) if len(sets) > TILE else None
    own, other = np.flatnonzero(np.array(sides) == 0), np.flatnonzero(np.array(sides) == 1)
    within = not len(other)
    out = []
    for i in range(0, len(own), TILE):
        a = own[i : i + TILE]
        for j in range(i if within else 0, len(own if within else other), TILE):
            b = (own if within else other)[j : j + TILE]
            open_ = label[a][:, None] != label[b][None, :]
            if signed is not None and open_.any():
                matches = np.zeros(open_.shape, dtype=np.uint8)
                for k in range(signed.shape[1]):
                    matches += signed[a, k][:, None] == signed[b, k][None, :]
                open_ &= matches >= least
            if not open_.any():
                continue
            x, y = a[open_.any(axis=1)], b[open_.any(axis=0)]
            common = _common([sets[k] for k in x], [sets[k] for k in y])
            linked = den * common >= num * (sizes[x][:, None] + sizes[y][None, :] - common)
            for row, k in zip(linked, x, strict=True):
                near = y[row]
                near = near[label[near] != label[k]]
                for old, at in zip(*np.unique(label[near], return_index=True), strict=True):
                    out.append((nodes[k], nodes[near[at]]))
                    label[label == old] = label[k]
    return out


_DEALT = "root long, i int, j int, side int, grouped long, node long, shingles binary"


def _meetings(dealt: DataFrame, threshold: tuple[int, int], least: int) -> DataFrame:
    """(a, b): the links found where rows of one (root, i, j) meet."""
    tasks = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, seen = None, [], set()
        empty = [pa.array([], pa.int64())] * 2

        def flush() -> pa.RecordBatch:
            found = _links(*map(list, zip(*held, strict=True)), threshold, least) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)] if found else empty, ["a", "b"])

        for batch in batches:
            for root, i, j, side, group, node, raw in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (root, i, j) != now:
                    if len(held) > 1:
                        yield flush()
                    now, held, seen = (root, i, j), [], set()
                if node not in seen:  # rows that repeat a row have the same set
                    seen.add(node)
                    held.append((node, side, group, np.frombuffer(raw, dtype=np.uint64)))
        if len(held) > 1:
            yield flush()

    rows = dealt.select(*(x.split()[0] for x in _DEALT.split(", ")))
    return rows.repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(link, "a long, b long")


def _blocks(size: Column) -> Column:
    return F.greatest(F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def confirmed(members: DataFrame, threshold: tuple[int, int], least: int) -> DataFrame:
    """(node, root): components of the links confirmed on full sets; members has root, node, shingles; settled."""
    size = F.octet_length("shingles").cast("long")
    large = settle(members.groupBy("root").agg(F.sum(size).alias("size")).where(F.col("size") > BLOCK_BYTES), "large")
    cut = members.join(large, "root", "left").withColumn("blocks", F.coalesce(_blocks(F.col("size")), F.lit(1)))
    first = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block(F.col("blocks"))))
    dealt = cut.select("root", F.explode(first).alias("i"), F.lit(0).alias("side"), F.col("node").alias("grouped"), "node", "shingles").withColumn("j", F.col("i"))
    links = settle(_meetings(dealt, threshold, least), "links")
    found = components(links)
    if not large.isEmpty():
        rows = members.join(large.select("root"), "root", "left_semi").join(found.select("node", F.col("root").alias("grouped")), "node", "left").select("root", "node", "shingles", F.coalesce("grouped", "node").alias("grouped"))
        parts = rows.groupBy("root", "grouped").agg(F.sum(size).alias("size"))
        whole = parts.groupBy("root").agg(F.max(F.struct("size", "grouped")).alias("most"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        left = whole.select("root", F.col("most.grouped").alias("core"), _blocks(F.col("size") - F.col("most.size")).alias("rests"), _blocks(F.col("most.size")).alias("cores"))
        rest = F.col("grouped") != F.col("core")
        own = F.when(rest, _block(F.col("rests"))).otherwise(F.col("rests") + _block(F.col("cores")))
        others = F.sequence(F.lit(0), F.col("rests") + F.when(rest, F.col("cores")).otherwise(0) - 1)
        cut = rows.join(left, "root").withColumn("own", own).withColumn("o", F.explode(others))
        dealt = cut.select("root", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "grouped", "node", "shingles")
        more = settle(_meetings(dealt, threshold, least), "links")
        last, found = found, components(links.unionByName(more))
        discard(last, more)
    discard(links, large)
    return found


def grouped(docs: DataFrame, size: int, threshold: tuple[int, int], coordinates: int = COORDINATES) -> DataFrame:
    """(key, doc_id, n_shingles, root, component_id) of each row of docs; key is row_key(doc_id, text).

    root tells components apart, as ids can be null or repeated; it is null where a row has an empty set.
    threshold (num, den): sets are linked when den * |intersection| >= num * |union|.
    """
    num, den = threshold
    least = least_matches(num / den, coordinates)
    keyed = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")
    marked = settle(signed_documents(keyed, size, coordinates), "signatures")
    alike = marked.where("n > 0").groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("x"), F.first("n").alias("n"), F.first("pairs").alias("pairs"))
    classes = settle(alike.select("content", "x.doc_id", "x.key", "n", "pairs", F.monotonically_increasing_id().alias("node")), "classes")
    base = settle(marked.drop("pairs"), "contents")
    discard(marked)
    cluster = clusters(classes, prefixes(classes, least), coordinates, least)
    chosen = cluster.join(classes.select("node", "doc_id", "key"), "node").select("node", "root", F.col("doc_id").alias("id"), "key")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for node in batch.column(1).to_pylist():  # of repeated rows, one of each task goes on
                fresh.append(node not in seen)
                seen.add(node)
            batch = batch.filter(pa.array(fresh))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in _sets(batch, 2, size)], pa.binary())], ["root", "node", "shingles"])

    same = (keyed["key"] == chosen["key"]) & keyed["doc_id"].eqNullSafe(chosen["id"])
    texts = keyed.join(chosen, same).select("root", "node", "text")
    members = settle(texts.mapInArrow(shingles, "root long, node long, shingles binary"), "sets")
    linked = confirmed(members, threshold, least)
    discard(members, cluster)
    ids = classes.select("node", "content", "doc_id").join(linked, "node", "left").select("content", "doc_id", F.coalesce("root", "node").alias("root"))
    named = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_content = settle(ids.join(named, "root").select("content", "root", "component_id"), "components")
    discard(classes, linked)
    return (
        base.select("key", "doc_id", "n", "content")
        .join(by_content, "content", "left")
        .select("key", "doc_id", F.col("n").alias("n_shingles"), "root", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def near_duplicates(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100), coordinates: int = COORDINATES) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, kept) of each row of docs; kept marks the rows whose id names their component."""
    return grouped(docs, size, threshold, coordinates).drop("root").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_per_group(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of docs of each group of near-duplicates: smallest id first, nulls last, ties by key; of rows with one key any.

    Rows with an empty set are linked with nothing, so they all stay.
    """
    found = grouped(docs, size, threshold).where("root IS NOT NULL").groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    rows = settle(found, "grouped")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    first = rows.groupBy("root").agg(best.alias("best"), F.sum("times").alias("members")).where("members > 1").select("root", "best")
    is_first = (F.col("key") == F.col("best.key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    key, held, again = private("key", docs), private("id", docs), private("again", docs)
    marked = rows.join(first, "root").where(~is_first | (F.col("times") > 1)).select(F.col("key").alias(key), F.col("doc_id").alias(held), is_first.alias(again))
    marked = settle(marked, "leaving")
    discard(rows)
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    same = (keyed[key] == marked[key]) & keyed["doc_id"].eqNullSafe(marked[held])
    stay = keyed.join(marked, same, "left_anti").select(*columns(docs))
    twice = marked.where(again)
    if twice.isEmpty():
        return stay
    same = (keyed[key] == twice[key]) & keyed["doc_id"].eqNullSafe(twice[held])
    copies = keyed.join(twice, same, "left_semi").dropDuplicates([key, "doc_id"])
    return stay.unionByName(copies.select(*columns(docs)))


def op3_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, Jaccard similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, (85, 100)).select("doc_id", "n_shingles", "component_id", "kept")
