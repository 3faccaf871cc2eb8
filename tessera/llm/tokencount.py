"""Token counts of flat, unindexed token files by a separator scan.

A file is a run of little-endian ids in which each document ends with one separator id; nothing else tells where documents
are.  Files are cut into blocks of equal size without regard to documents.  Each block is read by its byte range and
searched for separators in one vectorised comparison.  A prefix scan over the blocks of a file then gives every block
the number of documents before it and the place of the last separator before it, which stitches the document that
crosses its left border, over any number of blocks without a separator.

The scan runs over one summary row per block.  It is done in two levels, groups of blocks first, so that no task walks
over more than ``GROUP`` blocks and the groups of one file.

Defined results: a null or empty text is a document of no tokens; ids that follow the last separator of a file are a
document that is not ended, with ``ended`` false; an empty file or table gives no rows; rows with equal or null ids
are counted each for themselves; the separator's own text inside a document is encoded as ordinary text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import parts as parts_of
from .bytescan import texts_of
from .tokens import encoder, vocabulary
from .work import put_bytes, scratch, settle, table

SEPARATOR = 50256
BLOCK_TOKENS = 1 << 20
FILE_BYTES = 32 << 20
GROUP = 1024


def write_token_files(docs: DataFrame, spec: bytes, folder: str, separator: int = SEPARATOR, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes flat files of 16-bit ids below folder; returns (file, bytes, doc_ids) with the ids in file order, settled."""
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value, True)
        if max(own.tokenizer.get_vocab_size(), separator + 1) > 1 << 16:
            raise ValueError("the files hold 16-bit ids; this vocabulary needs more")
        parts: list[bytes] = []
        names: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.bin"
            put_bytes(uri, *parts)
            ids = pa.concat_arrays(names)
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), listed], ["file", "bytes", "doc_ids"])

        for first, texts, doc_ids in ((first, texts, batch.column(0)) for batch in batches for first, texts in parts_of(texts_of(batch.column(1)))):
            ids, counts = own.encode(texts)
            raw = np.insert(ids, np.cumsum(counts), separator).astype("<u2").tobytes()
            parts.append(raw)
            names.append(doc_ids.slice(first, len(texts)).cast(pa.int64()))
            size += len(raw)
            if size >= file_bytes:
                yield flush()
                parts, names, size = [], [], 0
        if names:
            yield flush()

    return settle(docs.select("doc_id", "text").mapInArrow(write, "file string, bytes long, doc_ids array<long>"), "token-files")


def document_lengths(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of each document in files (file, bytes): what the separators tell."""
    tokens = (F.col("bytes") / width).cast("long")
    blocks = files.where(F.col("bytes") >= width).select("file", tokens.alias("tokens")).select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("tokens") - 1) / block_tokens).cast("long"))).alias("block"))
    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, total, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                begin, end = block * block_tokens, min((block + 1) * block_tokens, total)
                with store.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at((end - begin) * width, begin * width), f"<u{width}")
                found = np.flatnonzero(ids == separator) + begin
                listed = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([total], pa.int64()), pa.array([block], pa.int64()), listed], ["file", "tokens", "block", "ends"])

    scanned = settle(blocks.repartition(parts, "file", "block").mapInArrow(scan, "file string, tokens long, block long, ends array<long>"), "separators")
    summary = scanned.select("file", "tokens", "block", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last")).withColumn("group", (F.col("block") / GROUP).cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = summary.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over_groups = before(Window.partitionBy("file").orderBy("group"))
    groups = groups.select("file", "group", F.coalesce(F.sum("n").over(over_groups), F.lit(0)).alias("docs_before"), F.max("last").over(over_groups).alias("last_before"))
    inside = before(Window.partitionBy("file", "group").orderBy("block"))
    inner = summary.select("file", "group", "block", "tokens", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own_docs"), F.max("last").over(inside).alias("own_last"), "n", "last")
    carried = inner.join(groups, ["file", "group"]).select("file", "block", (F.col("docs_before") + F.col("own_docs")).alias("docs_before"), F.coalesce("own_last", "last_before", F.lit(-1)).alias("previous"))
    ended = (
        scanned.join(carried, ["file", "block"])
        .select("file", "docs_before", "previous", "ends", F.posexplode("ends").alias("k", "end"))
        .select("file", (F.col("docs_before") + F.col("k")).alias("ordinal"), (F.when(F.col("k") == 0, F.col("previous")).otherwise(F.expr("get(ends, k - 1)")) + 1).alias("start"), "end")
    )
    whole = summary.groupBy("file").agg(F.max("tokens").alias("tokens"), F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(-1)).alias("last")).where("last < tokens - 1")
    open_ = whole.select("file", F.col("n").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended")).unionByName(open_)


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents: written as flat files, found again by their separators alone."""
    files = write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), scratch(spark, "token-files"))
    counted = document_lengths(files.select("file", "bytes")).withColumn("counted", F.lit(True))
    named = files.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id")).withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("named", F.lit(True))
    both = F.when(F.col("counted") & F.col("named"), F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("the separators and the ids disagree in "), "file")).cast("long"))
    return counted.join(named, ["file", "ordinal"], "full").select("doc_id", both.alias("n_tokens"), "file", "ordinal", "start")
