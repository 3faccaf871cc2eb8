"""Streams into a store: every micro-batch becomes rows of a dataset, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.store import Store


def append_rows(spark: SparkSession, path: str, name: str, rows: DataFrame, batch: int) -> None:
    """Adds a batch as ``name/batch-N``; a batch that is there already (a restart replays its last one) is left alone."""
    with Store.open(spark, path, "a") as store:
        entry = f"{name}/batch-{batch:09d}"
        if entry not in store:
            store.write(entry, rows)


def read_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All batches of a streamed dataset as one frame, with one scan."""
    with Store.open(spark, path, "r", parallel_read=True) as store:
        entries = [store.entry(f"{name}/{k}") for k in store.group(name).keys()]
        return spark.read.schema(entries[0].schema).parquet(*[f"{store.files.root}/{e.data_dir}" for e in entries])


def write_stream(stream: DataFrame, path: str, name: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts the stream; its checkpoint and the names of the batches make each row arrive once."""
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(lambda rows, batch: append_rows(spark, path, name, rows, batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
