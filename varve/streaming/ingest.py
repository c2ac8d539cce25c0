"""Streams: files into bronze, unreadable rows aside, change files into the dimension.

All run with ``availableNow``: they take what is there, in as many micro-batches as asked,
and stop; a scheduler or a loop starts them again. State lives in the checkpoint folder and
in the target, so a stream that was killed goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from varve.operators import layers
from varve.sources.dimension_store import DimensionStore


def read_files(
    spark: SparkSession, path: str, schema: T.StructType | str, table_format: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """New files under a path as a stream; the schema is declared, never inferred."""
    reader = spark.readStream.format(table_format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _finish(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def to_bronze(stream: DataFrame, target: str, checkpoint: str, batch_id: str) -> StreamingQuery:
    """Append a file stream with lineage columns; each file arrives once."""
    return _finish(
        layers.add_lineage(stream, batch_id).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )


def to_silver(
    stream: DataFrame, fields: list[T.StructField], target: str, rescued: str, checkpoint: str
) -> StreamingQuery:
    """Append rows that conform to one folder and the others, with their raw values, to another.

    Each micro-batch is written under its own number, so repeating one after a failure
    replaces its files instead of adding them twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            good, bad = layers.split_conforming(kept, fields)
            good.write.mode("overwrite").parquet(f"{target}/micro_batch={number}")
            bad.write.mode("overwrite").parquet(f"{rescued}/micro_batch={number}")
        finally:
            kept.unpersist()

    return _finish(
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def to_dimension(stream: DataFrame, store: DimensionStore, checkpoint: str) -> StreamingQuery:
    """Fold a stream of change rows into a type 2 dimension.

    Micro-batches may cut a change batch anywhere: each adds its rows to the log as a part of
    its own, and batches are applied in order when the stream has taken all there is. A
    repeated micro-batch replaces its part, a batch delivered again changes nothing, and new
    rows for a batch that was applied by an earlier run are an error.
    """

    def log(batch: DataFrame, number: int) -> None:
        store.add_part(batch, f"micro_batch_{number}")

    query = _finish(
        stream.writeStream.foreachBatch(log).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    store.close_parts()
    store.apply_pending()
    return query
