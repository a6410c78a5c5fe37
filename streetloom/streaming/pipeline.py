"""The same operators over streams: row-local ones unchanged, keyed ones batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from streetloom.operators.normalize import CONTENT, Options, normalize_address


def read_stream(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def normalize_stream(records: DataFrame, out: str, checkpoint: str, options: Options = CONTENT) -> StreamingQuery:
    """Normalise structured records as they arrive; what is there is handled, then the query ends."""
    return normalize_address(records, options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(records: DataFrame, keyed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """A keyed operator over every micro-batch; a repeated batch replaces its own output."""
    def write(batch: DataFrame, batch_id: int) -> None:
        keyed(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
