"""Reports as they arrive: each batch of files goes through the same plan. Beyond what a batch run needs; stateless but for dropping repeated uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labflow.sources.ingest import SCHEMA


def stream(spark: SparkSession, path: str, analyze: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Analyze JSON ingestion records under path and append the result as Parquet; a document id that came before within a day is dropped."""
    rows = spark.readStream.schema(SCHEMA).json(path).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["doc_id"])
    query = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: analyze(batch.drop("arrived")).write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return (query.trigger(availableNow=True) if once else query).start()
