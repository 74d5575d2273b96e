"""Run a streaming table over everything that is available and read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trialloom.session import scratch


def run_available(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Append to Parquet until the source is drained; progress lives next to the data."""
    spark = stream.sparkSession
    path = path or scratch(spark, "stream-out")
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-progress")
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
