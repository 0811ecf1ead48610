"""An append-only metric log fed by a stream, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def status_counts(steps: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each status in tumbling windows of a stream of steps (ts, status); rows later than `late` are dropped by the watermark."""
    return steps.withWatermark("ts", late).groupBy(F.window("ts", every), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def appended(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch to its own folder, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return metrics.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
