"""The hourly maximum and first-wins deduplication over a stream of observations: an extension of the batch operators.

When its input ends, the stream has the batch answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_stream(observations: DataFrame, late: str = "2 hours") -> DataFrame:
    """``observations`` (feature_id, observed_at, concurrent): the largest concurrency of each feature and hour.

    Run in ``append`` mode, an hour is written once the watermark has passed it, rows later than ``late`` are dropped and
    state is forgotten. In ``complete`` mode all hours stay in the state: only for bounded inputs.
    """
    known = observations.where("concurrent IS NOT NULL").withWatermark("observed_at", late)
    hours = known.groupBy("feature_id", F.window("observed_at", "1 hour").alias("w")).agg(F.max("concurrent").cast("double").alias("concurrent"))
    return hours.select("feature_id", F.to_date("w.start").alias("date"), F.hour("w.start").alias("hour"), "concurrent")


def first_only(observations: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Repeats within the watermark are dropped; state older than that is forgotten."""
    return observations.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(keys)


def into_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run over what is there and stop. ``complete`` (bounded inputs) replaces the files by each batch's whole result, ``append`` adds what is final."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").start(path)
    return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
