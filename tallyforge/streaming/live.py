"""The same tables kept up by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.sources.files import upsert


def daily_counts(events: DataFrame, ts: str, late: str = "2 days") -> DataFrame:
    """date, n of a stream of events. A day stays open until the watermark passes it, so late events still count; later ones are dropped."""
    day = F.window(ts, "1 day")
    return events.withWatermark(ts, late).groupBy(day.alias("_w")).agg(F.count("*").alias("n")).select(F.to_date("_w.start").alias("date"), "n")


def keep_latest(deliveries: DataFrame, table: str, key: str, checkpoint: str) -> StreamingQuery:
    """Run all waiting deliveries into a folder with one row a key, the last delivery winning.

    Each micro-batch writes a whole new version beside the old ones and then adds its number to a list, so readers see whole
    versions only and no moment is without one. A batch that is run again starts from the version before it and writes the
    same rows.
    """
    return deliveries.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, table, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(batch: DataFrame, number: int, table: str, key: str) -> None:
    """One micro-batch of keep_latest."""
    old = current(batch.sparkSession, table, before=number)
    upsert(batch.limit(0) if old is None else old, batch, key).write.mode("overwrite").parquet(f"{table}/v{number}")
    batch.sparkSession.createDataFrame([(number,)], "version bigint").coalesce(1).write.mode("append").json(f"{table}/_versions")


def current(spark, table: str, before: int | None = None) -> DataFrame | None:
    """The last whole version of a kept table, or the last one before a number; None if there is none."""
    try:
        versions = spark.read.schema("version bigint").json(f"{table}/_versions")
        last = (versions if before is None else versions.where(F.col("version") < before)).agg(F.max("version")).first()[0]
    except Exception as e:  # noqa: BLE001 - only a missing path means that there is no version yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return None if last is None else spark.read.parquet(f"{table}/v{last}")
