"""The live feed: small batches of events for whoever watches, with a count of what a batch had no room for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import exprs

# How often the feed sends, and how many events it sends at most.
EVERY, MOST = "250 milliseconds", 200


def feed_rows(rows: DataFrame) -> DataFrame:
    """What watchers see of classified registry rows: one line of detail of each, never its payload."""
    columns = [c for c in ("id", "type", "direction", "channel", "severity", "passport_id", "occurred_at") if c in rows.columns]
    detail = exprs.feed_text(F.coalesce(F.get_json_object("meta", "$.event"), F.lit(""))) if "meta" in rows.columns else F.lit(None).cast("string")
    return rows.select(*columns, detail.alias("detail"))


class LiveFeed:
    """Sends each micro-batch of a stream: its first `most` rows in order of time, and how many more there were.

    `send(rows, dropped)` gets at most `most` rows and says whether anybody watched.  What became of each batch is written to
    folder/batch=N, so a batch that the engine sends again is counted once.
    """

    def __init__(self, spark: SparkSession, folder: str, send: Callable[[list[Row], int], bool], most: int = MOST) -> None:
        self.spark, self.folder, self.send, self.most = spark, folder.rstrip("/"), send, most

    def batch(self, rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            received = rows.count()
            if not received:
                return
            some = rows.orderBy("occurred_at", "id").limit(self.most).collect()  # `most` rows
            watched = bool(self.send(some, received - len(some)))
        finally:
            rows.unpersist()
        told = [(received, len(some) if watched else 0, received - len(some), 0 if watched else len(some))]
        counts = self.spark.createDataFrame(told, "received long, sent long, dropped long, unwatched long")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = EVERY) -> DataStreamWriter:
        """A writer over classified rows; without `every` it reads what there is and ends."""
        writer = feed_rows(stream).writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)

    def totals(self) -> DataFrame:
        """One row: events received, sent, dropped for want of room, and sent to nobody."""
        rows = self.spark.read.parquet(self.folder)
        return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "sent", "dropped", "unwatched")])
