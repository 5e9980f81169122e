"""Usage events as a stream: duplicates within the watermark, conflicting repeats, and visits as session windows.

The jobs end by themselves (``availableNow``) and keep their state in the shared folder, so they take up where they stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from partmill.sources.storage import shared_path
from partmill.streaming.kept import SeenRows

#: Our policy for late events, and the inactivity that ends a visit.
WATERMARK, GAP = "1 hour", "30 minutes"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events from the Parquet files of a folder as they arrive; ``ts`` as an instant."""
    return spark.readStream.schema(SCHEMA).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def first_of_each(events: DataFrame) -> DataFrame:
    """Each event id once; repeats that come later than the watermark can't be told and pass."""
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])


def visits(events: DataFrame) -> DataFrame:
    """(user_id, started_at, events) of each ended session of a user."""
    window = F.session_window("ts", GAP)
    return events.withWatermark("ts", WATERMARK).groupBy("user_id", window).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("started_at"), "events")


def run_once(stream: DataFrame, out: str | None = None, mode: str = "append") -> DataFrame:
    """Works through all that is there, then returns the written table."""
    spark = stream.sparkSession
    out = out or shared_path(spark, "stream-out")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", shared_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def take_events(events: DataFrame, state: str, own: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(taken, rejected) of a stream: each event id once, the first; a repeat with other contents is rejected, one with the same is nothing.

    ``own``: a column that tells events of one id apart, the smaller one first of those of one moment; it belongs to their contents.
    Without it events of one moment come in the order of a digest.

    Ids are kept in buckets with a digest of their contents, so a repeat is told however late it comes; a batch reads only the
    buckets of its ids."""
    spark, schema = events.sparkSession, StructType([*events.schema.fields, StructField("digest", StringType())])
    own_columns = [own] if own else []
    taken, rejected = SeenRows(spark, f"{state}/taken", schema, ["event_id"]), SeenRows(spark, f"{state}/rejected", schema, ["event_id"])

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("digest", _content(*own_columns)).select(schema.fieldNames())
        first = rows.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "event_id"]), F.struct("ts", *own_columns, "digest")).alias("_r")).select("event_id", "_r.*")
        had = taken.before(number, rows, ["digest"]).select(F.col("event_id").alias("_id"), F.col("digest").alias("_had"))
        known = first.join(had, F.col("event_id").eqNullSafe(F.col("_id")), "left")
        accepted = known.select(F.col("event_id").alias("_id"), F.coalesce("_had", "digest").alias("_had"), F.col("_had").isNotNull().alias("_known"))
        taken.add(number, known.where("_had is null").select(schema.fieldNames()))
        others = rows.distinct().join(accepted, F.col("event_id").eqNullSafe(F.col("_id"))).where("digest <> _had")
        rejected.add(number, others.select(schema.fieldNames()))

    events.writeStream.foreachBatch(take).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return taken.read().drop("digest"), rejected.read().drop("digest")


def _content(*more: str) -> Column:
    return F.sha2(F.to_json(F.struct("ts", "user_id", "event_type", "value", "props", *more)), 256)


def conflicting_repeats(events: DataFrame) -> DataFrame:
    """Ids that occur with different contents: an error, not a repeat (batch check of what was taken in)."""
    return events.groupBy("event_id").agg(F.count_distinct(_content()).alias("contents")).where("contents > 1")
