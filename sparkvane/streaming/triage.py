"""Triage of a stream: votes by plain signals, and alert rates over tumbling windows with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def decided(events: DataFrame) -> DataFrame:
    """events with three signals as votes and the level they give; the same for a table and a stream."""
    from ..operators.policy import decide

    k = F.get_json_object("props", "$.k").cast("int")
    signals = events.withColumns({"a_pred": (F.col("event_type") == "error").cast("int"), "b_pred": F.coalesce((F.col("value") > 50.0).cast("int"), F.lit(0)), "c_pred": F.coalesce((k >= 50).cast("int"), F.lit(0))})
    return decide(signals, ["a_pred", "b_pred", "c_pred"])


def alert_rates(decided_events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """window_start, threat and n; on a stream, state older than the watermark goes."""
    got = decided_events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "threat").agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("window_start"), "threat", "n")


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files: int | None = None) -> DataFrame:
    """A stream of the event files of a folder, `files` of them at a time if given."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)


def alert_streaks(decided_events: DataFrame, gap: str = "2 hours", late: str = "30 minutes") -> DataFrame:
    """user_id, streak_start, streak_end and n: alerts (above LOW) of a user of which none is more than `gap` after the one before.

    On a stream a repeated event_id counts once, a late event joins or extends the streaks that it falls
    into, and a streak is given once, when the watermark has passed its end (`gap` after its last
    alert); what comes later than that is left out, and streaks still open at the end are not given.
    """
    once = decided_events.withWatermark("ts", late).dropDuplicates(["event_id", "ts"])
    alerts = once.where("threat <> 'LOW' AND user_id IS NOT NULL")
    got = alerts.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("streak_start"), F.col("w.end").alias("streak_end"), "n")


def run_to_folder(stream: DataFrame, folder: str) -> DataFrame:
    """The rows that a stream appends over all that is there now, written with its checkpoint to a folder that is kept: run again it goes on from there."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_to_memory(stream: DataFrame, name: str) -> DataFrame:
    """What the stream gives over all that is there now; for tests and small reports."""
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
