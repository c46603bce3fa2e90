"""Landing of a live feed: arrival is stamped, lines are stored as they came, and only then parsed.

The first stream writes the raw layout that ``feeds.read_raw`` reads: gzip text below ``venue=/day=/hour=``, a line for each message.  The
file sink enters a micro-batch's files in its log once they are complete, so a line lands exactly once, whatever restarts.  The second
stream reads what the log holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feeds import split_lines

LAYOUT = "value string, venue string, day string, hour string"


def raw_lines(feed: DataFrame, arrival: str | None = None) -> DataFrame:
    """value, venue, day, hour of messages (venue, conn_id, raw): tab-separated arrival, wall time, connection and message, whose line breaks
    become spaces.  ``arrival`` names the column of a recorded feed that has arrival stamps (ns); a live one is stamped here."""
    now = F.unix_micros(F.current_timestamp()) * 1000
    at = F.col(arrival) if arrival else now
    stamped = feed.withColumn("__at", at.cast("long")).withColumn("__time", F.timestamp_micros(F.expr("__at DIV 1000")))
    line = F.concat_ws("\t", F.col("__at").cast("string"), (F.col("__at") if arrival else now).cast("string"), "conn_id", F.regexp_replace("raw", r"[\r\n]+", " "))
    return stamped.select(line.alias("value"), "venue", F.date_format("__time", "yyyyMMdd").alias("day"), F.date_format("__time", "HH").alias("hour"))


def land(feed: DataFrame, root: str, checkpoint: str, arrival: str | None = None) -> StreamingQuery:
    """Starts the landing of a stream of messages below ``root``; it goes on where ``checkpoint`` ends, and stops when all is landed that is there."""
    lines = raw_lines(feed, arrival)
    return lines.writeStream.outputMode("append").format("text").option("compression", "gzip").option("path", root).option("checkpointLocation", checkpoint).partitionBy("venue", "day", "hour").trigger(availableNow=True).start()


def landed_messages(spark: SparkSession, root: str, files: int = 64) -> DataFrame:
    """The landed lines as a stream: venue, day, hour, ts_local_ns, ts_wall_ns, conn_id, raw."""
    lines = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", files).text(root)
    return split_lines(lines, keep=["venue", "day", "hour"])
