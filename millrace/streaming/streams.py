"""The same preparation on unbounded tables: fitted steps, de-duplication, buckets, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import text as T
from millrace.plans.pipeline import FittedPrep
from millrace.schema import q


def prepare(stream: DataFrame, fitted: FittedPrep) -> DataFrame:
    """Apply what was learned from a bounded table: row-local, without state."""
    return fitted.apply(stream)


def clean_text(stream: DataFrame, column: str, **options: bool) -> DataFrame:
    return stream.withColumn(column, T.clean(q(column), **options))


def drop_duplicates(stream: DataFrame, keys: list[str], timestamp: str, delay: str = "1 hour") -> DataFrame:
    """First row of each key; state is kept for the delay only."""
    return stream.withWatermark(timestamp, delay).dropDuplicatesWithinWatermark(keys)


def resample(stream: DataFrame, timestamp: str, value: str, span: str = "1 hour", agg_func: str = "sum", delay: str = "1 hour", slide: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Tumbling (or sliding) buckets, emitted once the watermark has passed them."""
    f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[agg_func]
    bucket = F.window(q(timestamp), span, slide) if slide else F.window(q(timestamp), span)
    made = stream.withWatermark(timestamp, delay).groupBy(bucket.alias("w"), *[q(k) for k in keys or []]).agg(f(q(value)).alias(value))
    return made.select(F.col("w.start").alias(timestamp), *[q(k) for k in keys or []], q(value))


def sessions(stream: DataFrame, timestamp: str, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Stretches of events without a longer gap: start, end, n for each key."""
    made = stream.withWatermark(timestamp, delay).groupBy(F.session_window(q(timestamp), gap).alias("s"), *[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return made.select(*[q(k) for k in keys], F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Parquet sink with exactly-once files."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
