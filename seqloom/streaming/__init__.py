"""Specifications over streams: scoring has no state, so a stream of sequences takes the same expressions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import scores
from ..operators.specs import Spec


def read_sequences(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def evaluate(stream: DataFrame, specs: dict[str, Spec], q: str = "q") -> DataFrame:
    """The stream with a score for each specification and all_pass."""
    scored = scores(stream, specs, q)
    passing = F.lit(True)
    for name in specs:
        passing = passing & (F.col(name) >= 0)
    return scored.withColumn("all_pass", passing)


def windowed_pass_rate(stream: DataFrame, specs: dict[str, Spec], time: str, window: str, late: str, q: str = "q") -> DataFrame:
    """n and passed of each time window; rows later than `late` are dropped and state is let go behind the watermark."""
    rows = evaluate(stream.withWatermark(time, late), specs, q)
    return rows.groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.sum(F.col("all_pass").cast("long")).alias("passed"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that writes Parquet once for all files that are there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
