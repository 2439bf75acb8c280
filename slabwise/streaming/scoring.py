"""Scoring of report streams: the row-wise scorers work on a streaming frame as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slabwise.functions import scoring as S


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def score_stream(df: DataFrame, text: str) -> DataFrame:
    """The stream with structure, consistency and uncertainty scores of each report. Stateless."""
    return df.withColumn("structure_score", S.structure_score(text)).withColumn("consistency_score", S.consistency_score(text)).withColumn("uncertainty_score", S.uncertainty_score(text))


def windowed_means(df: DataFrame, time: str, score: str, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """(start, n, mean) per window; rows later than the watermark are dropped."""
    w = df.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    return w.select(F.col("window.start").alias("start"), "n", "mean")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
