"""The row-wise operators on a stream; they hold no state, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.clean import clean
from corpusloom.functions.markdown import density_score


def cleaned_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of (…, text) as they arrive, cleaned and scored."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withColumn("text", clean(F.col("text"))).withColumn("score", density_score(F.col("text")))


def write_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
