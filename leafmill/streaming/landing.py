"""Files and records that arrive over time, as structured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..sources import pdf


def pdf_stream(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """``path, content`` of the PDF files that land in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_batch)
    return read.load(folder).select("path", "content")


def pages_of_stream(files: DataFrame, table: str = "fragments") -> DataFrame:
    """One of the tables of ``sources.pdf`` of every file of a stream."""
    return pdf.read(files, table)


def record_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1_000) -> DataFrame:
    """Records of parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once_in_stream(records: DataFrame, keys: list[str], at: str = "ingested_at", late: str = "7 days") -> DataFrame:
    """Each record once, though it may come twice; what comes later than ``late`` is taken for new."""
    stamped = records.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def arrivals(records: DataFrame, window: str = "1 hour", at: str = "ingested_at", late: str = "1 hour") -> DataFrame:
    """Blocks and characters by source and window of arrival."""
    stamped = records.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, window), "source").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"))


def to_parquet(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A sink that survives restarts; call ``start()``."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
