"""Parsing files as they arrive: stateless per file, so no watermark and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse
from ..options import Options


def stream_documents(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def stream_fields(spark: SparkSession, path: str, options: Options | None = None, **more) -> DataFrame:
    """The long table of fields of every new file."""
    return parse.field_table(stream_documents(spark, path), options, **more)
