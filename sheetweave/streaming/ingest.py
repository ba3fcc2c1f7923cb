"""Workbooks as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.xlsx import parse_files


def stream_workbooks(spark: SparkSession, folder: str, per_trigger: int = 64) -> DataFrame:
    """Rows of all tables of workbooks as a stream; sources.xlsx.tables() parts them, each by itself or a micro-batch of them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return parse_files(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder))
