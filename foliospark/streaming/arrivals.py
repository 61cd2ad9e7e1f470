"""Files as they arrive: a stream of PDF files into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.kernel.extract import Options
from foliospark.sources import tables

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, path: str, glob: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """(doc_id, path, content) of files as they appear below a folder."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)
    return stream.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def stream_table(spark: SparkSession, path: str, table: str, out: str, checkpoint: str, options: Options = Options(), available_now: bool = True):
    """Append a table's rows for each batch of files; reading again after a loss repeats no file."""
    query = tables.extract(arriving_files(spark, path), table, options).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        query = query.trigger(availableNow=True)
    return query.start(out)
