"""Subtitle files as they arrive: the batch parsers over a folder stream, and the tables they feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuelake.functions import text as X
from cuelake.sources import subtitles

BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files under folder, as ``subtitles.scan`` gives them."""
    rows = spark.readStream.schema(BINARY).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select(F.regexp_replace("path", "/[^/]*$", "").alias("title_id"), "path", X.file_extension(F.col("path")).alias("extension"), subtitles.decode_bytes(F.col("content")).alias("content"))


def ingest(spark: SparkSession, folder: str, cues_path: str, rejects_path: str, checkpoint: str) -> StreamingQuery:
    """Parse what is there and stop. A micro-batch that runs again replaces what its first try wrote."""

    def write(files: DataFrame, number: int) -> None:
        cues, rejects = subtitles.parse(files)
        for rows, path in ((cues, cues_path), (rejects, rejects_path)):
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return file_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
