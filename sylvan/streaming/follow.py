"""A folder of sources followed as a stream: each micro-batch of new files adds its nodes to an index.

A batch writes its own part of the index and overwrites it if it is run again, so every file is in the index once for each
batch that brought it; what is read is the latest. No state is kept beside the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylvan.sources.nodes import extraction
from sylvan.sources.reader import detect_language, extensions, parse_rows

FILES = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, index: str, checkpoint: str, language: str | None = None, once: bool = False, **given) -> StreamingQuery:  # noqa: ANN003
    """Starts the stream; once: it ends when what is there now is read."""
    e = extraction(**given)
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*{" + ",".join(sorted(extensions())) + "}").option("recursiveFileLookup", "true").load(folder)
    sources = files.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), "content")

    def write(batch: DataFrame, number: int) -> None:
        known = batch.withColumn("language", F.lit(language) if language else detect_language("file_path"))
        parse_rows(known, e).sortWithinPartitions("file_path", "node_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{index.rstrip('/')}/batch={number}")

    writer = sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, index: str) -> DataFrame:
    """The nodes of each file as its last batch brought them."""
    rows = spark.read.option("basePath", index).parquet(index)
    last = rows.groupBy("file_path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["file_path", "batch"], "left_semi").drop("batch")
