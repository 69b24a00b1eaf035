"""Notes as a stream: new and changed Markdown files are merged into a snapshot batch by batch.

A file source reports no deletions; stale notes leave by the batch path (`Store.index`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.sources.markdown import parse_notes
from quillgraph.sources.store import Store


def markdown_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw, modified) of the Markdown files below a folder that Spark's file source sees."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    root = folder.rstrip("/").removeprefix("file://") + "/"
    rel = F.substring_index(F.col("path"), root, -1)
    return files.select(rel.alias("path"), F.col("content").alias("raw"), F.col("modificationTime").alias("modified"))


def stream_into(stream: DataFrame, store: Store, checkpoint: str, namespaces: dict[str, list[str]] | None = None, now: int = 0) -> StreamingQuery:
    """Starts a query that handles what is there, then stops; call it again for what came since."""

    def merge(batch: DataFrame, _: int) -> None:
        w = Window.partitionBy("path").orderBy(F.desc("modified"))
        latest = batch.withColumn("r", F.row_number().over(w)).filter("r = 1").select("path", "raw")
        if latest.isEmpty():
            return
        parsed = parse_notes(latest, namespaces, now=now)
        visited = store.read("notes").select("path").unionByName(latest.select("path"))
        store.index(parsed, visited=visited)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
