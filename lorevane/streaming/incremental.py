"""Streams over the batch operators: new files, a bounded log, and vectors for what has none.

Each sink handles a batch with the store's own write path, and a batch that comes again changes nothing: imports skip
content they know, retention keeps the same rows, and backfill finds nothing missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lorevane import constants as C
from lorevane.operators.maintain import retain
from lorevane.plans.importing import Encoder, Options
from lorevane.plans.store import Store
from lorevane.sources.files import from_rows


def watch_files(spark: SparkSession, folder: str, store: Store, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Imports what has come into a folder, then stops. A batch imports its own files, under their paths below the folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def sink(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.import_files(from_rows(batch, folder), options or Options())

    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(rows: DataFrame, by: str, order: list[str], target: str, checkpoint: str, keep: int = C.RETENTION) -> StreamingQuery:
    """A stream of rows to a Parquet folder that holds the ``keep`` latest of each group, in numbered versions."""
    spark = rows.sparkSession

    def sink(batch: DataFrame, n: int) -> None:
        old = f"{target}/v{n - 1}"
        p = spark._jvm.org.apache.hadoop.fs.Path(old)
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        every = batch.unionByName(spark.read.parquet(old)) if there else batch
        retain(every, by, keep, *[F.desc(c) for c in order]).write.mode("overwrite").parquet(f"{target}/v{n}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill(chunks: DataFrame, store: Store, encoder: Encoder, checkpoint: str) -> StreamingQuery:
    """Vectors for chunks (id, ...) as they come in: a batch fills what its own chunks lack."""
    def sink(batch: DataFrame, _: int) -> None:
        store.backfill_embeddings(encoder, batch.select("id"))

    return chunks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
