"""Reads that arrive in batches: nodes and routes that grow.

The graph of a stream is that of all its reads together: a batch adds its new nodes, routes its own reads, and routes those earlier
reads again on which a new node lies. Each batch writes folders of its own, so that one that is tried again replaces
itself. Of a read that was routed more than once, the latest steps count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequences import K
from ..operators import graph as G
from ..sources.reads import read_sequences


def _table(spark: SparkSession, path: str, name: str, before: int, schema: str) -> DataFrame:
    """What the batches before have written."""
    if before == 0:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/{name}").where(F.col("batch") < before)


def grow(reads: DataFrame, path: str, batch_id: int, k: int = K, sparseness: int = G.SPARSENESS) -> None:
    """Adds a batch of reads (read_id, seq) to the graph at path."""
    spark = reads.sparkSession
    own = f"batch={batch_id}"
    G.filtered(reads, k=k).select("read_id", "seq", "m").write.mode("overwrite").parquet(f"{path}/reads/{own}")
    used = spark.read.parquet(f"{path}/reads/{own}")
    known = _table(spark, path, "nodes", batch_id, "node long, batch int").select("node")
    G.nodes_grid(used, k, sparseness).join(known, "node", "left_anti").write.mode("overwrite").parquet(f"{path}/nodes/{own}")
    fresh = spark.read.parquet(f"{path}/nodes/{own}")
    earlier = _table(spark, path, "reads", batch_id, "read_id long, seq string, m int, batch int").select("read_id", "seq", "m")
    crossed = earlier.join(G.found_kmers(earlier, fresh, k).select("read_id").distinct(), "read_id", "left_semi")
    G.steps(used.unionByName(crossed), known.unionByName(fresh), k).write.mode("overwrite").parquet(f"{path}/steps/{own}")


def steps(spark: SparkSession, path: str) -> DataFrame:
    """The steps of all reads so far."""
    every = spark.read.parquet(f"{path}/steps")
    latest = every.groupBy("read_id").agg(F.max("batch").alias("batch"))
    return every.join(latest, ["read_id", "batch"]).drop("batch")


def routes(spark: SparkSession, path: str) -> DataFrame:
    return G.routes(steps(spark, path))


def ingest(stream: DataFrame, path: str, k: int = K, sparseness: int = G.SPARSENESS, **trigger) -> StreamingQuery:
    """stream: (read_id, seq). Starts a query that grows the graph at path, batch by batch. trigger: as of writeStream.trigger."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}/progress").foreachBatch(lambda df, batch_id: grow(df, path, batch_id, k, sparseness))
    return (writer.trigger(**trigger) if trigger else writer).start()


def ingest_files(spark: SparkSession, folder: str, path: str, files_a_batch: int = 16, k: int = K, sparseness: int = G.SPARSENESS, min_length: int = G.MIN_LENGTH, **trigger) -> StreamingQuery:
    """Grows the graph at path by the sequence files (of one format) that arrive in a folder. A batch takes at most files_a_batch
    files, and the next one starts when it is written, so what is in flight is bounded. Ids: the batch, then the read's."""

    def add(df: DataFrame, batch_id: int) -> None:
        files = [r.file for r in df.select("file").distinct().collect()]  # at most files_a_batch
        if files:
            reads = read_sequences(df.sparkSession, files, min_length)
            grow(reads.withColumn("read_id", F.shiftleft(F.lit(batch_id).cast("long"), 50) + F.col("read_id")), path, batch_id, k, sparseness)

    names = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder).select(F.col("_metadata.file_path").alias("file"))
    writer = names.writeStream.option("checkpointLocation", f"{path}/progress").foreachBatch(add)
    return (writer.trigger(**trigger) if trigger else writer).start()
