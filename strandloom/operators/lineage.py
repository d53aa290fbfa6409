"""Intermediate tables in the folder that all executors share, and functions over Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_OWN: list[str] = []
#: Rows of a batch that an operator gives out.
GIVEN = 200_000
#: Bytes a core (as planned, compressed) from which on a table's own splits are enough for all cores.
SPLIT = 1 << 27


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the master is local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="strandloom-"))
    return _OWN[0]


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder, where its lineage ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df, if `cut` made it, else cut."""
    return df if hasattr(df, "table_path") else cut(df, name)


def freed(spark: SparkSession) -> None:
    """Asks both collectors, so that Spark removes the shuffle files of queries that are over; else they stay until the driver's
    memory happens to get short. Spark's scheduler holds on to the last job until the next one, so a small one goes first."""
    gc.collect()
    spark.range(1)._jdf.javaRDD().count()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `cut` made and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt among all cores, if it lies in fewer files than there are cores and is too small to be split by
    its row groups; other tables as they are. Only where rows are worked on changes, never which."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if planned >= SPLIT * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def by_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function that yields dicts of columns (numpy, Arrow or lists), given out in batches of GIVEN rows."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(it):
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in ((cols[f.name], f) for f in target)]
            whole = pa.RecordBatch.from_arrays(arrays, schema=target)
            for a in range(0, whole.num_rows, GIVEN):
                yield whole.slice(a, GIVEN)

    return df.mapInArrow(run, schema)
