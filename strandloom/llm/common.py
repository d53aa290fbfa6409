"""What the training-data operators share: scratch tables, Arrow batches, table access."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of an Arrow batch. Texts may be very long, so that bytes bound it too.
BATCH_ROWS, BATCH_BYTES = 65536, 4 << 20
_OWN_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). A temporary one only where that is unset and the master is
    local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="strandloom-"))
    return _OWN_SCRATCH[0]


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores as no column of the frames has it (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function that yields dicts of columns; bounded batches bound the worker's memory (the bounds are
    set in the session)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    target = arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(it):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in ((cols[f.name], f) for f in target)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split() for x in ddl.split(","))])


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the id's decimal text, modulo n (null: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def first_by_hash(ids: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows of ids (doc_id, ...), the first by a hash of the id; a table small enough to broadcast."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def texts_of(docs: DataFrame, some: DataFrame):
    """The rows of a bounded sample (doc_id, ...) with their texts, as pandas; docs are not shuffled."""
    rows = docs.where("text is not null").selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.join(F.broadcast(some), "doc_id").toPandas().sort_values("doc_id", kind="stable")
