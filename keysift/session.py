"""Session-level helpers: scratch tables in a shared folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side, in bytes of its values, that is sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Largest number of one-row-per-filter parameters that is sent to every executor.
BROADCAST_ROWS = 200_000

# Scratch folders that this process made and has not deleted, and the parent chosen for each application.
_made: list[str] = []
_parents: dict[str, str] = {}


def default_folder(spark: SparkSession) -> str:
    """The user's folder on the session's default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem
    return hadoop.get(spark.sparkContext._jsc.hadoopConfiguration()).getHomeDirectory().toString()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or one on the default file system.

    A folder of the driver's own machine is taken only where the executors run on it too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    application = spark.sparkContext.applicationId
    if application in _parents:
        return _parents[application]
    folder = default_folder(spark)
    if folder.startswith("file:"):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="keysift-")
    _parents[application] = f"{folder.rstrip('/')}/keysift-scratch"
    return _parents[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables written by a job."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/keysift/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete all scratch tables that this process made; results that still read them must be written first."""
    jvm, conf, deleted = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        deleted += bool(path.getFileSystem(conf).delete(path, True))
    return deleted


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a columnar scratch table and read it back: lineage is cut, and every reader sees the same rows."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes, from the lengths of what is in it."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value).cast("bigint") + 8
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            size = F.size(value).cast("bigint") * 8
        else:
            size = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + value_bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        size = value_bytes(F.map_keys(value), keys) + value_bytes(F.map_values(value), values)
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [value_bytes(value[f.name], f.dataType) for f in kind.fields], F.lit(8).cast("bigint"))
    else:
        size = F.lit(16).cast("bigint")
    return F.coalesce(size, F.lit(8).cast("bigint"))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values; every task adds up its own rows."""
    row = reduce(lambda a, b: a + b, [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(8).cast("bigint"))
    return df.agg(F.sum(row)).first()[0] or 0


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values of ``df`` take at most ``limit`` bytes."""
    return measured_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its measured size allows it; otherwise leave it to AQE."""
    return F.broadcast(df) if is_small(df, limit) else df


def settled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Compute a grouped summary once, then broadcast it if it turned out small."""
    return broadcast_if_small(materialize(df), limit)


def beside(side: DataFrame, by: list[str]) -> tuple[DataFrame, Column]:
    """Rename the address columns of a join side; returns the test that a row met it.

    A join whose columns are all used keeps its generated code in a function of its own, which
    stays below the size that the JVM compiles.
    """
    met = F.lit(True)
    for c in by:
        side = side.withColumnRenamed(c, f"_at_{c}")
        met = met & F.col(f"_at_{c}").isNotNull()
    return side, met


def same_address(by: list[str]) -> Column:
    condition = F.lit(True)
    for c in by:
        condition = condition & (F.col(c) == F.col(f"_at_{c}"))
    return condition
