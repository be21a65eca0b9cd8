"""What the operators share on the Spark side."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from typing import Any

from pyspark import Broadcast, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker, about: bounds what worker and executor hold.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one is set only in local mode, and only where none is."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="corpuslens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def modest_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_BYTES``, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).lower().rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/corpuslens-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def held(df: DataFrame) -> DataFrame:
    """The rows on the executors' disks, for tables that are read a few times and soon no more: what
    is lost with an executor is worked out again."""
    return df.persist(StorageLevel.DISK_ONLY)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Deletes kept and held tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_kept_at", None):
            remove(df.sparkSession, path)
        else:
            df.unpersist()


def sent(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast that carries the classes of ``value`` with it: workers need no package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def got(shared: Broadcast) -> Any:
    return pickle.loads(shared.value)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a table without one of them gets it as null."""
    modest_batches(df.sparkSession)
    have = {c.lower() for c in df.columns}
    return df.select(*[F.col(f"`{n}`") if n.lower() in have else F.lit(None).alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
