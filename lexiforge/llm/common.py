"""Helpers that the training-data operators share: shared storage, checked broadcasts, table reading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key-only table (16 bytes a row at most) that may be broadcast after they have been counted.
BROADCAST_ROWS = 1_000_000
#: Bytes of input text a Python group works on at a time.
GROUP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is unset as in tests,
    a temporary folder of this session's own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-lexiforge-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files go when the query that wrote them has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and survives lost executors.  As nothing goes
    back to the shuffles behind the table, their files are deleted once it is written."""
    return _written(df, shared_path(df.sparkSession, name))


#: Rows of a batch that goes to Python while tables are written: whole texts are in them.
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    held = {name: spark.conf.get(name, None) for name in (_CLEAN_UP, _BATCH_ROWS[0])}
    spark.conf.set(_CLEAN_UP, "true")
    spark.conf.set(*_BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        for name, before in held.items():
            if before is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Materialised tables that are deleted as soon as their successors are written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        out = _written(df, path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete these tables; what was not written here is passed over."""
        for t in tables:
            _, where = self._paths.pop(id(t), (None, None))
            if where:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for a broadcast if its counted ``rows`` are within ``bound``; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows <= bound else df.hint("merge")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in the whole table."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).head()[0]


def buckets_for(df: DataFrame, column: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """How many groups the table's texts must be dealt to so that each has about ``group_bytes``."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-text_bytes(df, column) // group_bytes))
