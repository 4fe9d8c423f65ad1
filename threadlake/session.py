"""Session factory and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "threadlake", cpus: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read
    from the session. Only where it is unset (single-machine tests) a folder of
    our own is taken."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "threadlake-shared")
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/threadlake/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder that a write has finished, sorted."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    mark = lambda child: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS")
    return sorted(s.getPath().getName() for s in store.listStatus(place) if s.isDirectory() and store.exists(mark(s.getPath())))


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Send rows to Python in batches of about so many bytes at most: a batch is
    held by the task and by its Python worker, and texts are long. The setting
    is the session's and is read when a query runs; it is only ever lowered."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < as_bytes(spark.conf.get(name)) <= size:
        spark.conf.set(name, str(size))


#: Tables written since the innermost concluded() began, None outside of one.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write to the shared folder and read again: later stages start from the
    table, so a lost executor costs no more than the stage at hand. ``options``
    are the writer's."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    if (written := _written.get()) is not None:
        written.append(path)
    writer = df.write.mode("overwrite").options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def concluded(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Materialize what ``build`` returns and delete the tables that it wrote on
    the way (also when it fails); the result reads none of them."""
    outer, inner = _written.get(), []
    token = _written.set(inner)
    try:
        result = materialize(build(), label)
        last = inner.pop()
        if outer is not None:
            outer.append(last)
        return result
    finally:
        _written.reset(token)
        for path in inner:
            _delete(spark, path)
