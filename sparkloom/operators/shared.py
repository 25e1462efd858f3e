"""Tables that later steps start from, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: While a table is written: shuffle files go with the plan, and Arrow batches stay small in the workers.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_own: dict[str, str] = {}


def ship(module: str) -> None:
    """Send functions of a module to executors by value: workers need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it, in local mode only, a temporary folder of this process.

    Raises ValueError on a cluster without ``spark.checkpoint.dir``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            made = tempfile.mkdtemp(prefix="sparkloom-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _own[app] = "file://" + made
        folder = _own[app]
    return folder.rstrip("/")


def settle(df: DataFrame, name: str = "t", tasks: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from files that outlive executors.

    The shuffle files of the written plan go with its execution, and its Arrow
    batches are of 16 MB at most. ``tasks``: at
    most so many tasks make its last step, for tables known to be small.
    """
    if tasks:
        df = df.coalesce(tasks)
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
