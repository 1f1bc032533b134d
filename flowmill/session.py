"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_base: dict[str, str] = {}
_saved_at: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder, visible to every executor, for tables that cut lineage.

    The cluster names the parent in ``spark.checkpoint.dir``. A machine-local
    parent is only made for a local master, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_base:
            _local_base[app] = tempfile.mkdtemp(prefix="flowmill-")
        base = _local_base[app]
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


def save_and_reload(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one expensive result feeds several branches: the written table
    survives the loss of executors, unlike cached blocks. The shuffle files of the write
    are freed with it: nothing reads them once the table is there.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    saved = spark.read.schema(df.schema).parquet(path)
    _saved_at[saved] = path
    return saved


def drop_saved(*tables: DataFrame) -> None:
    """Delete tables that ``save_and_reload`` returned, once all that is derived from them is stored.

    Other DataFrames are left alone. A table derived lazily from a dropped one cannot be read any more.
    """
    for table in tables:
        path = _saved_at.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
