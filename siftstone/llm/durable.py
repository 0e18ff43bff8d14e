"""Cutting lineage so that it outlives an executor.

Tables are written to the folder that the cluster names in
``spark.checkpoint.dir``. Only a local session may go without that setting.
A table that nothing reads any more is discarded; those that a result still
reads go when the driver ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

_kept: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets its own, and no setting is changed."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "siftstone-shared")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has; :func:`discard_path` or the driver's end removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back with its own schema."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard_path(path: str) -> None:
    spark = _kept.pop(path, None)
    if spark is None:
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that :func:`written` made; whatever was made of them must have been written too."""
    for t in tables:
        if path := getattr(t, "written_path", None):
            discard_path(path)


@atexit.register
def _discard_all() -> None:
    for path in list(_kept):
        try:
            discard_path(path)
        except Exception:  # the session has ended already: its folder goes with the cluster
            _kept.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
