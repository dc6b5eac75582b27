"""Tables written between stages, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """The session names no folder that driver and executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and the master is local, as in tests, a temporary
    folder is made and set for the session; it goes when the process ends. On a
    cluster, where executors would each write to a disk of their own, that is an
    error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        made = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        path = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone-{spark.conf.get('spark.app.id', 'local')}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the written table.

    Later stages read the files, so a lost executor costs the tasks it ran and
    never an earlier stage, and everything that was decided by task (row ids,
    sampled order) is fixed from here on. The files stay until `clean`.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> bool:
    """Delete all that this application has materialised. Tables that were returned
    and not yet written elsewhere can no longer be read then."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
