"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: The setting by which Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a new local one, if all tasks run in the driver's process; a RuntimeError on a cluster, whose executors
    would each write to a folder of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-genorigin-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, remembered for ``drop_stored``."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc._genorigin_stored = [*getattr(sc, "_genorigin_stored", []), path]
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from the files, so the shuffle files of the write go when it ends, not when the driver collects its garbage."""
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._genorigin_path = path
    return table


def drop_stored(spark: SparkSession, *tables: DataFrame) -> int:
    """Delete the tables that this application has stored so far, or only these that ``stored`` gave, once no result that reads them is needed any more; returns how many there were."""
    sc = spark.sparkContext
    every = getattr(sc, "_genorigin_stored", [])
    paths = [t._genorigin_path for t in tables] if tables else every
    sc._genorigin_stored = [p for p in every if p not in set(paths)]
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, so tasks can import it whatever their path is."""
    sc = spark.sparkContext
    if getattr(sc, "_genorigin_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-genorigin-"), "genorigin_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("genorigin", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._genorigin_shipped = True
