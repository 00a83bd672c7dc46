"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without it a temporary folder, in local mode only: executors would not share it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, where no lost executor takes it away, until the application ends or it is ``dropped``."""
    return stored(df)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed Parquet and read again: the lineage ends here.

    Shuffle files of the job go once it is done. The table goes by ``dropped``, or when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/lumenframe-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    file_system, where = _file_system(spark, folder)
    file_system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenframe_path = path
    return out


def scratch(spark: SparkSession) -> str:
    """A new folder for files, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/lumenframe-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    file_system, where = _file_system(spark, path)
    file_system.mkdirs(where)
    file_system.deleteOnExit(_file_system(spark, folder)[1])
    return path


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        file_system, where = _file_system(table.sparkSession, table._lumenframe_path)
        file_system.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
