"""Settings shared by all operators: where lineage is cut, and how a table is read."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the session was started.

    On a cluster the package is shipped with the job; a path that does not exist there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where the setting is absent (local tests) a temporary folder is used and removed at
    exit; a cluster must name one.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    importable(df.sparkSession)
    shared_dir(df.sparkSession)
    return without_estimates(df.checkpoint(eager=True))


def without_estimates(df: DataFrame) -> DataFrame:
    """A checkpointed df without the size estimate of the plan that made it.

    Checkpoints keep that estimate, and joins multiply estimates: in a loop they become numbers
    of millions of digits. Adaptive execution goes by the sizes that are met anyway.
    """
    spark = df.sparkSession
    make = getattr(getattr(spark, "_jsparkSession", None), "internalCreateDataFrame", None)
    if make is None:  # a remote session: keep the checkpoint as it is
        return df
    return DataFrame(make(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """Files of a shared file system below one path, for markers and manifests."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._jpath("").getFileSystem(self._conf)

    def _jpath(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._jpath(name))

    def names(self, name: str = "") -> list[str]:
        """What lies directly below a name; nothing if it does not exist."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._jpath(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._jpath(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written beside and renamed, so that a reader sees all of it or nothing."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self._fs.create(self._jpath(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.delete(name)
        if not self._fs.rename(self._jpath(part), self._jpath(name)):
            raise OSError(f"{name} could not be written")

    def delete(self, name: str) -> None:
        self._fs.delete(self._jpath(name), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
