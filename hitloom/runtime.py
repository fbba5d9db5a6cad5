"""Shared-folder tables used to cut lineage.

Executors may be lost at any time, so intermediate results that are read more
than once are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read them again.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs in one process (tests)."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hitloom-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers find it without an installation."""
    sc, root = spark.sparkContext, Path(__file__).parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    _shipped.add(sc.applicationId)
    folder = Path(tempfile.mkdtemp(prefix="hitloom-"))  # executors fetch the archive from the driver as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = shutil.copytree(root, folder / "copy" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / root.name), "zip", copy.parent, root.name))


_folders: dict[str, tuple] = {}


@atexit.register
def _delete_folders() -> None:
    """Results are lazy and read their tables until the application ends: only then are all folders free to go."""
    while _folders:
        folder, (jvm, conf) = _folders.popitem()
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the JVM has ended before, with the folders left to the cluster
            return


class Scratch:
    """Parquet tables of one computation, in a folder of their own that is deleted when the application ends."""

    def __init__(self, spark: SparkSession, name: str = "work"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/hitloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _folders[self.root] = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """Write ``df`` (in a folder per value of ``by``) and read it back: later plans start from these files."""
        path = self.path(name)
        df.write.parquet(path, partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str = "t", **more: Column) -> tuple[DataFrame, dict]:
        """The same, with the number of rows ``n`` and further aggregates taken while writing."""
        seen = Observation()
        out = self.table(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items())), name)
        return out, seen.get

    def release(self, *frames: DataFrame) -> None:
        """Delete the files of tables that nothing reads any more."""
        for df in frames:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if "/hitloom/" in folder:
                    self._delete(folder)

    def _delete(self, folder: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark._jsc
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
