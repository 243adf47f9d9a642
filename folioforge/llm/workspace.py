"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset
and everything runs in one process on one machine (tests) a temporary folder is
made and set in its place; on a cluster an unset folder is an error, as executors
would not share it.
Everything is written and removed through Spark's own file system classes, so
any store that Spark can reach will do.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="folioforge-")
    spark.sparkContext.setCheckpointDir(_LOCAL["dir"])
    return "file://" + _LOCAL["dir"]


class Workspace:
    """Named Parquet tables below one fresh folder; each cuts the lineage of what it holds.

    A lost executor costs only the tasks it was running: finished tables are in
    the shared store, not on that executor's disk.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/folioforge-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._remove, self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back.

        Without the empty file that marks a finished write: nothing reads it, and without Hadoop's native
        library the driver starts processes to set that file's permissions, which while they start share,
        and count as, its whole memory.
        """
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._folio_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Remove tables made by ``save`` that nothing reads any more."""
        for df in saved:
            self._remove(df._folio_path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            if jvm is None:
                return
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - at exit the JVM may be gone; leftovers are harmless
            return
