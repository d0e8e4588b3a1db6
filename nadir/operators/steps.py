"""Tables between the steps of an operator that works in rounds.

A round's table is written under the session's ``spark.checkpoint.dir`` and
read back, which cuts the lineage: a lost executor costs its running tasks. An
operator drops what it doesn't need any more; the rest goes when the session ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []
_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; on a local session without one (tests) a temporary one."""
    global _local
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="nadir-")
    return f"file://{_local}"


class Steps:
    """Tables of one operator's run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, f"{shared_dir(spark)}/nadir-{name}-{uuid.uuid4().hex[:12]}", 0
        _left.append((spark, self.path))

    def table(self, df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
        """``df`` written and read back; the table that ``replaces`` came from is deleted then."""
        path = f"{self.path}/{self.made}"
        self.made += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._nadir_path = path
        if replaces is not None:
            self.drop(replaces)
        return out

    def drop(self, table: DataFrame) -> None:
        path = getattr(table, "_nadir_path", None)
        if path:
            _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone by now
            return


atexit.register(_at_exit)
