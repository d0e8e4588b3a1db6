"""Intermediate tables in the folder that all executors share.

A table that several later steps read is written once as Parquet under the
session's ``spark.checkpoint.dir`` and read back: that cuts the lineage, and a
lost executor costs nothing but its running tasks. Only where the setting is
unset on a local master (tests) a temporary folder of the driver is used.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch that goes to a Python worker.
ARROW_BATCH_BYTES = 8 << 20

_dirs: dict[str, list[tuple[SparkSession, str]]] = {}
_local: str | None = None


def session_of(df: DataFrame) -> SparkSession:
    """The session of a frame, with the bound on Arrow batches set.

    Rows differ by orders of magnitude in length, so batches are bounded in
    bytes and not by rows alone.
    """
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) or 1 << 62) > ARROW_BATCH_BYTES:  # a smaller bound stays
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def base_dir(spark: SparkSession) -> str:
    global _local
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="nadir-")
    return f"file://{_local}"


class Scratch:
    """A folder of intermediate tables; ``group`` names what is deleted together."""

    def __init__(self, spark: SparkSession, group: str):
        self.spark = spark
        self.path = f"{base_dir(spark)}/nadir-{group}-{uuid.uuid4().hex[:12]}"
        _dirs.setdefault(group, []).append((spark, self.path))

    def table(self, name: str, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` (in a folder for each value of ``by``) and return a frame that reads it back."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def release(self) -> None:
        """Have the shuffle files of finished steps deleted now, not when the driver next collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def clear(group: str) -> None:
    """Delete the folders of a group; nothing may read them any more."""
    for spark, path in _dirs.pop(group, []):
        _delete(spark, path)


def _at_exit() -> None:
    for group in list(_dirs):
        for spark, path in _dirs.pop(group):
            try:
                _delete(spark, path)
            except Exception:  # the JVM may be gone by now
                return


atexit.register(_at_exit)


def rest_hash(row: str, schema: T.StructType, without: tuple[str, ...] = ("doc_id", "text")) -> Column:
    """A hash of the fields of a struct column, to put rows in order that are alike in ``without``; maps and the like don't count."""
    names = [f.name for f in schema.fields if f.name not in without and not re.search("map<|variant|geo", f.dataType.simpleString())]
    return F.xxhash64(*(F.col(row).getField(n) for n in names)) if names else F.lit(0)


_places: dict[int, list[int]] = {}


def dealt(df: DataFrame, column: str | Column, n: int, most: int = 8192) -> DataFrame:
    """Rows in ``n`` partitions by a column of numbers modulo ``n``, each number in a partition of its own.

    A hash of so few numbers would put several of them into some partitions and
    none into others; here each stands for an integer whose hash is its place.
    For more than ``most`` partitions that table would be long, and the hash of
    the number decides.
    """
    if n > most:
        return df.repartition(n, column)
    if n not in _places:
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        found = df.sparkSession.range(n * 24 + 64).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()
        _places[n] = [r["id"] for r in sorted(found, key=lambda r: r["place"])]
    if len(_places[n]) < n:
        return df.repartition(n, column)
    names = F.array(*(F.lit(i).cast("int") for i in _places[n]))
    return df.repartition(n, F.element_at(names, F.pmod(F.col(column) if isinstance(column, str) else column, F.lit(n)).cast("int") + 1))


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """As many partitions as keep each at ``rows_per_partition``; at least the session's."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // rows_per_partition))
