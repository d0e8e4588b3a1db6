"""A table that batches are merged into, and pair roll-ups kept up to date by it.

Rows live in buckets of a hash of their keys. A merge reads and writes the
buckets that its batch touches and no other; then a manifest of one small file
names the folders that make up the new version. Until that file has its final name
readers see the version before, so a merge that was killed changes nothing; a
batch whose id the manifest holds isn't merged again. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a merge that one task gets.
TASK_ROWS = 400_000


class MergeTable:
    """``keys`` make a row's identity, null like a value; ``schema`` is that of the rows."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    # the manifest

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, folder = self._at("manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, folders (bucket -> folder) and batches (source -> last id) of the latest or a given version."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "folders": {}, "batches": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{version or versions[-1]:010d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        fs, last = self._at(f"manifest/{manifest['version']:010d}.json")
        _, draft = self._at(f"manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(last) or not fs.rename(draft, last):
            raise RuntimeError(f"version {manifest['version']} was written by another writer")

    # rows

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["folders"].values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in sorted(set(folders))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame], DataFrame], batch_id: int | None = None, source: str = "") -> bool:
        """Replace the rows of touched buckets by ``combine`` of them and the batch; false if the batch was merged before.

        ``combine`` gets the old rows (``is_new`` false) and the batch's (true) of
        whole buckets, in one frame partitioned by the keys, and gives rows of the table's schema whose keys are among theirs.
        """
        now = self.manifest()
        if batch_id is not None and now["batches"].get(source, -1) >= batch_id:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        names = [f.name for f in self.schema.fields]
        batch = batch.select(*names).persist()
        try:
            touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most as many as there are buckets
            folders = dict(now["folders"])
            if touched:
                old = self._rows(folders[str(b)] for b in touched if str(b) in folders)
                both = old.withColumn("is_new", F.lit(False)).unionByName(batch.withColumn("is_new", F.lit(True)))
                new = f"data/{now['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
                # partitions follow the rows, so a task's share doesn't; a large bucket is written by several
                tasks = -(-(old.count() + batch.count()) // TASK_ROWS)
                files = -(-tasks // len(touched))
                out = combine(both.repartition(max(least, tasks), *self.keys)).select(*names).withColumn("_bucket", bucket)
                out.repartition(len(touched) * files, "_bucket", F.pmod(F.hash(*self.keys), F.lit(files))).write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{new}")
                fs, _ = self._at("")
                for b in touched:  # a bucket may have lost its last row
                    folder = f"{new}/_bucket={b}"
                    if fs.exists(self._at(folder)[1]):
                        folders[str(b)] = folder
                    else:
                        folders.pop(str(b), None)
        finally:
            batch.unpersist()
        batches = now["batches"] | ({source: batch_id} if batch_id is not None else {})
        self._commit({"version": now["version"] + 1, "folders": folders, "batches": batches})
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the last ``keep`` versions names, killed merges' files with it; how many folders went."""
        versions = self._versions()
        held = {f for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        fs, data = self._at("data")
        gone = 0
        for run in fs.listStatus(data) if fs.exists(data) else []:
            for part in fs.listStatus(run.getPath()):
                name = f"data/{run.getPath().getName()}/{part.getPath().getName()}"
                if name not in held:
                    gone += bool(fs.delete(part.getPath(), True)) and "_bucket=" in name
            if not any(h.startswith(f"data/{run.getPath().getName()}/") for h in held):
                fs.delete(run.getPath(), True)
        for v in versions[:-keep]:
            fs.delete(self._at(f"manifest/{v:010d}.json")[1], False)
        return gone


def keep_last(keys: Sequence[str], order: Sequence[Column | str]) -> Callable[[DataFrame], DataFrame]:
    """The batch's row of a key replaces the table's; among a batch's rows the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("is_new"), *order)
    return lambda both: both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "is_new")


def keep_first(keys: Sequence[str], order: Sequence[Column | str]) -> Callable[[DataFrame], DataFrame]:
    """The table's row of a key stays."""
    w = Window.partitionBy(*keys).orderBy(F.asc("is_new"), *order)
    return lambda both: both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "is_new")


def add_up(keys: Sequence[str], sums: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Columns added up by key; a key all of whose sums are 0 goes."""
    return lambda both: both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)).where(" or ".join(f"`{c}` <> 0" for c in sums))


class PairRollup:
    """Counts, sums and tiers of pairs, kept up to date by evidence rows and withdrawals.

    A row of evidence counts once with its sign: 1, or -1 for a withdrawal of what
    was counted before, which may come first. All figures are sums, so batches in any
    order give the same table: evidence, value sums, and rows of each tier, of
    which the best with any is the pair's tier.
    """

    def __init__(self, spark: SparkSession, path: str, a: str, b: str, tier: str, value: str, tiers: Sequence[str], key_type: str = "long", buckets: int = 64):
        self.a, self.b, self.tier, self.value, self.tiers = a, b, tier, value, list(tiers)
        self.sums = ["n", "total", *(f"n_{t}" for t in tiers)]
        schema = T.StructType.fromDDL(f"{a} {key_type}, {b} {key_type}, n long, total decimal(38,4), " + ", ".join(f"n_{t} long" for t in tiers))
        self.table = MergeTable(spark, path, schema, [a, b], buckets)

    def deltas(self, rows: DataFrame, withdrawn: Column, partitions: int | None = None) -> DataFrame:
        sign = F.when(withdrawn, -1).otherwise(1)
        parts = [F.sum(sign).alias("n"), F.sum(F.coalesce(F.col(self.value), F.lit(0)).cast("decimal(18,4)") * sign).cast("decimal(38,4)").alias("total")]
        parts += [F.sum(F.when(F.col(self.tier) == t, sign).otherwise(0)).alias(f"n_{t}") for t in self.tiers]
        return (rows.repartition(partitions, self.a, self.b) if partitions else rows).groupBy(self.a, self.b).agg(*parts)

    def apply(self, rows: DataFrame, withdrawn: Column, batch_id: int | None = None, source: str = "", partitions: int | None = None) -> bool:
        """Merge a batch; ``partitions`` is for large ones of pairs that seldom come twice, whose rows are shuffled into so many."""
        return self.table.merge(self.deltas(rows, withdrawn, partitions), add_up([self.a, self.b], self.sums), batch_id, source)

    def read(self) -> DataFrame:
        best = F.coalesce(*(F.when(F.col(f"n_{t}") > 0, t) for t in self.tiers))
        return self.table.read().where("n > 0").select(self.a, self.b, "n", "total", best.alias("best_tier"))

    def follow(self, stream: DataFrame, withdrawn: Column, event: str, time: str, delay: str = "1 hour", source: str = "stream"):
        """A writer of a stream into the table: an event's id counts once within the watermark, which bounds the state; a batch is merged once by its id."""
        once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([event])
        return once.writeStream.foreachBatch(lambda batch, i: self.apply(batch, withdrawn, i, source) and None)
