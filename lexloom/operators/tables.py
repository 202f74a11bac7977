"""Tables that are changed a bucket at a time, and read whole at any version.

Rows lie in buckets by a hash of their key.  A change reads the buckets that
its keys fall in, writes these anew under a new version, and then records the
version: which version of each bucket holds, and which batches are in it.
Readers follow a record, so they see all of a change or nothing; buckets that
it doesn't touch keep their files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators.graph import EDGE, upsert_nodes
from lexloom.session import remove_folder


@dataclass(frozen=True)
class BucketTable:
    """A table below `base`: rows of `schema`, one for each `key`, in `buckets` buckets, dealt over `spread` files each at most.

    A writer that finds its version already recorded by another fails; it may
    try again.  Rows of a null key match no others: they are added, and stay.
    """

    spark: SparkSession
    base: str
    schema: str
    key: Sequence[str] = ("id",)
    buckets: int = 64
    spread: int = 4

    def _records(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/versions/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def record(self, version: int | None = None) -> dict:
        """version, buckets {bucket: version} and batches {source: last batch}; of the latest version, if none is named."""
        known = self._records()
        if not known:
            return {"version": 0, "buckets": {}, "batches": {}}
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        row = self.spark.read.text(f"{self.base}/versions/{known[-1] if version is None else version}").first()
        return json.loads(row.value)

    def _read(self, held: dict[str, int]) -> DataFrame:
        kind = T.StructType.fromDDL(self.schema)
        paths = [f"{self.base}/data/v={v}/bucket={b}" for b, v in held.items()]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.record(version)["buckets"])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def change(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], source: str | None = None, batch: int | None = None) -> bool:
        """Replace the buckets of new's keys by merge(their rows, new); False if this batch of its source is in already.

        Only bucket numbers, at most `buckets`, come to the driver.
        """
        now = self.record()
        if batch is not None and now["batches"].get(source, -1) >= batch:
            return False
        rows = new.withColumn("_b", self._bucket()).persist()
        try:
            touched = [str(r[0]) for r in rows.select("_b").distinct().collect()]
            version = now["version"] + 1
            folder = f"{self.base}/data/v={version}"
            if str(version) not in map(str, self._records()):
                remove_folder(self.spark, folder)  # what a writer left that never recorded it
            old = self._read({b: now["buckets"][b] for b in touched if b in now["buckets"]})
            merged = merge(old, rows.drop("_b")).select(*T.StructType.fromDDL(self.schema).names).withColumn("bucket", self._bucket())
            merged.repartition("bucket", F.pmod(F.xxhash64(*self.key) / self.buckets, F.lit(self.spread)).cast("int")).write.partitionBy("bucket").parquet(folder)
            left = {str(r[0]) for r in self.spark.read.parquet(folder).select("bucket").distinct().collect()} if touched and not merged.isEmpty() else set()
        finally:
            rows.unpersist()
        held = {b: v for b, v in now["buckets"].items() if b not in touched} | dict.fromkeys(sorted(left), version)
        batches = now["batches"] | ({source: batch} if batch is not None else {})
        text = json.dumps({"version": version, "buckets": held, "batches": batches})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.base}/versions/{version}")
        return True

    def upsert(self, new: DataFrame, source: str | None = None, batch: int | None = None) -> bool:
        """Nodes by one key: a given value wins, a null one keeps what was there.  Edges: those of a new key are added."""
        if len(self.key) == 1:
            return self.change(new, lambda old, rows: upsert_nodes(old, rows, self.key[0]), source, batch)
        return self.change(new, lambda old, rows: old.unionByName(rows.select(*old.columns)).dropDuplicates(list(self.key)), source, batch)

    def delete(self, keys: DataFrame) -> bool:
        same = lambda old, rows: old.join(rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key))).distinct(), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)], "left_anti")
        return self.change(keys, same)

    def vacuum(self, keep: int = 1) -> None:
        """Remove the records, and the files of buckets, that the last `keep` versions don't need."""
        known = self._records()
        kept = known[-keep:]
        needed = {(b, v) for k in kept for b, v in self.record(k)["buckets"].items()}
        for k in known[:-keep]:
            for b, v in self.record(k)["buckets"].items():
                if (b, v) not in needed:
                    remove_folder(self.spark, f"{self.base}/data/v={v}/bucket={b}")
            remove_folder(self.spark, f"{self.base}/versions/{k}")


def node_table(spark: SparkSession, base: str, schema: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, base, schema, ("id",), buckets)


def edge_table(spark: SparkSession, base: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, base, ", ".join(f"{c} string" for c in EDGE), EDGE, buckets)
