"""A keyed table in buckets by the hash of its key. A change rewrites the buckets it touches, into new folders; the manifest then names
these in place of the old ones, so readers see the table before a change or after it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import files, snapshots

BUCKET = StructField("_bucket", LongType())


class Keyed:
    """The rows of a key are put, replaced and deleted together."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path, key
        self.version, self.says = snapshots.manifest(spark, path)
        self.says = self.says or {"buckets": buckets, "folders": {}, "schema": None}

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.says["buckets"]))

    def _schema(self) -> StructType | None:
        return StructType.fromJson(json.loads(self.says["schema"])) if self.says["schema"] else None

    def _of(self, buckets: list[int]) -> DataFrame | None:
        """The rows of some buckets; None where nothing has been put yet."""
        schema = self._schema()
        if schema is None:
            return None
        parts: dict[str, list[int]] = {}
        for b in buckets:
            if str(b) in self.says["folders"]:
                parts.setdefault(self.says["folders"][str(b)], []).append(b)
        found = self.spark.createDataFrame([], schema)
        for data, own in sorted(parts.items()):
            rows = self.spark.read.schema(StructType([*schema.fields, BUCKET])).parquet(f"{self.path}/{data}")
            found = found.unionByName(rows.where(F.col(BUCKET.name).isin(own)).drop(BUCKET.name))  # other folders aren't read
        return found

    def _change(self, touched: DataFrame, new: DataFrame | None) -> None:
        touched = files.index(touched.select(self.key).distinct(), "touched")
        buckets = [r[0] for r in touched.select(self._bucket().alias("b")).distinct().collect()]  # as many as the table has
        old = self._of(buckets)
        if not buckets or old is None and new is None:
            return
        rows = new if old is None else old.join(touched, self.key, "left_anti")
        rows = rows if old is None or new is None else rows.unionByName(new)
        schema = self._schema() or new.schema
        data = snapshots.fresh()
        # a bucket goes to several tasks, so that a key of many rows doesn't land in one
        spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in rows.columns)), F.lit(4))
        dealt = rows.select(*schema.names).withColumn(BUCKET.name, self._bucket()).repartition(BUCKET.name, spread)
        dealt.write.partitionBy(BUCKET.name).parquet(f"{self.path}/{data}")
        written = self.spark.read.schema(StructType([*schema.fields, BUCKET])).parquet(f"{self.path}/{data}")
        left = {r[0] for r in written.select(BUCKET.name).distinct().collect()}
        folders = {b: f for b, f in self.says["folders"].items() if int(b) not in buckets} | {str(b): data for b in sorted(left)}
        says = self.says | {"folders": folders, "schema": schema.json()}
        self.version = snapshots.publish(self.spark, self.path, says, self.version)
        self.says = says

    def put(self, rows: DataFrame) -> None:
        """The rows of each key in ``rows`` replace those that are there."""
        rows = files.index(rows, "put")
        self._change(rows, rows)

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows of the keys; unknown ones change nothing."""
        self._change(keys, None)

    def get(self, value) -> DataFrame:
        """The rows of one key, from one bucket; none, never null, for an unknown one."""
        name = F.lit(value).cast(self._schema()[self.key].dataType)
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(name), F.lit(self.says["buckets"]))).first()[0]
        return self._of([bucket]).where(F.col(self.key) == name)

    def all(self) -> DataFrame:
        return self._of([int(b) for b in self.says["folders"]])
