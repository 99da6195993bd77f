"""A keyed table that batches are merged into: the newest row per key, kept in buckets by a hash of the key.

    <path>/data/v<version>/bucket=<n>/*.parquet     buckets that the version wrote
    <path>/manifest/<version>.json                  where each bucket lies, and the batch that led there

A batch reads and writes the buckets that its keys fall into and leaves the others where they are, so its cost follows the
batch. The new manifest appears by a rename once all its buckets are written: a reader sees a version whole or not at all,
and a batch that is played again, after a failure or a restart, either finds its manifest and changes nothing or writes
the same version anew. The last `keep` versions stay readable; buckets that none of them uses are removed.

One writer at a time, as foreachBatch gives. The number of buckets is fixed when the table begins: some tens of MB in a
bucket is a good size. Keys may be null; of rows of a key that are equal in the order columns the largest row stays.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "bucket"


class KeyedTable:
    """The table at a path. key: its columns; order: what makes a row newer."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.key, self.order, self.buckets, self.keep = spark, path.rstrip("/"), key, order, buckets, keep
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        folder = self._at(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """Of a version, or of the newest one: its number, batch, schema, number of buckets, and the folder of each bucket."""
        held = self.versions()
        version = held[-1] if version is None and held else version
        return None if version is None else json.loads(self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, or of the newest one; None before the first batch."""
        m = self.manifest(version)
        return None if m is None else self._rows(m, m["folders"])

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The newest rows of keys (the key columns, each key once), from the buckets that they fall into; None before the first batch."""
        m = self.manifest()
        if m is None:
            return None
        numbers = [str(r[0]) for r in keys.select(self._number(m["buckets"])).distinct().collect()]  # at most one per bucket
        return self._rows(m, [n for n in numbers if n in m["folders"]]).join(keys, self.key, "left_semi")

    def _rows(self, m: dict, numbers) -> DataFrame:
        folders = [f"{self.path}/data/{m['folders'][n]}" for n in numbers]
        if not folders:
            return self.spark.createDataFrame([], m["schema"])
        return self.spark.read.schema(m["schema"]).parquet(*folders)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch of a stream; batch_id grows from batch to batch."""
        m = self.manifest()
        if m and m["batch"] >= batch_id:
            return
        n = m["buckets"] if m else self.buckets
        version, schema = (m["version"] + 1 if m else 0), m["schema"] if m else ", ".join(f"`{c}` {t}" for c, t in batch.dtypes)
        folder = f"v{version}"
        rows = self._newest(batch)
        touched = [str(r[0]) for r in rows.select(self._number(n).alias(_BUCKET)).distinct().collect()]  # at most one per bucket
        if m and (old := [b for b in touched if b in m["folders"]]):
            rows = self._newest(rows.unionByName(self._rows(m, old)))
        if touched:
            rows.withColumn(_BUCKET, self._number(n)).repartition(min(n, len(touched)), _BUCKET).write.partitionBy(_BUCKET).mode("overwrite").parquet(f"{self.path}/data/{folder}")
        folders = (m["folders"] if m else {}) | {b: f"{folder}/{_BUCKET}={b}" for b in touched}
        self._publish({"version": version, "batch": batch_id, "buckets": n, "schema": schema, "folders": folders})
        self._clean()

    def _number(self, n: int):
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.key, *self.order)]
        newest = F.max(F.struct(*self.order, *rest)).alias("_row")
        return rows.groupBy(*self.key).agg(newest).select(*(F.col(c) if c in self.key else F.col(f"_row.{c}").alias(c) for c in rows.columns))

    def _publish(self, m: dict) -> None:
        draft, final = (self._at(f"{self.path}/manifest/{m['version']}{end}") for end in (".draft", ".json"))
        out = self._fs.create(draft, True)
        out.writeBytes(json.dumps(m))
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"version {m['version']} could not be published")

    def _clean(self) -> None:
        """Remove manifests beyond the last keep, and the buckets that no manifest left uses."""
        held = self.versions()
        for version in held[: -self.keep]:
            self._fs.delete(self._at(f"{self.path}/manifest/{version}.json"), False)
        used = {f for v in held[-self.keep :] for f in self.manifest(v)["folders"].values()}
        for v in self._fs.listStatus(self._at(f"{self.path}/data")) if self._fs.exists(self._at(f"{self.path}/data")) else ():
            name, left = v.getPath().getName(), 0
            for b in self._fs.listStatus(v.getPath()):
                if b.isDirectory() and f"{name}/{b.getPath().getName()}" not in used:
                    self._fs.delete(b.getPath(), True)
                elif b.isDirectory():
                    left += 1
            if not left:
                self._fs.delete(v.getPath(), True)


def upsert_into(path: str, key: list[str], order: list[str], buckets: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch into the keyed table at path."""

    def write(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, path, key, order, buckets, keep).merge(batch, batch_id)

    return write
