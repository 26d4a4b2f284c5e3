"""Layers as versioned folders: a batch adds its rows to the hash buckets that it touches.

A store is a folder with `data-N/bucket=B`, the rows of batch N in bucket B, `data-N-old/bucket=B`, what older batches left in
it where batch N put that together, and `manifest/batch=N`, a table with a row for each part of each bucket. A read takes a bucket of one
part as it is and merges the parts of others by key. A batch puts buckets of PARTS parts together, writes its own rows once and then its
manifest. Old versions stay readable; a batch that died left no manifest, and one that comes again after its manifest was written
does nothing, so batch numbers must grow. Buckets double when they hold more than ROWS rows on average.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import upsert

#: Rows of a bucket on average before the buckets double, buckets of a new store, parts of a bucket that are put together.
ROWS, BUCKETS, PARTS = 1 << 20, 16, 4
_PARTS = "bucket int, version long, old boolean, rows long, buckets int"
_MANIFEST = f"{_PARTS}, batch long"


class LayerStore:
    """One layer in a folder; key names the columns that identify a row, spread the column that its bucket comes from."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], update: list[str], spread: str):
        self.spark, self.path, self.key, self.update, self.spread = spark, path.rstrip("/"), key, update, spread

    def _manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # no batch yet
            return self.spark.createDataFrame([], _MANIFEST)

    def _newest(self, before: int | None = None) -> list:
        """The newest manifest (before a batch): at most PARTS + 1 rows a bucket, so it is small."""
        rows = self._manifests() if before is None else self._manifests().where(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return [] if last is None else rows.where(F.col("batch") == last).collect()

    def _read(self, rows: list) -> DataFrame | None:
        parts = Counter(r.bucket for r in rows if r.rows)
        paths: dict[bool, list[str]] = {False: [], True: []}
        for r in rows:
            if r.rows:
                paths[parts[r.bucket] > 1].append(f"{self._folder(r.version, r.old)}/bucket={r.bucket}")
        whole = self.spark.read.parquet(*paths[False]) if paths[False] else None
        if not paths[True]:
            return whole
        merged = self._merged(self.spark.read.parquet(*paths[True]))
        return merged if whole is None else whole.unionByName(merged)

    def _folder(self, version: int, old: bool | None) -> str:
        return f"{self.path}/data-{version}{'-old' if old else ''}"

    def _merged(self, parts: DataFrame) -> DataFrame:
        """Each key once: update columns of its newest part, the others of its oldest."""
        version = F.regexp_extract("_metadata.file_path", r"/data-(\d+)(?:-old)?/bucket=[^/]*/[^/]*$", 1).cast("long") * 2
        rows = parts.withColumn("store__n", version + (~F.col("_metadata.file_path").rlike(r"-old/bucket=[^/]*/[^/]*$")).cast("int")).repartition(*self.key)
        new, first = ([c for c in parts.columns if c not in self.key and (c in self.update) == new] for new in (True, False))
        found = [pick(F.struct(*names), "store__n").alias(f"store__{i}") for i, (pick, names) in enumerate(((F.max_by, new), (F.min_by, first))) if names]
        if not found:
            return rows.select(*self.key).distinct()
        own = {c: f"store__{i}.{c}" for i, names in enumerate((new, first)) for c in names}
        return rows.groupBy(*self.key).agg(*found).select(*[F.col(own[c]).alias(c) if c in own else F.col(c) for c in parts.columns])

    def read(self) -> DataFrame | None:
        """The layer as of the newest batch; None before the first."""
        return self._read(self._newest())

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.spread), F.lit(buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Upsert a batch (each key once); a batch number that is there already changes nothing."""
        if not self._manifests().where(F.col("batch") == number).isEmpty():
            return
        known = self._newest(number)
        buckets = known[0].buckets if known else BUCKETS
        grown = sum(r.rows for r in known) > buckets * ROWS
        buckets *= 2 if grown else 1
        parts, stored = Counter(r.bucket for r in known if r.rows), self._read(known)
        other = stored is not None and set(stored.columns) != set(batch.columns)  # then a part of its own cannot say what it leaves as it is
        stale = [r for r in known if grown or other or parts[r.bucket] >= PARTS]
        old = self._read(stale)
        rows = [(r.bucket, r.version, r.old, r.rows, buckets) for r in known if r not in stale]
        if old is not None:
            rows += self._write(upsert(old, batch, self.key, self.update) if other else old, number, buckets, True)
        own = self._write(batch, number, buckets, False)
        rows += [] if other else own
        manifest = self.spark.createDataFrame(rows or [(0, number, False, 0, buckets)], _PARTS)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")

    def _write(self, rows: DataFrame, number: int, buckets: int, old: bool) -> list[tuple]:
        """Rows of the manifest for rows written by bucket; those of a batch stay in the tasks that made them."""
        placed, path = rows.withColumn("bucket", self._bucket(buckets)), self._folder(number, old)
        (placed.hint("rebalance", "bucket") if old else placed).write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema("bucket int").parquet(path).groupBy("bucket").count().collect()
        return [(r.bucket, number, old, r["count"], buckets) for r in written]

    def batch(self, number: int, like: DataFrame) -> DataFrame:
        """The rows that batch `number` brought, with the columns of like."""
        return self.spark.read.schema(like.schema).parquet(self._folder(number, False))


def store_sink(stores: dict[str, LayerStore], layers: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges the layers of each batch into their stores; a replayed batch changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        for name, df in layers(batch).items():
            stores[name].merge(df, number)

    return run
