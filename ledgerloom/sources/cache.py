"""A durable cache of results by content: put, get, expire, clear, stats.

The table is cut into buckets by a hash of the key. A put writes only the buckets that it touches, as new files, and then a
small manifest that says which version of each bucket counts; readers follow the last manifest, so a put that fails, or runs
twice, leaves a whole state behind it: the old one or the new one. Keys are unique; a later put of a key wins. Only the
manifest (a row for each bucket, their number fixed) comes to the driver. One writer at a time.

Defined cases: rows with a null key are neither stored nor found; of rows of one key in one put the latest counts, of equally
late ones the greatest result.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, result string, cached_at timestamp"
#: Fixed value: seconds that an entry lives.
LIFE = 24 * 3600


class ResultCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, life: int = LIFE):
        self.spark, self.path, self.buckets, self.life = spark, path.rstrip("/"), buckets, life

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _manifest(self) -> tuple[int, dict[int, str]]:
        """Number and content of the last manifest: the folder of each bucket that has entries."""
        try:
            all_of = self.spark.read.schema("bucket int, folder string, put int").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, {}
        last = all_of.agg(F.max("put")).first()[0]
        return (-1, {}) if last is None else (last, {r.bucket: r.folder for r in all_of.where(F.col("put") == last).where("folder is not null").collect()})

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def rows(self) -> DataFrame:
        """All entries, expired ones too."""
        return self._rows(self._manifest()[1])

    def _commit(self, put: int, folders: dict[int, str]) -> None:
        rows = [(b, f, put) for b, f in folders.items()] or [(-1, None, put)]
        self.spark.createDataFrame(rows, "bucket int, folder string, put int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, rows: DataFrame, touched: list[int] | None = None) -> None:
        put, now = self._manifest()
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        there = {r.bucket for r in self.spark.read.parquet(f"{self.path}/{folder}").select("bucket").distinct().collect()} if self._any(folder) else set()
        kept = {} if touched is None else {b: f for b, f in now.items() if b not in touched}
        self._commit(put + 1, kept | {b: folder for b in there})

    def _any(self, folder: str) -> bool:
        try:
            return "bucket" in self.spark.read.parquet(f"{self.path}/{folder}").columns
        except AnalysisException:  # a write without rows has no files and so no schema
            return False

    def put(self, rows: DataFrame) -> None:
        """Add or replace (key, result, cached_at)."""
        new = rows.where("key is not null").select("key", F.col("result").cast("string").alias("result"), F.col("cached_at").cast("timestamp").alias("cached_at"))
        # at most as many numbers as there are buckets
        touched = [r.bucket for r in new.select(self._bucket()).distinct().collect()]
        if not touched:
            return
        now = self._manifest()[1]
        old = self._rows({b: f for b, f in now.items() if b in touched}).join(new.select("key").distinct(), "key", "left_anti")
        one = new.groupBy("key").agg(F.max(F.struct("cached_at", "result")).alias("x")).select("key", "x.result", "x.cached_at")
        self._write(old.unionByName(one), touched)

    def live(self, now) -> DataFrame:
        """The entries that have not expired at `now` (a timestamp column or literal)."""
        return self.rows().where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("cached_at") <= self.life)

    def get(self, keys: DataFrame, now) -> DataFrame:
        """`keys` (with a column `key`) with the result of each, null where there is none or it has expired, and `hit`."""
        found = self.live(now).select("key", "result", F.lit(True).alias("hit"))
        return keys.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def clear(self, now=None) -> None:
        """Drop the entries that have expired at `now`, or all."""
        if now is None:
            self._commit(self._manifest()[0] + 1, {})
        else:
            self._write(self.live(now))

    def stats(self, now) -> DataFrame:
        """entries, expired, characters of the results."""
        gone = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("cached_at") > self.life
        return self.rows().agg(F.count(F.lit(1)).alias("entries"), F.count_if(gone).alias("expired"), F.coalesce(F.sum(F.length("result")), F.lit(0)).alias("characters"))


def through(cache: ResultCache, rows: DataFrame, key: str, call, now) -> DataFrame:
    """`rows` with `result` and `hit`: what the cache has, else what `call` makes of the distinct missing keys, which are put.

    `call` takes a DataFrame of one column `key` and gives (key, result); it sees each missing key once.
    """
    keys = rows.select(F.col(key).alias("key")).where("key is not null").distinct()
    missing = keys.join(cache.live(now).select("key"), "key", "left_anti")
    had = cache.live(now).select("key", F.lit(True).alias("hit"))
    asked = rows.join(had, rows[key] == had["key"], "left").drop("key") if key != "key" else rows.join(had, "key", "left")
    asked = asked.withColumn("hit", F.coalesce("hit", F.lit(False)))
    cache.put(call(missing).withColumn("cached_at", F.lit(now).cast("timestamp")))
    return asked.join(cache.live(now).select(F.col("key").alias(key), "result"), key, "left")
