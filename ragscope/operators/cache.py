"""Judge reply cache as a Parquet table.

The table is append-only ``(cache_key, response, created_at)``; a key
written twice keeps both rows and readers take the newest (last write wins,
U5). Rewrites (clear, purge, evict, compaction) write a new generation folder
and switch to it, so no job ever overwrites the files it is reading.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.schemas import JUDGE_CACHE
from ragscope.storage import delete, exists, store

DEFAULT_MAX_ENTRIES = 0  # keep every reply; a limit is the caller's to set


# --- pure operators over a cache DataFrame ---------------------------------

def latest_per_key(cache: DataFrame) -> DataFrame:
    """One row per key, the newest write (ties: greatest response)."""
    newest = F.max_by(F.struct("response", "created_at"),
                      F.struct("created_at", "response"))
    return (cache.groupBy("cache_key").agg(newest.alias("_v"))
            .select("cache_key", "_v.response", "_v.created_at"))


def lookup(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts with their cached reply (null on a miss) and a ``hit`` flag."""
    return (prompts.join(cache.select("cache_key", "response"), "cache_key", "left")
            .withColumn("hit", F.col("response").isNotNull()))


def misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts whose key is not cached (left anti)."""
    return prompts.join(cache.select("cache_key"), "cache_key", "left_anti")


def older_than(created_at: Column, days: int, as_of: Column | None = None) -> Column:
    """``created_at < as_of - N days``."""
    ref = as_of if as_of is not None else F.current_timestamp()
    return created_at < ref - F.make_dt_interval(F.lit(days))


def purge(cache: DataFrame, days: int, as_of: Column | None = None) -> DataFrame:
    """The rows to keep after removing those older than ``days``."""
    return cache.where(~older_than(F.col("created_at"), days, as_of))


#: Buckets of a histogram, and rows of its boundary bucket that are sorted.
BUCKETS = 4096
BOUNDARY_ROWS = 1 << 17


def _boundary(table: DataFrame, bucket: Column, wanted: int) -> tuple[object, int]:
    """The bucket (in rising order) that holds the ``wanted``-th row, and how
    many rows are wanted of it. The driver sees one row per bucket."""
    for r in sorted(table.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.b):
        if wanted <= r.n:
            return r.b, wanted
        wanted -= r.n
    raise ValueError("fewer rows than wanted")


def _last_kept(keys: DataFrame, wanted: int) -> tuple[int, str]:
    """Time (microseconds) and key of the ``wanted``-th row, newest first, ties
    by key: by histograms of the time, then of the keys written at one time."""
    t = F.unix_micros("created_at")
    rest, low, high = keys, *keys.agg(F.min(t), F.max(t)).first()
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        b, wanted = _boundary(rest, F.floor((F.lit(high) - t) / width), wanted)
        low, high = max(low, high - (b + 1) * width + 1), high - b * width
        rest = keys.where(t.between(low, high))
        if rest.count() <= BOUNDARY_ROWS:
            break
    prefix = 0
    while low == high and rest.count() > BOUNDARY_ROWS:
        # very many keys of one time: the boundary among their beginnings
        prefix += 1
        b, wanted = _boundary(rest, F.substring("cache_key", 1, prefix), wanted)
        rest = rest.where(F.substring("cache_key", 1, prefix) == b)
    newest_first = rest.select(t.alias("t"), "cache_key").orderBy(F.desc("t"), F.asc("cache_key")).limit(wanted)
    row = newest_first.orderBy(F.asc("t"), F.desc("cache_key")).first()
    return row.t, row.cache_key


def evict(cache: DataFrame, max_entries: int) -> DataFrame:
    """Keep the newest ``max_entries`` keys (0 = keep all).

    Order is insertion time, newest first, ties broken on the key (Q20). The
    last row to stay is found by histograms, and what stays is a filter; the
    cache is never sorted. ``cache`` has one row per key and no null times.
    """
    if max_entries <= 0:
        return cache
    keys = store(cache.select("cache_key", "created_at"), "cache-keys")
    if keys.count() <= max_entries:
        return cache
    at, key = _last_kept(keys, max_entries)
    t = F.unix_micros("created_at")
    return cache.where((t > at) | ((t == at) & (F.col("cache_key") <= key)))


def stats(cache: DataFrame) -> DataFrame:
    """Entry count and total reply size in bytes."""
    return cache.agg(F.count(F.lit(1)).alias("entry_count"),
                     F.coalesce(F.sum(F.octet_length("response")), F.lit(0)).cast("long")
                     .alias("size_bytes"))


# --- the stored table --------------------------------------------------------

class JudgeCache:
    """A cache table in a folder (a shared file system on a cluster)."""

    def __init__(self, spark: SparkSession, path: str, max_entries: int = DEFAULT_MAX_ENTRIES):
        self.spark = spark
        self.path = path
        self.max_entries = max_entries
        self.journal = f"{path.rstrip('/')}/journal"  # see judge.Journal

    # generations -----------------------------------------------------------
    # The name of a generation carries its number, and it counts once its
    # marker file is there; both go through Spark's file system, so any storage
    # that the executors see will do.
    def _fs(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _generation(self) -> str | None:
        fs, path = self._fs()
        if not fs.exists(path):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        ready = [n.removesuffix(".ready") for n in names if n.startswith("gen-") and n.endswith(".ready")]
        return f"{self.path.rstrip('/')}/{ready[-1]}" if ready else None

    def _switch(self, name: str) -> None:
        fs, path = self._fs(f"{name}.ready")
        fs.create(path, True).close()

    def _new_generation(self) -> str:
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S.%f")
        return f"gen-{stamp}-{uuid.uuid4().hex[:8]}"

    # reads -----------------------------------------------------------------
    def table(self) -> DataFrame:
        gen = self._generation()
        if gen is None:
            return self.spark.createDataFrame([], JUDGE_CACHE)
        return self.spark.read.schema(JUDGE_CACHE).parquet(gen)

    def latest(self) -> DataFrame:
        return latest_per_key(self.table())

    # writes ----------------------------------------------------------------
    def append(self, replies: DataFrame) -> None:
        """Add ``(cache_key, response)`` rows stamped with the write time."""
        gen = self._generation()
        if gen is None:
            name = self._new_generation()
            gen = f"{self.path.rstrip('/')}/{name}"
            self.spark.createDataFrame([], JUDGE_CACHE).write.parquet(gen)
            self._switch(name)
        (replies.select("cache_key", "response",
                        F.current_timestamp().alias("created_at"))
         .write.mode("append").parquet(gen))

    def recover(self) -> None:
        """Take over the replies that a job stored and did not live to append."""
        if exists(self.spark, self.journal):
            left = self.spark.read.schema("cache_key string, response string") \
                .option("recursiveFileLookup", "true").parquet(self.journal)
            self.append(left)
            self.forget_journal()

    def forget_journal(self) -> None:
        delete(self.spark, self.journal)

    def _rewrite(self, keep: DataFrame) -> None:
        name = self._new_generation()
        keep.select("cache_key", "response", "created_at") \
            .write.mode("overwrite").parquet(f"{self.path.rstrip('/')}/{name}")
        self._switch(name)

    def clear(self) -> int:
        """Remove everything; returns the number of entries removed."""
        n = self.latest().count()
        self._rewrite(self.spark.createDataFrame([], JUDGE_CACHE))
        return n

    def purge(self, days: int) -> int:
        """Remove entries older than ``days``; returns how many went."""
        cur = self.latest()
        before = cur.count()
        self._rewrite(purge(cur, days))
        return before - self.latest().count()

    def evict(self, max_entries: int | None = None) -> int:
        """U8: keep the newest entries; returns how many went."""
        limit = self.max_entries if max_entries is None else max_entries
        cur = self.latest()
        before = cur.count()
        if limit <= 0 or before <= limit:
            return 0
        self._rewrite(evict(cur, limit))
        return before - limit

    def compact(self) -> None:
        """Rewrite to one row per key."""
        self._rewrite(self.latest())

    def stats(self) -> DataFrame:
        return stats(self.latest())
