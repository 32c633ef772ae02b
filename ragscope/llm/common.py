"""Helpers shared by the training-data operators.

``materialize`` cuts lineage through a Parquet table in the folder that
``spark.checkpoint.dir`` names, so a lost executor costs a reread instead of a
recomputation, and the table's size on disk is known to the planner (Spark
broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.session import checkpoint_dir

FOLDS = 5


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Nothing needs the shuffles behind the table any more, but Spark deletes
    # their files only when the driver's garbage collector has run.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows whose labels no model may learn (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m"):
    """Tables that are written within it go to Python in small record batches:
    a batch stands in the executor and in its worker, for each core."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def give_back() -> None:
    """A worker goes on to other tasks: what this one is done with goes back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short runs, so that a worker holds few texts as Python
    strings at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts as Python strings; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over a uint64 array (wraps on overflow)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D
_UNSTEP = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWER_CACHE.get(base)
    if have is None or len(have) < n:
        have = _POWER_CACHE[base] = _powers(base, max(n, 1 << 16))
    return have[:n]


def word_hashes(text: str, lower: bool) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """A 64-bit hash for every word of ``text`` (runs free of ASCII white space).

    Returns the hashes, the UTF-8 bytes, and each word's byte start and end.
    ``lower`` folds A-Z only. A word's hash depends on its bytes alone, so
    equal words have equal hashes in any text and on any machine.
    """
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64), data, start, end
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * powers(_STEP, n), out=total[1:])
    h = (total[end] - total[start]) * powers(_UNSTEP, n)[start]
    return mix64(h + (end - start).astype(np.uint64)), data, start, end


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for every run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, unbase = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(base, len(words)), out=total[1:])
    return mix64((total[size:] - total[:-size]) * powers(unbase, n))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``: the smallest id reachable.

    Alternating large-star and small-star rounds; each is one aggregation by
    node (map-side combined minimum) and a join that Spark may split on a hot
    node. Rounds grow with the logarithm of the longest path. Every round is
    written to the shared folder. Self-edges keep a node in the result.
    """
    nodes = materialize(edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node")))
                        .where("node IS NOT NULL").distinct(), "cc-nodes")
    e = materialize(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
                    .where("lo < hi").distinct(), "cc-edges")
    while True:
        # large star: a node's larger neighbours move to its smallest neighbour
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = materialize(large.where("lo < hi").distinct(), "cc-large")
        discard(e)
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        moved = large.join(low, large.hi == low.u)
        small = moved.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").union(
            low.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct()
        nxt = materialize(small, "cc-small")
        discard(large)
        # done when every edge joins a node to a root: no node is both
        if nxt.join(nxt.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").isEmpty():
            parents = nxt.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"),
                                                                 F.count_distinct("lo").alias("k"))
            if parents.where("k > 1").isEmpty():
                break
        e = nxt
    return nodes.join(parents, "node", "left").select("node", F.coalesce("m", "node").alias("component"))
