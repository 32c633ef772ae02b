"""Repeated passages across documents, by level-wise doubling.

A passage is a window of consecutive words. Level 0 looks at windows of half
the wanted length; those whose word sequence occurs in one document only are
dropped, and windows of twice that length are formed only around what is left.
At level 0 it is enough to look at the smallest hash among the half windows
that a window holds: equal windows choose the same one. What to remove is known
at ``window`` words, so ``remove_repeats`` stops there; ``longest_repeats`` goes
on doubling from there until no candidate survives.

A word goes when a window that covers it also starts in a document with a
smaller doc_id; windows are judged on the input as it came. Words are compared
by 64-bit hashes of their bytes, and what survives a level is named by its hash
and not by its place: rows that repeat a doc_id, with equal or different texts,
are one document, and each row finds its own places. A null text has no words;
a text shorter than the window keeps all of them; a null doc_id sorts after
every other and takes no part in the comparison. Input columns called n_words,
n_removed or kept are replaced, all others pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.llm.common import as_long, discard, documents, materialize, slices, texts_of, window_hashes, word_hashes


def chosen_halves(half_hash: np.ndarray, span: int) -> np.ndarray:
    """For each window, where the smallest of the ``span`` half windows in it begins."""
    n = len(half_hash) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    for i in range(0, n, 1 << 16):  # bounded scratch for very long texts
        j = min(n, i + (1 << 16))
        view = np.lib.stride_tricks.sliding_window_view(half_hash[i:j + span - 1], span)
        out[i:j] = view.argmin(1) + np.arange(i, j)
    return out


#: A hash is heavy when it holds more than this share of the rows of repeated
#: hashes, so there are at most that many heavy ones.
HEAVY_SHARE = 1024


def arrays(ids: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """(doc_id, h) with the distinct hashes of each text as one array."""
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([as_long(np.unique(h)) for h in hashes], pa.list_(pa.int64()))],
        names=["doc_id", "h"])


def level_zero(docs: DataFrame, window: int) -> DataFrame:
    """(h, doc_id): the half windows that some window chooses."""
    half = (window + 1) // 2

    def run(batches):
        for batch in slices(batches):
            ids, hashes = [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                words, _, _, _ = word_hashes(text, lower=False)
                if key is None or len(words) < window:
                    continue
                h = window_hashes(words, half)
                hashes.append(np.unique(h[chosen_halves(h, window - half + 1)]))
                ids.append(np.full(len(hashes[-1]), key, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.concatenate(hashes))), pa.array(np.concatenate(ids))], names=["h", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


def repeated(rows: DataFrame) -> DataFrame:
    """(h, doc_id, first_doc): the rows whose hash occurs in more than one
    document, with the smallest of these.

    The smallest documents are found by a map-side combined aggregation. Rows of
    heavy hashes then meet them by a broadcast of at most ``HEAVY_SHARE`` rows
    and are dealt over all tasks; the others meet them in a shuffle by hash.
    """
    first = materialize(rows.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
                                              F.count("*").alias("n")).where("first_doc < last_doc"), "firsts")
    total = first.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY_SHARE > F.lit(total)
    hot = F.broadcast(first.where(heavy).select("h", F.col("first_doc").alias("hot_doc")))
    # a heavy hash's rows carry a number that no row of the other side has
    spread = F.when(F.col("hot_doc").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    rest = first.where(~heavy).select("h", F.lit(0).cast("long").alias("deal"), "first_doc")
    return (rows.join(hot, "h", "left").withColumn("deal", spread.cast("long")).join(rest, ["h", "deal"], "left")
            .select("h", "doc_id", F.coalesce("hot_doc", "first_doc").alias("first_doc")).where("first_doc IS NOT NULL"))


def gathered(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, seen): each document's distinct hashes among ``rows``, as a table."""
    return materialize(rows.groupBy("doc_id").agg(F.collect_set("h").alias("seen")), name)


def is_in(hashes: np.ndarray, seen: list[int]) -> np.ndarray:
    return np.isin(as_long(hashes), np.array(seen, np.int64))


def extended(docs: DataFrame, survivors: DataFrame, short: int, long: int, chosen: bool) -> DataFrame:
    """(h, doc_id): the windows of ``long`` words around windows of ``short`` words
    that survived: its chosen one (``chosen``), or those at both its ends."""
    def run(batches):
        for batch in slices(batches):
            ids, hashes = [], []
            for key, text, seen in zip(batch.column("doc_id").to_pylist(), texts_of(batch),
                                       batch.column("seen").to_pylist(), strict=True):
                words, _, _, _ = word_hashes(text, lower=False)
                if len(words) < long:
                    continue
                h = window_hashes(words, short)
                alive = is_in(h, seen)
                n = len(words) - long + 1
                at = alive[chosen_halves(h, long - short + 1)] if chosen else alive[:n] & alive[long - short:]
                if at.any():
                    ids.append(key)
                    hashes.append(window_hashes(words, long)[at])
            yield arrays(ids, hashes)

    return docs.select("doc_id", "text").join(survivors, "doc_id").mapInArrow(run, "doc_id long, h array<long>")


def one_a_row(work: DataFrame) -> DataFrame:
    return work.select(F.explode("h").alias("h"), "doc_id")


def covered(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``places``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(h, doc_id, first_doc): the windows of ``window`` words that repeat."""
    halves = gathered(repeated(level_zero(docs, window)), "halves")
    work = materialize(extended(docs, halves, (window + 1) // 2, window, True), "windows")
    discard(halves)
    return repeated(one_a_row(work))


def longest_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, longest long): the greatest of ``window``, 2 * window, 4 * window,
    ... words of which the document shares a passage with another document, for
    the documents that share any. A level ends the loop when nothing survives."""
    docs = docs.select("doc_id", "text")
    survivors = gathered(repeated_windows(docs, window), "level")
    reached, size = survivors.select("doc_id", F.lit(window).cast("long").alias("longest")), window
    while not survivors.isEmpty():
        work = materialize(extended(docs, survivors, size, 2 * size, False), "windows")
        survivors = gathered(repeated(one_a_row(work)), "level")
        size *= 2
        reached = reached.unionByName(survivors.select("doc_id", F.lit(size).cast("long").alias("longest")))
    return reached.groupBy("doc_id").agg(F.max("longest").alias("longest"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the columns n_words, n_removed and kept (the words that
    stay, joined by one blank); a text that loses nothing is its own kept."""
    gone = repeated_windows(docs.select("doc_id", "text"), window).where("first_doc < doc_id")
    repeats = gathered(gone, "repeats").withColumnRenamed("seen", "windows_that_repeat")
    fields = [f for f in docs.schema if f.name.lower() not in ("n_words", "n_removed", "kept")]
    names = [f.name for f in fields]

    def run(batches):
        for batch in slices(batches):
            count, removed, kept = [], [], []
            for text, seen in zip(texts_of(batch), batch.column("windows_that_repeat").to_pylist(), strict=True):
                words, data, start, end = word_hashes(text, lower=False)
                gone = np.zeros(len(words), bool)
                if seen:
                    gone = covered(len(words), np.flatnonzero(is_in(window_hashes(words, window), seen)), window)
                left = b" ".join([data[i:j] for i, j in zip(start[~gone].tolist(), end[~gone].tolist())])
                count.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(left.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(count, pa.int64()), pa.array(removed, pa.int64()),
                                                    pa.array(kept, pa.string())],
                names=[*names, "n_words", "n_removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.join(repeats, "doc_id", "left").select(*[f"`{n}`" for n in names], "windows_that_repeat").mapInArrow(
        run, f"{schema}, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Passages of 50 words that repeat across documents, removed but once."""
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
