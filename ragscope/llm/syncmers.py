"""Document fingerprints from closed syncmers.

The k-mers are runs of ``k`` words and the inner substrings runs of ``s``
words. A k-mer is an anchor if the smallest hash among its inner substrings is
that of the first or of the last one. That depends on the k-mer alone, so an
anchor survives any edit that does not touch it, wherever it moves. The
fingerprint lists the anchors in text order with their hashes; likeness is the
Jaccard similarity of two fingerprints' anchors.

A text of fewer than ``k`` words is one anchor of all its words; a null, empty
or blank text has none, and two such texts are alike (1). All of it is built-in
expressions; nothing runs in Python. The edited text of a document takes its
second half from the next document in descending doc_id; rows with a null
doc_id come after all others, rows with equal ids in the order of a hash of
their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragscope.llm.common import documents

K, S = 6, 2


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text, in its order: array of (pos, hash)."""
    def of_words(w: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.size(w) - (s - 1)), lambda i: F.xxhash64(F.slice(w, i, s)))

        def of_hashes(h: Column) -> Column:
            runs = F.transform(F.sequence(F.lit(1), F.size(h) - (k - s)),
                               lambda i: F.struct(i.alias("pos"), F.slice(h, i, k - s + 1).alias("run")))
            edge = F.filter(runs, lambda r: (F.array_min(r["run"]) == r["run"][0])
                            | (F.array_min(r["run"]) == r["run"][k - s]))
            return F.transform(edge, lambda r: F.struct(r["pos"].alias("pos"), F.xxhash64(r["run"]).alias("hash")))

        whole = F.array(F.struct(F.lit(1).alias("pos"), F.xxhash64(w).alias("hash")))
        return (F.when(F.size(w) >= k, _with(inner, of_hashes)).when(F.size(w) > 0, whole)
                .otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>")))

    return _with(words(text), of_words)


def _with(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda a: a["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        both / (F.size(a) + F.size(b) - both).cast("double"))


def as_text(found: Column) -> Column:
    """A fingerprint as text: the hashes in hexadecimal, in text order."""
    return F.concat_ws(" ", F.transform(found, lambda a: F.lower(F.hex(a["hash"]))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the next document's text, descending doc_id.

    Documents are cut into ranges of doc_id, one window each; the first
    document of a range is copied to the end of the range before it, so the
    texts move once and no window holds more than a range.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    # the number of cuts up to doc_id, by halving
    table = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    part = F.lit(0)
    if cuts:
        steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
        part = F.aggregate(steps, F.lit(0), lambda lo, b: F.when(
            (lo + b <= len(cuts)) & (F.get(table, lo + b - 1) <= F.col("doc_id")), lo + b).otherwise(lo))
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part)
    keyed = docs.select("doc_id", "text", part.alias("part"))
    # the largest id of each range: a row per range
    heads = sorted((r.part, r.head) for r in keyed.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    # range -> the head that follows it (the ranges descend, and wrap around)
    follows = [(p, heads[i - 1][1], heads[i - 1][0]) for i, (p, _) in enumerate(heads)]
    moved = spark.createDataFrame(follows, "to int, head long, of int")
    order = [F.desc("doc_id"), F.xxhash64("text")]
    head = keyed.join(F.broadcast(moved), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")))
    # of rows with equal ids the first counts
    head = head.groupBy("to").agg(F.min_by(F.struct("doc_id", "text"), F.xxhash64("text")).alias("r")).select(
        F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"), F.col("to").alias("part"), F.lit(1).alias("extra"))
    rows = keyed.withColumn("extra", F.lit(0)).unionByName(head)
    w = Window.partitionBy("part").orderBy("extra", *order)
    return rows.select("doc_id", "text", "extra", F.lead("text").over(w).alias("next_text")).where("extra = 0").drop("extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited text, and the anchors of the text, of the edited and
    of the next document's text."""
    pairs = with_next(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("next_text", F.lit("")).alias("next_text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return pairs.select("doc_id", "text", edited.alias("edited"), anchors(F.col("text")).alias("own"),
                        anchors(edited).alias("changed"), anchors(F.col("next_text")).alias("following"))


def op6_syncmers(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text."""
    return fingerprints(documents(spark, sf_dir)).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(hashes(F.col("own")), hashes(F.col("changed"))).alias("near_edited"),
        likeness(hashes(F.col("own")), hashes(F.col("following"))).alias("near_next"))
