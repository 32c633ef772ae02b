"""Near-duplicate vectors: iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample (``sample`` vectors by a hash of
vec_id): principal axes, then alternating between the sign codes and the
rotation that fits them best (an orthogonal Procrustes step); each bit is cut
at the sample's median, so codes are balanced. The codes of several rotations
make one long code, which is split into substrings; every substring indexes a
table of all vectors, and vectors that agree in a substring are candidates.
Substring length follows the number of vectors. The number of tables is what
the length and the wanted recall ask for if bits differed by the angle alone
(``tables``), and more until pairs at the threshold, made from the sample, meet
with that recall under the learned bits (a mean that all vectors share makes
bits differ more often); where that takes too many, substrings get shorter.
Candidates are reranked by the cosine of the original vectors in double
precision, as one matrix product per bucket; a pair counts in the first table
in which it meets, so nothing is counted twice and no pair is ever a row.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing. Equal vectors are one vector with a multiplicity. Vectors of
different lengths never link. A bucket of many vectors is cut into chunks and
its pairs of chunks spread over the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.llm.common import connected_components, materialize

CHUNK = 1024  # vectors of a bucket in one matrix product
BUCKET = 256  # vectors a bucket if codes were spread evenly: fewer, fuller buckets need fewer tables
MOST = 256  # tables beyond which codes get shorter instead, where bits agree less than the angle says


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that can link."""
    v = F.transform(column, lambda x: x.cast("double"))
    sound = (F.col(column).isNotNull() & (F.size(column) > 0)
             & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists(column, lambda x: x != 0))
    return vectors.where(F.col("vec_id").isNotNull() & sound).select("vec_id", v.alias("v"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tables(length: int, cosine: float, recall: float) -> int:
    """Substrings of ``length`` bits with which a pair at the threshold meets
    with probability ``recall``, bits differing independently by the angle."""
    meet = (1 - math.acos(cosine) / math.pi) ** length
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def learn(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, projection and thresholds of ``bits`` bits, from unit vectors."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred if len(centred) >= x.shape[1] else
                               np.vstack((centred, np.zeros((x.shape[1] - len(centred), x.shape[1])))), full_matrices=False)
    parts, left = [], bits
    while left > 0:
        low = centred @ axes.T
        r = np.linalg.qr(rng.normal(size=(axes.shape[0], axes.shape[0])))[0]
        for _ in range(rounds):
            code = np.where(low @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(code.T @ low)
            r = (u @ w).T
        parts.append((axes.T @ r)[:, :left])
        left -= parts[-1].shape[1]
    projection = np.concatenate(parts, axis=1)
    return mean, projection, np.median(centred @ projection, axis=0)


def substrings(x: np.ndarray, model: dict) -> np.ndarray:
    """One integer per vector and table."""
    bits = (unit_rows(x) - model["mean"]) @ model["projection"] >= model["cut"]
    bits = bits.reshape(len(x), model["tables"], model["length"])
    return bits @ (np.int64(1) << np.arange(model["length"], dtype=np.int64))


def threshold_pairs(x: np.ndarray, cosine: float, least: int = 8192, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at exactly ``cosine``: unit vectors with themselves moved in random
    directions, and towards other vectors of ``x``."""
    rng = np.random.default_rng(seed)
    x = np.tile(x, (math.ceil(least / len(x)), 1))
    out = []
    for d in (rng.normal(size=x.shape), x[rng.permutation(len(x))]):
        d = d - (d * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(d, axis=1, keepdims=True)
        ok = size[:, 0] > 1e-6
        if ok.any():
            out.append((x[ok], cosine * x[ok] + math.sqrt(1 - cosine * cosine) * d[ok] / size[ok]))
    return out


def met(pairs: list[tuple[np.ndarray, np.ndarray]], model: dict) -> float:
    """The share of the pairs that meet in a table; the smallest of the kinds of pairs."""
    return min(((substrings(a, model) == substrings(b, model)).any(1).mean() for a, b in pairs), default=1.0)


def fit(distinct: DataFrame, count: int, width: int, cosine: float, recall: float, sample: int) -> dict:
    h = F.xxhash64("vec_id")
    # what could be among the first: twice the sample, or all of a small table,
    # so that no task sends a sample of its own
    share = min(1.0, (2 * sample + 100) / max(count, 1))
    first = distinct.where((F.size("v") == width) & (h <= int(-(2**63) + share * (2**64 - 2048))))
    rows = first.orderBy(h, "vec_id").limit(sample).select("v").collect()
    x = unit_rows(np.array([r.v for r in rows]))
    pairs = threshold_pairs(x, cosine)
    length = min(30, max(6, round(math.log2(max(count, 2) / BUCKET))))
    learned, had = None, 0
    while True:
        k = tables(length, cosine, recall)
        most = max(MOST, k)
        while True:
            if length * k > had:  # more bits leave the first ones as they are
                learned, had = learn(x, length * k), length * k
            mean, projection, cut = learned
            model = {"mean": mean, "projection": projection[:, :length * k], "cut": cut[:length * k], "tables": k,
                     "length": length}
            got = met(pairs, model)
            if got >= recall or k == most:
                break
            need = math.log(1 - recall) / math.log(1 - got) if got > 0 else most
            k = min(most, max(k + 1, math.ceil(k * min(need, most))))
        if got >= recall or length == 1:
            return model
        length -= 1  # fuller buckets instead of a lower recall


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    """vec_id, many, codes, unit vectors and chunk of a bucket's rows."""
    def flat(name):
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    ids, many, chunk = (table.column(c).to_numpy() for c in ("vec_id", "many", "chunk"))
    return ids, many, flat("codes"), unit_rows(flat("v")), chunk


def _block(left: tuple, right: tuple | None, table: int, cosine: float):
    """Links in a bucket: per vector the number of linked vectors and a label."""
    ia, ma, ca, xa = left
    ib, mb, cb, xb = left if right is None else right
    link = xa @ xb.T >= cosine
    if right is None:
        np.fill_diagonal(link, False)
    if not link.any():
        return []
    for j in range(table):  # met before
        link &= ca[:, j][:, None] != cb[:, j][None]
    if not link.any():
        return []
    big = np.iinfo(np.int64).max
    a, b = ia.copy(), ib.copy()
    while True:
        a2 = np.minimum(a, np.where(link, b[None], big).min(1, initial=big))
        b2 = np.minimum(b, np.where(link, a2[:, None], big).min(0, initial=big))
        if right is None:
            a2 = b2 = np.minimum(a2, b2)
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    out = [(ia, (link * mb[None]).sum(1), a)]
    if right is not None:
        out.append((ib, (link * ma[:, None]).sum(0), b))
    return out


def links(distinct: DataFrame, model: dict, cosine: float) -> DataFrame:
    """(vec_id, n, label): per bucket, how many vectors each one links with
    there, and the smallest vector it reaches there."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)
    k, width = model["tables"], len(model["mean"])

    def encode(batches):
        for batch in batches:
            v = batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            codes = substrings(flat, shared.value) if len(flat) else np.empty((0, k), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("many"), v,
                 pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * k, pa.int32()), pa.array(codes.ravel(), pa.int64()))],
                names=["vec_id", "many", "v", "codes"])

    coded = materialize(distinct.where(F.size("v") == width).select("vec_id", "many", "v").mapInArrow(
        encode, "vec_id long, many long, v array<double>, codes array<long>"), "codes")
    index = coded.select("vec_id", F.posexplode("codes").alias("table", "code"))
    sizes = (index.groupBy("table", "code").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
             .select("table", "code", F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks")))
    placed = (coded.select("*", F.posexplode("codes").alias("table", "code")).join(sizes, ["table", "code"])
              .withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")))

    def compare(key, table):
        *rows, chunk = _arrays(table)
        j, lo, hi = key[0].as_py(), key[2].as_py(), key[3].as_py()
        if lo == hi:
            out = _block(rows, None, j, cosine)
        else:
            left, right = ([x[chunk == c] for x in rows] for c in (lo, hi))
            out = _block(left, right, j, cosine) if len(left[0]) and len(right[0]) else []
        ids, n, label = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))
        some = n > 0
        return pa.table({"vec_id": ids[some], "n": n[some].astype(np.int64), "label": label[some]})

    return placed.select("table", "code", "lo", "hi", "vec_id", "many", "codes", "v", "chunk").groupBy(
        "table", "code", "lo", "hi").applyInArrow(compare, "vec_id long, n long, label long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, sample: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    vectors = vectors.select("vec_id", "embedding")
    good = usable(vectors)
    classes = materialize(good.withColumn("sig", F.sha2(F.to_json("v").cast("binary"), 256)).select("vec_id", "sig", "v"),
                          "vectors")
    many = classes.groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    many = materialize(many, "classes")
    distinct = materialize(classes.join(many.select(F.col("rep").alias("vec_id"), "many", F.col("sig").alias("s")),
                                        ["vec_id"]).where("sig = s").select("vec_id", "v", "many")
                           .dropDuplicates(["vec_id"]), "distinct")
    widths = [r for r in distinct.groupBy(F.size("v").alias("w")).count().collect()]
    found = None
    for r in widths:
        model = fit(distinct, r["count"], r.w, cosine, recall, sample)
        one = links(distinct, model, cosine)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                              F.col("vec_id").isNotNull().alias("kept"))
    found = materialize(found, "links")
    cc = connected_components(found.select(F.col("vec_id").alias("a"), F.col("label").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    rep = (many.join(counts, many.rep == counts.vec_id, "left").select("sig", "rep", "many", F.coalesce("n", F.lit(0)).alias("n"))
           .join(cc, F.col("rep") == cc.node, "left")
           .select("sig", (F.col("n") + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    own = classes.select("vec_id", "sig").join(rep, "sig").select("vec_id", "n_links", "component_id")
    alone = vectors.where(F.col("vec_id").isNull()).unionByName(
        vectors.join(good.select("vec_id"), "vec_id", "left_anti").where("vec_id IS NOT NULL"))
    rest = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
