"""Language identification by a byte convolutional network.

Bytes are embedded, convolved by filters of several widths, max-pooled over a
window and classified by softmax. The network is trained in numpy on windows
of a bounded sample of labelled documents (``sample`` per language, chosen by
a hash of doc_id; the crc32 fold 0 is never seen). A text is scored as the
whole of its windows, which lie end to end; for inference each filter becomes
sums of lookups in tables of byte pairs, so a window costs a few gathers.

Null text and text without a letter get ``und`` and score 0. Equal texts get
equal results. Labels, source and ids are read for training alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragscope.llm.common import documents, held_out, slices

WIDTHS = (2, 3, 4)
WINDOW = 128
LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def windows_of(text: str, size: int = WINDOW) -> np.ndarray:
    """The lower-cased text's bytes in rows of ``size``, zeros after the end."""
    data = text.lower().encode("utf-8", "surrogatepass")
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, size)


class ByteCnn:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, classes: list[str], dim: int = 8, filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        p = {"embed": rng.normal(0, 0.5, (256, dim)),
             "out": rng.normal(0, 0.1, (filters * len(WIDTHS), len(classes))), "out_b": np.zeros(len(classes))}
        for w in WIDTHS:
            p[f"conv{w}"] = rng.normal(0, (1.0 / (w * dim)) ** 0.5, (w * dim, filters))
            p[f"conv{w}_b"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _forward(self, x: np.ndarray):
        e = self.p["embed"][x]
        keep, pooled = [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            cols = np.concatenate([e[:, k:k + span] for k in range(w)], axis=2)
            a = cols @ self.p[f"conv{w}"] + self.p[f"conv{w}_b"]
            top = a.argmax(1)
            best = np.take_along_axis(a, top[:, None], 1)[:, 0]
            keep.append((cols, top, best))
            pooled.append(np.maximum(best, 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.p["out"] + self.p["out_b"]
        z = np.exp(z - z.max(1, keepdims=True))
        return keep, h, z / z.sum(1, keepdims=True)

    def _backward(self, x, y, weight):
        keep, h, prob = self._forward(x)
        d = prob.copy()
        d[np.arange(len(y)), y] -= 1
        d *= (weight / weight.sum())[:, None]
        g = {"out": h.T @ d, "out_b": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
        dh = d @ self.p["out"].T
        rows, dim = np.arange(len(x)), self.p["embed"].shape[1]
        for i, w in enumerate(WIDTHS):
            cols, top, best = keep[i]
            f = best.shape[1]
            da = dh[:, i * f:(i + 1) * f] * (best > 0)
            picked = cols[rows[:, None], top]  # window, filter, w * dim
            g[f"conv{w}"] = np.einsum("nfc,nf->cf", picked, da)
            g[f"conv{w}_b"] = da.sum(0)
            de = np.einsum("nf,cf->nfc", da, self.p[f"conv{w}"]).reshape(len(x), f, w, dim)
            for k in range(w):
                np.add.at(g["embed"], x[rows[:, None], top + k], de[:, :, k])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01,
            seed: int = 11) -> ByteCnn:
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.classes)).astype(np.float32)
        weight = (1.0 / np.maximum(share, 1))[y]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i:i + batch]
                step += 1
                for k, g in self._backward(x[rows], y[rows], weight[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * 0.6 ** epoch * (m[k] / (1 - 0.9 ** step))
                                  / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def compiled(self) -> dict:
        """Tables of filter responses to each byte pair; a filter of odd width
        ends in a table of single bytes."""
        e, tables = self.p["embed"], []
        for w in WIDTHS:
            dim, f = e.shape[1], self.p[f"conv{w}"].shape[1]
            part = [e @ self.p[f"conv{w}"][k * dim:(k + 1) * dim] for k in range(w)]
            part[0] = part[0] + self.p[f"conv{w}_b"]
            pairs = [(part[k][:, None] + part[k + 1][None]).reshape(65536, f).astype(np.float32)
                     for k in range(0, w - 1, 2)]
            tables.append((w, pairs, part[-1].astype(np.float32) if w % 2 else None))
        return {"classes": self.classes, "tables": tables, "out": self.p["out"], "out_b": self.p["out_b"]}


def window_log_probs(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-probabilities of the classes for rows of bytes."""
    pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
    pooled = []
    for w, pairs, single in model["tables"]:
        span = x.shape[1] - w + 1
        a = pairs[0].take(pair[:, :span], axis=0)
        for k, table in enumerate(pairs[1:], 1):
            a += table.take(pair[:, 2 * k:2 * k + span], axis=0)
        if single is not None:
            a += single.take(x[:, w - 1:w - 1 + span], axis=0)
        pooled.append(np.maximum(a.max(1), 0))
    z = np.concatenate(pooled, axis=1) @ model["out"] + model["out_b"]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(docs: DataFrame, sample: int = 400, windows: int = 6) -> dict:
    """Train on at most ``sample`` documents of each language outside fold 0 and
    ``windows`` windows of each, spread evenly over the whole text. The bounds
    limit what the driver sees; every language of a labelled row is learned.

    Documents are chosen by a hash: those below a limit that leaves about twice
    ``sample`` of each language, then the ``sample`` smallest of these, so that
    no task holds a language's rows."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = [r.lang for r in counts.orderBy("lang").select("lang").collect()]
    if not langs:
        return {"classes": [], "tables": [], "out": None, "out_b": None}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # one row a class: less than the network's last layer, which each task holds
    some = (known.withColumn("share", share).join(F.broadcast(counts), "lang").where(F.col("share") * F.col("n") <= 2 * sample + 100)
            .select("lang", "share", "text", F.length("text").alias("size")))
    place = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(
        "text", (F.greatest(F.col("size") - WINDOW, F.lit(0)) * i / max(windows - 1, 1)).cast("int") + 1, F.lit(WINDOW)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("share", "pieces"))
    picked = (some.select("lang", "share", F.array_distinct(place).alias("pieces")).withColumn("rank", rank)
              .where(F.col("rank") <= sample).orderBy("lang", "rank").select("lang", "pieces"))
    rows = picked.collect()
    x, y = [], []
    place = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        for piece in r.pieces:
            if LETTER.search(piece):
                x.append(windows_of(piece)[:1])
                y.append(place[r.lang])
    if not x:
        return {"classes": [], "tables": [], "out": None, "out_b": None}
    return ByteCnn(langs).fit(np.concatenate(x), np.array(y)).compiled()


def predict_texts(model: dict, texts: list[str | None], chunk: int = 2048) -> tuple[list[str], list[float]]:
    """The language and score of each text, from all its windows."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and model["classes"] and LETTER.search(t)]
    total = np.zeros((len(rows), len(model["classes"])))
    count = np.zeros(len(rows))
    held, owner, n = [], [], 0

    def flush():
        x, who = np.concatenate(held), np.concatenate(owner)
        np.add.at(total, who, np.concatenate([window_log_probs(model, x[i:i + chunk]) for i in range(0, len(x), chunk)]))
        np.add.at(count, who, 1)

    for k, i in enumerate(rows):
        w = windows_of(texts[i])
        held.append(w)
        owner.append(np.full(len(w), k))
        n += len(w)
        if n >= 8 * chunk:
            flush()
            held, owner, n = [], [], 0
    if n:
        flush()
    if rows:
        mean = total / count[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        for k, i in enumerate(rows):
            names[i], scores[i] = model["classes"][best[k]], float(prob[k, best[k]])
    return names, scores


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables, whatever the input

    def run(batches):
        for batch in slices(batches):
            names, scores = predict_texts(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_recognised(docs: DataFrame, model: dict, least: float) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least``
    or more, all columns as they are; no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            names, scores = predict_texts(shared.value, batch.column("text").to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
