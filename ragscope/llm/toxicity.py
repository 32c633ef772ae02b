"""Toxicity by the nearest labelled examples under TF-IDF cosine.

A bounded sample of labelled texts (``per_class`` of each label, chosen by a
hash of doc_id, never from the held-out fold) gives the examples, and all their
words are the terms: words that no example holds are in no dot product. Document
frequencies of the terms come from all documents; each term is weighted by how
strongly it goes with the label too (plain TF-IDF lets the topic of a text
decide). A text's neighbours are exact: its similarity to every example is
summed, for ``BATCH`` texts at once. Terms of very many examples are a matrix
that the texts are multiplied with, all others posting lists. The largest
similarity in every block of examples gives a floor under the k-th, and only
what reaches the floor is sorted. Votes are weighted by the inverse square of the distance and by how thinly each class was
sampled, and a logistic fit over the examples' own leave-one-out votes
calibrates them. The neighbours are the evidence.

Null and empty texts and texts without any term have no neighbours: they get
the share of toxic rows among the labelled ones. Ties in similarity go to the
example with the smaller doc_id. Several label rows of one document count each.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.llm.common import documents, held_out, slices, texts_of

BLOCK = 8
BATCH = 64  # texts that are looked up at once
FEW = 4  # of them, texts whose postings are added up at once, so that sums stay in a core's cache
FREQUENT = 512  # terms of the matrix, at most
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> Counter:
    """A text's lower-cased words of letters, and how often each occurs."""
    return Counter(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


class TermReader:
    """Counts the terms of texts."""

    def __init__(self, terms: list[bytes]):
        self.index = {t: i for i, t in enumerate(terms)}

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms of each text, in rising order: number of the text, term, how often."""
        get, n = self.index.get, len(self.index)
        found = []
        for k, text in enumerate(texts):
            words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
            terms = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            found.append(terms[terms >= 0] + k * n)
        key = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first] // max(n, 1), key[first] % max(n, 1), np.diff(first, append=len(key))

    def vectors(self, texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' unit TF-IDF vectors over the terms: number of the text, term, weight."""
        doc, term, n = self.counts(texts)
        weight = (1 + np.log(n)) * idf[term]
        norm = np.sqrt(np.bincount(doc, weight * weight, len(texts)))[doc]
        some = norm > 0
        return doc[some], term[some], weight[some] / norm[some]

    def vector(self, text: str, idf: np.ndarray) -> dict[int, float]:
        """One text's vector."""
        _, term, weight = self.vectors([text], idf)
        return dict(zip(term.tolist(), weight.tolist()))


def sample_examples(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``per_class`` labelled texts a class."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    picked = None
    for y in (0, 1):
        one = known.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(per_class).select("doc_id", "toxic")
        picked = one if picked is None else picked.unionByName(one)
    # at most 2 * per_class ids: their size is bounded by the parameter
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def example_terms(examples: DataFrame, taken: dict[int, int]) -> tuple[list[bytes], np.ndarray]:
    """Every term of the examples, frequent ones first (they are looked up most),
    and how strongly its presence goes with the label: the phi coefficient
    without its sign, 0 to 1 at any number of examples."""
    def run(batches):
        seen = ({}, {})
        for batch in slices(batches):
            for y, text in zip(batch.column("toxic").to_pylist(), texts_of(batch), strict=True):
                for t in words_of(text):
                    seen[y][t] = seen[y].get(t, 0) + 1
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(both, pa.binary()), pa.array([seen[0].get(t, 0) for t in both], pa.int64()),
             pa.array([seen[1].get(t, 0) for t in both], pa.int64())], names=["term", "clean", "toxic"])

    rows = (examples.select("toxic", "text").mapInArrow(run, "term binary, clean long, toxic long")
            .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).orderBy("term").toArrow())
    rows = rows.take(np.argsort(-(rows["clean"].to_numpy() + rows["toxic"].to_numpy()), kind="stable"))
    b, a = (rows[c].to_numpy().astype(float) for c in ("clean", "toxic"))
    n0, n1 = taken[0], taken[1]
    absent = np.maximum(n0 + n1 - a - b, 0.5)  # a term of every example says nothing
    return rows["term"].to_pylist(), np.abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt((a + b) * absent * n0 * n1)


def document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many each term occurs: all of them."""
    def count(batches):
        reader = TermReader(terms)
        found = np.zeros(len(terms) + 1, np.int64)
        for batch in slices(batches):
            found[-1] += batch.num_rows
            np.add.at(found, reader.counts(texts_of(batch))[1], 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["i", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    rows = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out[rows["i"].to_numpy()] = rows["n"].to_numpy()
    return int(out[-1]), out[:-1]


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and their lengths."""
    lengths = end - start
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - lengths), lengths), lengths


def lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of ``n`` owners, which are in rising order, as a list."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values))


def vector_arrays(vectors: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and sizes of the vectors that have terms; their terms and
    weights, one vector after the other."""
    sizes = pc.list_value_length(vectors["t"]).to_numpy().astype(np.int64)
    some = sizes > 0
    return (vectors["doc_id"].to_numpy()[some], vectors["toxic"].to_numpy().astype(np.int64)[some], sizes[some],
            pc.list_flatten(vectors["t"]).to_numpy().astype(np.int64), pc.list_flatten(vectors["w"]).to_numpy())


class BlockMaxIndex:
    """Labelled examples as a matrix of frequent terms and posting lists; of the
    similarities to a text, the maximum of every block leads to the nearest."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, vectors: pa.Table, priors: tuple[float, float],
                 neighbours: int):
        """``vectors``: doc_id, toxic, t and w, an example's terms and their weights."""
        self.terms, self.idf, self.k, self.priors = terms, idf, neighbours, priors
        ids, labels, sizes, term, weight = vector_arrays(vectors)
        owner = np.repeat(np.arange(len(ids)), sizes)
        places = np.lexsort((labels, ids))
        self.ids, self.labels = ids[places], labels[places]
        self.width = max(1, -(-len(ids) // 64)) * 64  # whole tiles of a product
        # postings of a term stand together, by example
        rank = np.empty(len(ids), np.int64)
        rank[places] = np.arange(len(ids))
        example = rank[owner]
        order = np.lexsort((example, term))
        self.offsets = np.searchsorted(term[order], np.arange(len(terms) + 1))
        self.posts, self.values = example[order].astype(np.int32), weight[order]
        self.coef = np.zeros(3)
        self.base = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("reader", "frequent")}

    @cached_property
    def reader(self) -> TermReader:
        """Made once by each worker."""
        return TermReader(self.terms)

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of each term in the matrix (or -1), and the matrix: weights
        of terms that very many examples hold, by term and example."""
        found = np.diff(self.offsets)
        chosen = np.flatnonzero(found > len(self.ids) / 16)
        chosen = np.sort(chosen[np.argsort(-found[chosen], kind="stable")[:FREQUENT]])
        place = np.full(len(self.terms), -1)
        place[chosen] = np.arange(len(chosen))
        at, lengths = ranges(self.offsets[chosen], self.offsets[chosen + 1])
        matrix = np.zeros((len(chosen), self.width))
        matrix[np.repeat(np.arange(len(chosen)), lengths), self.posts[at]] = self.values[at]
        return place, matrix

    @property
    def examples(self) -> list[np.ndarray]:
        """Each term's examples."""
        return np.split(self.posts, self.offsets[1:-1])

    @property
    def weights(self) -> list[np.ndarray]:
        """Each term's weight in its examples."""
        return np.split(self.values, self.offsets[1:-1])

    def nearest(self, v: dict[int, float], skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples of one vector and their cosines, exactly."""
        terms = np.fromiter(v, np.int64, len(v))
        order = np.argsort(terms)
        weights = np.fromiter(v.values(), np.float64, len(v))[order]
        return self.nearest_of(np.zeros(len(v), np.int64), terms[order], weights, None if skip is None else [skip])[1:]

    def nearest_of(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray,
                   skip: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k most similar examples of at most ``BATCH`` vectors (see
        ``TermReader.vectors``) and their cosines, exactly: number of the
        vector, example, cosine. ``skip``: an id for each that does not count."""
        if not len(doc) or not len(self.ids):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        place, matrix = self.frequent
        # of one shape whatever the texts, so that equal vectors have equal sums
        q = np.zeros((BATCH, len(matrix)))
        at = place[term]
        dense = at >= 0
        q[doc[dense], at[dense]] = weight[dense]
        total = q @ matrix
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        ends = np.searchsorted(doc, np.arange(0, BATCH + 1, FEW))
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            at, lengths = ranges(self.offsets[term[a:b]], self.offsets[term[a:b] + 1])
            cells = np.repeat((doc[a:b] - i * FEW) * self.width, lengths) + self.posts[at]
            total[i * FEW:(i + 1) * FEW] += np.bincount(
                cells, np.repeat(weight[a:b], lengths) * self.values[at], FEW * self.width).reshape(FEW, -1)
        if skip is not None:
            total[np.nonzero(self.ids == np.array(skip)[:, None])] = 0
        # the k-th block's maximum is no larger than the k-th similarity
        maxima = total.reshape(BATCH, BLOCK, -1).max(1)
        k = maxima.shape[1] - self.k
        floor = np.partition(maxima, k, axis=1)[:, k:k + 1] - 1e-9 if k >= 0 else 0
        doc, rows = np.nonzero(total > np.maximum(floor, 0))
        cos = np.round(total[doc, rows], 12)
        order = np.lexsort((self.ids[rows], -cos, doc))
        order = order[np.arange(len(doc)) - np.searchsorted(doc, doc) < self.k]
        return doc[order], rows[order], cos[order]

    def features(self, doc: np.ndarray, rows: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors that have neighbours; for each, log-odds of the
        distance-weighted vote, and the closeness it rests on."""
        some, first = np.unique(doc, return_index=True)
        weight = 1.0 / (1.02 - np.minimum(cos, 1.0)) ** 2
        y = self.labels[rows]
        yes = np.bincount(doc, weight * (y == 1), BATCH)[some] * self.priors[1] + 1e-3
        no = np.bincount(doc, weight * (y == 0), BATCH)[some] * self.priors[0] + 1e-3
        return some, np.stack([np.ones(len(some)), np.log(yes / no), cos[first]], axis=1)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton steps, with a small ridge."""
        coef = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
            grad = x.T @ (weight * (p - y)) + 1e-3 * coef
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
            step = np.linalg.solve(hess, grad)
            coef -= step
            if np.abs(step).max() < 1e-9:
                break
        self.coef = coef

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The scores of at most ``BATCH`` texts, and their neighbours: number
        of the text, doc_id, cosine."""
        doc, rows, cos = self.nearest_of(*self.reader.vectors(texts, self.idf))
        some, x = self.features(doc, rows, cos)
        out = np.full(len(texts), self.base)
        out[some] = 1 / (1 + np.exp(-np.clip((x * self.coef).sum(1), -30, 30)))
        return out, doc, self.ids[rows], cos


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, neighbours: int = 15) -> BlockMaxIndex | None:
    """Terms, index and calibration; None without labels of both kinds."""
    totals = {r.toxic: r["count"] for r in labels.where(F.col("toxic").isin(0, 1) & ~held_out())
              .groupBy(F.col("toxic").cast("int").alias("toxic")).count().collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    examples = sample_examples(docs, labels, per_class)
    rows = examples.select("doc_id", "toxic", "text")
    taken = {y: min(n, per_class) for y, n in totals.items()}
    terms, phi = example_terms(rows, taken)
    n, df = document_frequencies(docs, terms)
    idf = np.log((2 + n) / (1 + df)) * phi

    def run(batches):
        reader = TermReader(terms)
        for batch in slices(batches):
            doc, term, weight = reader.vectors(texts_of(batch), idf)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), lists(doc, term.astype(np.int32), batch.num_rows),
                 lists(doc, weight, batch.num_rows)],
                names=["doc_id", "toxic", "t", "w"])

    vectors = rows.mapInArrow(run, "doc_id long, toxic int, t array<int>, w array<double>").toArrow()
    priors = tuple(totals[y] / taken[y] for y in (0, 1))
    index = BlockMaxIndex(terms, idf, vectors, priors, neighbours)
    del vectors
    index.base = totals[1] / (totals[0] + totals[1])
    seen = own_votes(rows, index)
    if len(seen):
        y = seen["toxic"].to_numpy()
        index.calibrate(np.stack([seen[f"x{i}"].to_numpy() for i in range(3)], axis=1), y.astype(float),
                        np.array(priors)[y])
    return index


def own_votes(examples: DataFrame, index: BlockMaxIndex) -> pa.Table:
    """toxic, x0 to x2: the features of each example among all others."""
    shared = examples.sparkSession.sparkContext.broadcast(index)  # bounded by per_class

    def run(batches):
        model = shared.value
        for batch in slices(batches, BATCH):
            vectors = model.reader.vectors(texts_of(batch), model.idf)
            kept, x = model.features(*model.nearest_of(*vectors, skip=batch.column("doc_id").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("doc_id", "toxic")] + [pa.array(x[:, j]) for j in range(3)],
                names=["doc_id", "toxic", "x0", "x1", "x2"])

    seen = examples.select("doc_id", "toxic", "text").mapInArrow(
        run, "doc_id long, toxic int, x0 double, x1 double, x2 double").toArrow()
    shared.destroy()
    return seen.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])


def score_documents(docs: DataFrame, index: BlockMaxIndex | None) -> DataFrame:
    """doc_id, score, evidence (neighbours' doc_ids) and cosines of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by per_class

    def run(batches):
        model = shared.value
        nothing = np.empty(0, np.int64)
        for batch in slices(batches, BATCH):
            n = batch.num_rows
            score, doc, ids, cos = model.score(texts_of(batch)) if model else (np.zeros(n), nothing, nothing, np.empty(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), lists(doc, ids, n), lists(doc, cos, n)],
                names=["doc_id", "score", "evidence", "cosines"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, score double, evidence array<long>, cosines array<double>")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document from its nearest labelled examples."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence")
