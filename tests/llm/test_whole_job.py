"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import numpy as np

from ragscope.llm import itq, ngram_join


def _hard_unit_case():
    """A short text, a near copy one word longer, and texts that make its first
    three shingles frequent; see test_ngram_link_of_hard_unit_with_copies."""
    rng = np.random.default_rng(3)

    def some(n):
        return [f"w{i}" for i in rng.integers(0, 10**6, n)]

    while True:  # seven words whose three shingles come first in most texts
        common = some(7)
        hot = ngram_join.shingles(" ".join(common), 5)
        if (hot < -(2**62) - 2**61).all():
            break
    while True:
        tail = some(6)
        h = ngram_join.shingles(" ".join(common + tail), 5)
        if not np.array_equal(h[:3], hot):
            continue
        extra = some(1)
        d = ngram_join.shingles(" ".join(common + tail + extra), 5)
        if h[4] < np.setdiff1d(d, h)[0] < h[5]:
            break
    others = [" ".join(common + some(6)) for _ in range(100)]
    return " ".join(common + tail), " ".join(common + tail + extra), others


def test_ngram_link_of_hard_unit_with_copies(spark):
    # the copy of the longer text in another partition must not hide the link
    short, long, others = _hard_unit_case()
    rows = [(1, short), (2, long), *((10 + i, t) for i, t in enumerate(others)), (3, long)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert [found[i] for i in (1, 2, 3)] == [1, 1, 1]
    assert all(found[10 + i] == 10 + i for i in range(len(others)))


def test_embedding_tables_reach_recall_with_a_common_component(spark):
    # vectors with a mean cosine of 0.75, and codes as long as for a million
    rng = np.random.default_rng(1)

    def some(n):
        g = rng.normal(size=(n, 64))
        return itq.unit_rows(0.5 * g / np.linalg.norm(g, axis=1, keepdims=True) + 0.75**0.5 * np.eye(64)[0])

    schema = "vec_id long, v array<double>"
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some(3000))], schema)
    model = itq.fit(vectors, 1_000_000, 64, 0.95, 0.995, 8192)
    x = some(3000)
    d = rng.normal(size=x.shape)
    d -= (d * x).sum(1, keepdims=True) * x
    y = 0.955 * x + (1 - 0.955**2) ** 0.5 * d / np.linalg.norm(d, axis=1, keepdims=True)
    assert (itq.substrings(x, model) == itq.substrings(y, model)).any(1).mean() >= 0.985


def test_near_copies_of_one_text_do_not_meet_in_pairs(spark, monkeypatch):
    # near copies that differ in their smallest hashes: each is compared with a
    # hub, not with all others
    rng = np.random.default_rng(4)
    rows = [(7, " ".join(f"w{j}" for j in range(150)))]
    for i in range(300):
        words = [f"w{j}" for j in range(150)]
        for at in rng.integers(5, 145, rng.integers(1, 4)):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((8 + i, " ".join(words)))
    rows += [(1000 + j, " ".join([f"w{i}" for i in range(75)] + [f"y{j}x{i}" for i in range(75)])) for j in range(20)]
    tables, real = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: tables.setdefault(name, real(df, name)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert found == {i: 7 if i < 1000 else i for i, _ in rows}
    assert tables["pairs"].count() < 100
