"""Toxicity with few labels, rare words, ties and repeated rows, against a full scan."""

import math

import numpy as np

from ragscope.llm import toxicity


def learnt(spark, n):
    """The first ``n`` ids whose labels may be learnt."""
    ids = spark.range(n * 3).where(~toxicity.held_out("id")).orderBy("id").limit(n).collect()
    return [r.id for r in ids]


def table(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, terms string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    return docs.repartition(3), labels


def test_few_rows_and_rare_words(spark):
    ids = learnt(spark, 20)
    # two vocabularies; every toxic text also has words that no other text has
    rows = [(i, f"{'awful nasty' if k % 2 else 'kind gentle'} rare{chr(97 + k)}", k % 2) for k, i in enumerate(ids)]
    fresh = [(10_000 + k, f"rare{chr(97 + k)}", None) for k in range(20)]
    odd = [(20_000, None, None), (20_001, "", None), (20_002, "unseen words", None), (20_003, "awful", None),
           (20_003, "awful", None), (20_004, "kind " * 100_000, None)]
    docs, labels = table(spark, rows + fresh + odd)
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, index).collect()}
    for k, (i, _, y) in enumerate(rows):
        assert (got[i].score >= 0.5) == bool(y)
        assert (got[10_000 + k].score >= 0.5) == bool(y) and got[10_000 + k].evidence[0] == i
    assert got[20_000].score == got[20_001].score == got[20_002].score and got[20_000].evidence == []
    assert got[20_003].score >= 0.5 > got[20_004].score
    assert toxicity.score_documents(docs, index).where("doc_id = 20003").count() == 2
    # ties go to the smaller doc_id
    assert got[20_003].evidence[:10] == sorted(i for i, _, y in rows if y)[:10]


def test_cosines_equal_a_plain_computation(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)]
    ids = learnt(spark, 200)
    rows = [(i, " ".join(rng.choice(words[(k % 2) * 30:(k % 2) * 30 + 114], rng.integers(0, 30))), k % 2)
            for k, i in enumerate(ids)]
    docs, labels = table(spark, rows)
    index = toxicity.fit(docs, labels)
    held = {i: toxicity.words_of(t) for i, t, _ in rows}
    n, n1 = len(rows), sum(y for _, _, y in rows)
    df = {t: sum(t in v for v in held.values()) for v in held.values() for t in v}
    yes = {t: sum(t in held[i] for i, _, y in rows if y) for t in df}

    def weight(t):
        a, b = yes[t], df[t] - yes[t]
        phi = abs(a * (n - n1 - b) - b * (n1 - a)) / math.sqrt((a + b) * max(n - a - b, 0.5) * n1 * (n - n1))
        return math.log((2 + n) / (1 + df[t])) * phi

    vectors = {i: {t: (1 + math.log(c)) * weight(t) for t, c in v.items()} for i, v in held.items()}
    norms = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    got = {r.doc_id: r for r in toxicity.score_documents(docs, index).collect()}
    for i, v in vectors.items():
        cos = {j: sum(x * u.get(t, 0) for t, x in v.items()) / (norms[i] * norms[j])
               for j, u in vectors.items() if norms[i] and norms[j]}
        best = sorted((c for c in cos.values() if c > 1e-12), reverse=True)[:index.k]
        assert np.allclose(got[i].cosines, best)
        assert all(abs(cos[j] - c) < 1e-9 for j, c in zip(got[i].evidence, got[i].cosines))


def test_the_driver_sees_no_vector_as_python_objects(spark, monkeypatch):
    ids = learnt(spark, 20)
    docs, labels = table(spark, [(i, f"{'awful nasty' if k % 2 else 'kind gentle'} common", k % 2) for k, i in enumerate(ids)])
    asked, frames = [], []
    real = type(docs).collect
    monkeypatch.setattr(toxicity.BlockMaxIndex, "nearest", lambda *a, **k: asked.append(a))
    monkeypatch.setattr(type(docs), "collect", lambda df: frames.append(df.columns) or real(df))
    index = toxicity.fit(docs, labels)
    assert asked == [] and frames == [["toxic", "count"]]
    assert index.coef.any() and sorted(index.ids.tolist()) == ids


def test_texts_are_looked_up_together(spark, monkeypatch):
    rng = np.random.default_rng(11)
    # a few words of very many texts, and many of few: 1200 examples, some of them equal
    often, seldom = [f"often{chr(97 + i)}" for i in range(20)], [f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    ids = learnt(spark, 1200)
    text = lambda y: " ".join([*rng.choice(often[y * 5:y * 5 + 15], 6), *rng.choice(seldom[y * 100:y * 100 + 500], rng.integers(0, 12))])
    rows = [(i, text(k % 2), k % 2) for k, i in enumerate(ids)]
    rows[900:930] = [(i, rows[k % 2][1], k % 2) for k, (i, _, _) in enumerate(rows[900:930])]
    index = toxicity.fit(*table(spark, rows))
    asked = [text(k % 2) for k in range(60)] + ["", "unseen", rows[0][1], rows[1][1]]
    full = np.zeros((len(index.ids), len(index.terms)))
    for t, (e, w) in enumerate(zip(index.examples, index.weights)):
        full[e, t] = w
    real, calls = toxicity.ranges, []
    for few, frequent in ((toxicity.FEW, toxicity.FREQUENT), (64, 3), (1, 0)):
        monkeypatch.setattr(toxicity, "FEW", few)
        monkeypatch.setattr(toxicity, "FREQUENT", frequent)
        index.__dict__.pop("frequent", None)
        assert len(index.frequent[1]) == min(frequent, 20)
        calls.clear()
        monkeypatch.setattr(toxicity, "ranges", lambda *a: calls.append(a) or real(*a))
        score, doc, near, cos = index.score(asked)
        assert len(calls) == 64 // few  # runs of postings: no step of its own for a text
        for k, t in enumerate(asked):
            q = np.zeros(len(index.terms))
            v = index.reader.vector(t, index.idf)
            q[list(v)] = list(v.values())
            want = np.round(full @ q, 12)
            order = [i for i in np.lexsort((index.ids, -want)) if want[i] > 0][:index.k]
            assert np.allclose(cos[doc == k], want[order]) and len(order) == (0 if k in (60, 61) else index.k)
            assert all(abs(want[index.ids.searchsorted(i)] - c) < 1e-11 for i, c in zip(near[doc == k], cos[doc == k]))
        assert score[60] == score[61] == index.base
        # equal examples stand by their ids
        same = near[doc == 62][np.isclose(cos[doc == 62], 1)].tolist()
        assert same == sorted(same) and len(same) == 15
