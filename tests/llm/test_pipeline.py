"""The pipeline against a plain version of its stages."""

import corpus_pipeline as cp
from ragscope.llm import bpe
from ragscope.llm.common import documents
from tests.conftest import SF001
from tests.llm.test_operators import WORD, shingle_set


def smallest_of_copies(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in texts.items() if find(i) == i}


def without_repeats(texts, window=50):
    split = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k:k + window]), i)
    out = {}
    for i, words in split.items():
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        if not gone or left:
            out[i] = left if gone else texts[i]
    return out


def test_run_against_plain_stages(spark):
    from tokenizers import Tokenizer
    docs = documents(spark, SF001)
    # a trained network has no plain version: its stage is taken as it is
    texts = {r.doc_id: r.text for r in cp.language_id(spark, docs, SF001).collect()}
    copies = smallest_of_copies(texts)
    left = without_repeats(copies)
    assert len(texts) > len(copies) and any(left.get(i) != t for i, t in copies.items())
    rows = [(i, t, None, None, None) for i, t in left.items()]
    masked = {r.doc_id: r.text for r in cp.mask_secrets(
        spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF001).collect()}
    reference = Tokenizer.from_file(bpe.default_tokenizer())
    want = {i: len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    got, lengths = {}, {}
    for r in cp.run(spark, SF001).collect():
        got[r.doc_id] = r.doc_tokens
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert got == want and lengths == want


def test_stages_on_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h long, kept string"
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, words, "en", None, None, 1, "x"), (1, words, "en", None, None, 1, "x"), (2, words, None, "s", 3, 2, "y"), (3, None, None, None, None, 3, None),
            (4, "", "en", None, 0, 4, ""), (None, words, None, None, None, 5, "z"), (5, "one two", None, None, None, 6, "")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES[1:4]:
            out = stage(spark, docs, SF001)
            assert out.columns == cp.COLUMNS
            ids = {r.doc_id for r in out.collect()}
            assert ids <= {r[0] for r in data} and (not data or {1, 5, None} <= ids)
        assert {r.doc_id for r in cp.pack(spark, docs, SF001).collect()} == {r[0] for r in data}


def test_near_duplicates_sends_small_batches_to_python(spark, monkeypatch):
    from ragscope.llm import ngram_join
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, real = spark.conf.get(key), [], ngram_join.materialize

    def written(df, name):
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id long")
        seen.append(sizes.count())
        return real(df, name)

    monkeypatch.setattr(ngram_join, "materialize", written)
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(30)], "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).select("component_id").distinct().count() == 3
    assert set(seen) == {5} and spark.conf.get(key) == before
