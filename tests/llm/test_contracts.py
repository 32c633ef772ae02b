"""Every registered query itself: columns, types, one row per key, digests."""

import hashlib
import re
import struct

import pytest

from ragscope.llm import bpe, queries
from tests.conftest import SF001
from tests.llm.test_operators import WORD, shingle_set

LONG, TEXT, REAL, FLAG, SHORT = "bigint", "string", "double", "boolean", "int"
COLUMNS = {
    "op1_embedding_dedup": {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": FLAG},
    "op2_toxicity": {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": SHORT},
    "op3_secrets": {"doc_id": LONG, "n_assign": LONG, "n_access": LONG, "n_hex": LONG, "base_sha256": TEXT, "spans": TEXT},
    "op4_bpe": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT},
    "op6_syncmers": {"doc_id": LONG, "n_chars": LONG, "edited_sha256": TEXT, "fingerprint": TEXT, "edited_fingerprint": TEXT,
                     "near_edited": REAL, "near_next": REAL},
    "op7_ngram_jaccard": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG},
    "op8_langid": {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL},
    "op9_packing": {"doc_id": LONG, "start": LONG, "length": LONG, "ids_crc32": LONG, "doc_tokens": LONG, "sequence_id": LONG,
                    "offset": LONG},
    "op10_substring_dedup": {"doc_id": LONG, "n_words": LONG, "n_removed": LONG, "kept_sha256": TEXT},
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check_secrets(got, texts):
    kinds = {"n_assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
             "n_access": (r"AKIA[A-Z0-9]+", 0, 20), "n_hex": (r"[0-9a-f]+", 0, 24)}
    for i, t in texts.items():
        for name, (pattern, group, least) in kinds.items():
            assert got[i][name] == sum(len(m[group]) >= least for m in re.finditer(pattern, t)), (i, name)


def check_bpe(got, texts):
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(bpe.default_tokenizer())
    for i, t in texts.items():
        ids = reference.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == sha(reference.decode(ids, skip_special_tokens=False))


def check_syncmers(got, texts):
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][:len(texts[i]) - half] + texts[j][:half]
        assert got[i].n_chars == len(texts[i]) and got[i].edited_sha256 == sha(edited)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        for k in texts:
            if texts[k] == texts[i]:
                assert got[k].fingerprint == got[i].fingerprint


def check_shingles(got, texts):
    for i, t in texts.items():
        assert got[i].n_shingles == len(shingle_set(t)) and got[i].component_id <= i


def check_windows(got, texts):
    first = {}
    for i in sorted(texts):
        words = WORD.findall(texts[i])
        for k in range(len(words) - 49):
            first.setdefault(tuple(words[k:k + 50]), i)
    for i, t in texts.items():
        words, gone = WORD.findall(t), set()
        for k in range(len(words) - 49):
            if first[tuple(words[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), len(gone), sha(kept))


CHECKS = {"op3_secrets": check_secrets, "op4_bpe": check_bpe, "op6_syncmers": check_syncmers,
          "op7_ngram_jaccard": check_shingles, "op10_substring_dedup": check_windows}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    result = queries.QUERIES[name](spark, SF001)
    types = dict(result.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = result.collect()
    if name == "op1_embedding_dedup":
        assert len(rows) == spark.read.parquet(f"{SF001}/embeddings.parquet").count()
        return
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = {r.doc_id: r for r in rows}
    assert got.keys() == texts.keys() and (name == "op9_packing" or len(rows) == len(texts))
    if name in CHECKS:
        CHECKS[name](got, texts)
