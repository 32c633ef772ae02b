"""Alignment of two tokenizers against whole texts and all pairs of tokens."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ragscope.llm import alignment as al

SCHEMA = "doc_id long, text string, row long, links int, groups string, chunk int"


@functools.cache
def libraries():
    return al.Tokenizers(al.default_a(), al.default_b())


def whole(text):
    """Tokens (start, end, id) of both kinds over the whole text, or None."""
    t = libraries()
    if not text:
        return None
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    out = []
    for ids, table in ((a, t.bytes_a), (b, t.bytes_b)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        out.append(list(zip([0, *ends[:-1]], ends, ids)))
    return out


def brute(rows):
    """The contract's columns for (key, text) rows, from all pairs of tokens."""
    pairs, own, out = Counter(), {}, {}
    for key, text in rows:
        found = whole(text)
        if found is None:
            continue
        a, b = found
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        links, groups, lo = [], [], 0
        for hi in ends:
            in_a, in_b = [t for t in a if lo < t[1] <= hi], [t for t in b if lo < t[1] <= hi]
            links += [(x[2], y[2]) for x in in_a for y in in_b if x[0] < y[1] and y[0] < x[1]]
            groups.append(",".join(str(t[2]) for t in in_a) + "|" + ",".join(str(t[2]) for t in in_b))
            lo = hi
        own[key] = (len(a), len(b), groups, links)
        pairs.update(links)
    top = defaultdict(int)
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    for key, _ in rows:
        if key not in own:
            out[key] = (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = own[key]
        out[key] = (n_a, n_b, len(groups), len(links), sum(pairs[p] == top[p[1]] for p in links),
                    sum(pairs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())
    return out


def texts():
    rng = random.Random(4)
    pool = ["the", "station", "naïve", "it's", "x\ty", "  ", "\n", "中文字符", "😀", "Привет", "a b", "　", "'ll", "1,234.5",
            "<|endoftext|>", "<s>", "<0x41>", "\x00", "\x1c", "́e", "supercalifragilistic", "ＡＢ", " y", "\r\n"]
    some = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [None, "", " ", "   ", "a", " a ", "a  b ", "▁q", "plain ▁ mark", "the cat sat", "the cat sat", "é" * 300,
            "x" * 1500 + " y z", "ab " * 400, *some, " ".join(some)[:3000]]


@pytest.mark.parametrize("chunk", [1 << 16, 50])  # whole rows; and every longer text as a tree of fragments
def test_against_all_pairs(spark, monkeypatch, chunk):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all")]
    docs = spark.createDataFrame([(i, t, 9, 9, "x", 9) for i, t in rows], SCHEMA).repartition(3)
    want = brute(rows)
    done, links = al.align(docs, chunk=chunk, fan=3)
    for most in (1 << 20, 5):  # the pair table sent to every task, and the shuffle of rare pairs
        got = done.join(al.link_scores(links, most), "row", "left").collect()
        assert len(got) == len(rows)
        for r in got:
            digest = hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else ""
            assert (r.n_a, r.n_b, r.n_groups, r.n_links or 0, r.n_best or 0, r.count_sum or 0, digest) == want[r.doc_id], r.doc_id


def test_fragments_compose_in_any_tree():
    rng = random.Random(2)
    for text in texts()[9:40]:
        tokens = libraries().tokens(text.encode())
        if tokens is None:
            continue
        want = al.fragment(tokens, starts_cut=True)
        places = sorted(rng.sample(range(len(tokens) + 1), min(6, len(tokens) + 1)))
        # ranges end between bytes, so tokens with one end stay together
        places = [p for p in places if 0 < p < len(tokens) and tokens[p] >> 17 != tokens[p - 1] >> 17]
        parts = [al.fragment(t, starts_cut=i == 0) for i, t in enumerate(np.split(tokens, places))]
        left = functools.reduce(al.compose, parts, al.Fragment())
        right = functools.reduce(lambda x, y: al.compose(y, x), reversed(parts), al.Fragment())
        for got in (left, right):
            assert (got.groups, got.n_groups, len(got.head), len(got.tail)) == (want.groups, want.n_groups, 0, 0)
            assert sorted(got.links) == sorted(want.links)


def test_ranges_cover_the_text():
    rng = random.Random(3)
    for text in texts()[4:]:
        data, chunk = (text or "").encode(), rng.choice([7, 20, 64])
        found = list(al.ranges(data, chunk))
        assert [x[0] for x in found] == [0, *(x[1] for x in found[:-1])] and found[-1][1] == len(data) + 1
        for lo, hi, base, piece in found:
            assert base <= lo and base + len(piece) >= hi and piece == (b" " + data)[base:base + len(piece)]
    run = b"x" * 100_000  # no place to cut: tokenised once
    assert len(list(al.ranges(run, 100))) == 1
    assert sum(len(p) for *_, p in al.ranges(b"a b " + run + b" c d " + run, 100)) < 3 * 200_000


def test_empty_table(spark):
    done, links = al.align(spark.createDataFrame([], SCHEMA))
    assert done.count() == 0 and al.link_scores(links).count() == 0


def test_query(spark):
    from tests.conftest import SF001
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = al.op11_alignment(spark, SF001)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    assert dict(got.dtypes) == {"doc_id": "bigint", "groups_sha256": "string"} | dict.fromkeys(names, "bigint")
    short = [x for x in rows if len(x[1] or "") < 3000]
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(rows)
    for key, values in brute(short).items():
        r = got[key]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*values[:4], values[6])
        assert r.n_links == r.n_a + r.n_b - r.n_groups
