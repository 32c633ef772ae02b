"""Residual packing against whole-text tokenisation and one best fit over everything."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ragscope.llm import residual_packing as rp

SCHEMA = "doc_id long, text string, piece int, bin long, fill string, `offset` int"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(rp.default_tokenizer())


def texts():
    rng = np.random.default_rng(5)
    some = [" ".join(f"w{i}" for i in rng.integers(0, 900, n)) for n in rng.integers(1, 400, 120)]
    return [None, "", " \t\n", "é😀 'll IT'S\x1cx\x00y<|endoftext|>Z  Σας", "x" * 9000, "中文字" * 900, "a b ́c",
            "one two", "one two", "word " * 70_000, *some]


def check(rows, want, width):
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_row[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, many in want.items():
        expected = []
        for ids in many:
            raw = np.array([*ids, 0], "<u4").tobytes()
            expected += [(k, k * width, len(raw[4 * k * width:4 * (k + 1) * width]) // 4,
                          zlib.crc32(raw[4 * k * width:4 * (k + 1) * width])) for k in range(-(-len(raw) // 4 // width))]
        assert sorted(by_row[doc_id]) == sorted(expected), doc_id
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= width
    return len(by_sequence), len(rp.best_fit(np.array([r.length for r in rows]), width)[2])


@pytest.mark.parametrize("group", [1 << 16, 8])  # one round, and a tree of rounds
def test_pieces_and_places(spark, reference, group):
    rows = [(i, t, 1, 2, "x", 3) for i, t in enumerate(texts())] + [(None, "no id", 1, 2, "x", 3), (7, "one two", 1, 2, "x", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id].append(reference.encode(text or "", add_special_tokens=False).ids)
    got = rp.pack(docs, width=512, group=group).collect()
    used, least = check(got, want, 512)
    assert used <= 1.02 * least
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_items_that_cannot_meet(spark):
    # all more than half full: rounds of several groups close nothing, and stop
    docs = spark.createDataFrame([(i, "a " * 300) for i in range(40)], "doc_id long, text string").repartition(4)
    rows = rp.pack(docs, width=512, group=8).collect()
    assert len({r.sequence_id for r in rows}) == 40


def test_empty_table(spark):
    assert rp.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_fit_is_whole_and_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 5000)
    bins, offset, fill = rp.best_fit(sizes, 256)
    assert (np.bincount(bins, sizes) == fill).all() and fill.max() <= 256
    for b in range(len(fill)):
        mine = np.flatnonzero(bins == b)
        order = mine[np.argsort(offset[mine])]
        assert offset[order].tolist() == np.concatenate(([0], np.cumsum(sizes[order])[:-1])).tolist()
    assert len(fill) <= -(-int(sizes.sum()) // 256) * 1.02


def test_query(spark):
    from tests.conftest import SF001
    rows = rp.op13_residual_packing(spark, SF001)
    assert dict(rows.dtypes).items() >= {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint",
                                         "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}.items()
    rows = rows.collect()
    used, least = check(rows, {}, 2048)
    assert used <= 1.02 * least
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}


def test_new_words_share_texts(monkeypatch):
    path = rp.default_tokenizer()
    whole, texts = rp.tokenizer(path), []

    class Counted:
        def encode_batch_fast(self, batch, **kw):
            texts.extend(batch)
            return whole.encode_batch_fast(batch, **kw)

    monkeypatch.setattr(rp, "tokenizer", lambda p: Counted())
    rp.mark_id.cache_clear()
    monkeypatch.setattr(Counted, "encode", lambda self, *a, **kw: whole.encode(*a, **kw), raising=False)
    memo = rp.word_ids.__wrapped__(path, 7)
    plain = [f"Wort{i},".encode() for i in range(1000)] + [b""]
    memo.index(plain)
    assert len(texts) <= 1 + len(plain) // 100
    odd = [w.encode() for w in (
        "don't", "'s", "a's'T", "I\u0307x", "J\u030c", "\u0301x", "caf\u00e9\u0301", "<|endoftext|>", "x<|ENDOFTEXT|>y", "\u00a0", "a\u3000b",
        "\u0001", "x\u0001y", "\u0001\u0001", "\u0000", "\u001f", "\u0085", "12.5%", "***", "\u4e2d\u6587", "\U0001f600", "\ufb01n")]
    for words in (plain, odd, [w for w in odd if b"\x01" not in w] * 2, odd[::-1] + plain):
        flat, sizes = memo.gather(memo.index(words))
        want = [whole.encode(w.decode(), add_special_tokens=False).ids if w else [7] for w in words]
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]
    monkeypatch.setattr(rp, "mark_id", lambda p: -1)  # a tokenizer without a mark
    flat, sizes = rp.tokenise(path, [w.decode() for w in odd])
    assert flat.tolist() == [i for w in odd for i in whole.encode(w.decode(), add_special_tokens=False).ids] and len(sizes) == len(odd)


def test_a_piece_is_tokenised_once(monkeypatch):
    path = rp.default_tokenizer()
    whole, pieces, words = rp.tokenizer(path), [], []
    by_piece, by_word = rp.tokenise_pieces, rp.tokenise
    monkeypatch.setattr(rp, "tokenise_pieces", lambda p, new: pieces.extend(new) or by_piece(p, new))
    monkeypatch.setattr(rp, "tokenise", lambda p, new: words.extend(new) or by_word(p, new))
    memo = rp.word_ids.__wrapped__(path, 7)
    stems = ["".join(chr(97 + i // 26 ** k % 26) for k in range(3)) + "\u00e9tud" for i in range(300)]
    for shape in ("{}", "{},", "({})", "{}%%%", "{}'s"):
        plain = [shape.format(v).encode() for s in stems for v in (s, s.title(), s.upper())]
        flat, sizes = memo.gather(memo.index(plain))
        want = [whole.encode(w.decode(), add_special_tokens=False).ids for w in plain]
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]
    assert not words and len(pieces) == len(set(pieces)) <= len(stems) + 10


def test_cut_words_have_the_whole_tokenizers_ids(monkeypatch):
    path = rp.default_tokenizer()
    assert rp.piece_rules(path)
    whole, rng = rp.tokenizer(path), np.random.default_rng(9)
    chars = [*map(chr, range(1, 0x180)), "'", "'", *"stremvld" * 9, "\u0301", "\u030c", "\u0338", "\u02bc", "\u03a3", "\u0130", "\u212b", "\u4e2d"]
    chars = [c for c in chars if c not in " \t\n\v\f\r"]
    words = ["".join(rng.choice(chars, n)) for n in rng.integers(1, 9, 20000)]
    letters = [*"stremvldSTREMVLD'',.!<|>9\u00e9\u00c9\u00df"]
    words += ["".join(rng.choice(letters, n)) for n in rng.integers(1, 9, 20000)]
    words += [chr(i) for i in range(33, 0x250)] + ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>,", "x" * 3000]
    words = [w.encode() for w in dict.fromkeys(words)]
    want = [whole.encode(w.decode(), add_special_tokens=False).ids for w in words]
    for rules in (True, False):
        if not rules:  # a tokenizer with other rules
            monkeypatch.setattr(rp, "piece_rules", lambda p: None)
        memo = rp.word_ids.__wrapped__(path, 7)
        flat, sizes = memo.gather(memo.index(words))
        got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
        assert [(w, g) for w, g, x in zip(words, got, want, strict=True) if g != x] == []


@pytest.mark.parametrize("limit", [1, 20, 5000, 1 << 20])
def test_encode_looks_a_word_up_once(limit):
    path = rp.default_tokenizer()
    memo, keys = rp.word_ids.__wrapped__(path, 7), []
    index = memo.index
    memo.index = lambda words: keys.append(words) or index(words)
    some = [t[:60_000] if t else t for t in texts()] + [" lead", "trail\n", "a\x0bb\x0cc\r\x1cd", None, "", " "]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.array(["cut off", *some], kind)[1:]
        got = list(rp.encode(memo, batch, limit))
        assert all(x.dtype == np.dtype("<u4") for x in got)
        want = [[*rp.tokenizer(path).encode(t or "", add_special_tokens=False).ids, 7] for t in some]
        assert [x.tolist() for x in got] == want
    if limit == 1 << 20:
        assert all(len(words) == len(set(words)) for words in keys) and len(keys) == 2
    assert list(rp.encode(memo, pa.array([], pa.string()), limit)) == []
