"""Alignment of two tokenizers by an associative monoid of fragments.

Tokens A (byte-level BPE) and B (BPE with byte fallback) cover the same bytes:
a space and the text. Byte offsets where a token of both ends cut them into
groups. A byte range of a document yields a fragment: the tokens before its
first common end (open prefix), the closed groups, and the tokens after its
last common end (open suffix). ``compose`` joins neighbouring fragments: the
left one's suffix and the right one's prefix close a group, or stay open where
one of them has no common end. It is associative, with the empty fragment as
identity, so the fragments of a document can be reduced in any tree.

Documents of at most ``chunk`` bytes are one fragment, made where their row is.
Longer ones are cut into byte ranges of about ``chunk`` bytes that go to
different tasks, and rounds of a group-by compose ``fan`` neighbours at a time.
A range is tokenised from the last place at or before it to the first one at or
behind its end where no token of either kind can cross (a single space between
two characters that are no white space: neither pattern nor pieces join across
it). Ranges without such a place belong to the one in which the run began, so
a long run is tokenised at most twice. The same places cut short texts into
words, whose groups a worker remembers.

Token strings that look like special tokens are plain text. Null and empty
texts, and texts whose joined A or B bytes differ from a space and the text
(such as those that hold U+2581), have no tokens: zero counts, no groups.
Repeated rows and rows with a null doc_id are documents of their own, and all
count. Extra columns are not read. Token ids must be below 65,536 and a text
shorter than 2**40 bytes.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.llm.common import documents, materialize, slices
from ragscope.llm.memo import Memo

# A space where no token crosses: neither neighbour is white space (the Unicode
# property, in UTF-8) or a control character.
CUT = re.compile(rb" (?<=[^\x00-\x20] )(?<!\xC2[\x85\xA0] )(?<!\xE1\x9A\x80 )(?<!\xE1\xA0\x8E )(?<!\xE2\x80[\x80-\x8A\xA8\xA9\xAF] )"
                 rb"(?<!\xE2\x81\x9F )(?<!\xE3\x80\x80 )(?=[^\x00-\x20])(?!\xC2[\x85\xA0]|\xE1\x9A\x80|\xE1\xA0\x8E"
                 rb"|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80)")
SPACE_MARK = "▁"
NO_TOKENS = np.empty(0, np.int64)
#: Rows of the pair table up to which it is sent to every task (about 40 MB).
BROADCAST_PAIRS = 1 << 20
#: Pairs with at least this share of all links are the frequent ones: 4,096 at most.
FREQUENT = 4096


def default_a() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def default_b() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Tokens of words as packed integers: byte end, kind (0: A, 1: B) and id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # an entry's printable characters stand for one byte each
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        byte = {chr(b) if b in printable else chr(next(rest)): b for b in range(256)}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in token)
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"piece {piece!r} joins across a space: words cannot be tokenised on their own")
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def encode(self, words: list[bytes]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of both kinds, and whether their bytes are a space and the word."""
        texts = [w.decode("utf-8") for w in words]
        found_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        found_b = self.b.encode(texts, num_threads=1)
        whole = b" " + b" ".join(words)

        def same(found, table):
            return b"".join(map(table.__getitem__, chain.from_iterable(found))) == whole

        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ok = np.ones(len(words), bool)
        for found, table, lengths in ((found_a, self.bytes_a, self.length_a), (found_b, self.bytes_b, self.length_b)):
            if same(found, table) and (segment_sums(lengths, found) == sizes).all():
                continue
            ok &= [b"".join(map(table.__getitem__, ids)) == b" " + w for ids, w in zip(found, words)]
        return found_a, found_b, ok

    def tokens(self, word: bytes) -> np.ndarray | None:
        """One word's tokens, sorted; None where their bytes are not a space and the word."""
        (a,), (b,), ok = self.encode([word])
        if not ok[0]:
            return None
        packed = np.concatenate((np.cumsum(self.length_a[a]) << 17 | np.array(a, np.int64),
                                 np.cumsum(self.length_b[b]) << 17 | 1 << 16 | np.array(b, np.int64)))
        packed.sort()
        return packed


def segment_sums(values: np.ndarray, found: list[list[int]]) -> np.ndarray:
    """The sum of ``values`` over each list of ids."""
    count = np.fromiter(map(len, found), np.int64, len(found))
    total = np.concatenate(([0], np.cumsum(values[np.fromiter(chain.from_iterable(found), np.int64)])))
    end = np.cumsum(count)
    return total[end] - total[end - count]


@functools.lru_cache(2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Fragment(NamedTuple):
    """A byte range's tokens: those before the first common end, the groups
    between common ends, and those after the last. Without a common end all
    are in ``head``. ``links`` are the pairs (a << 16 | b) of closed groups."""

    head: np.ndarray = NO_TOKENS
    cut: bool = False
    groups: str = ""
    n_groups: int = 0
    links: np.ndarray = NO_TOKENS
    tail: np.ndarray = NO_TOKENS


def group(tokens: np.ndarray) -> tuple[str, np.ndarray]:
    """A closed group's text and the pairs of its tokens that overlap."""
    ids, is_b, ends = tokens & 0xFFFF, (tokens >> 16) & 1, tokens >> 17
    a, b = ids[is_b == 0].tolist(), ids[is_b == 1].tolist()
    ends_a, ends_b = ends[is_b == 0].tolist(), ends[is_b == 1].tolist()
    links, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        links.append(a[i] << 16 | b[j])
        step_a, step_b = ends_a[i] <= ends_b[j], ends_b[j] <= ends_a[i]
        i, j = i + step_a, j + step_b
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}", np.array(links, np.int64)


def fragment(tokens: np.ndarray, starts_cut: bool = False) -> Fragment:
    """The fragment of consecutive tokens; ``starts_cut`` where a common end,
    or the document's start, comes right before them."""
    ends = tokens >> 17
    last = np.flatnonzero(np.diff(ends) == 0) + 1  # second token of each common end
    if not len(last):
        return Fragment(tail=tokens, cut=True) if starts_cut else Fragment(head=tokens)
    runs = np.split(tokens, last + 1)
    head, closed, tail = (NO_TOKENS if starts_cut else runs[0]), runs[0 if starts_cut else 1:-1], runs[-1]
    texts, links = zip(*map(group, closed)) if closed else ((), ())
    return Fragment(head, True, ";".join(texts), len(closed), np.concatenate(links) if links else NO_TOKENS, tail)


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges (associative)."""
    if not left.cut and not right.cut:
        return Fragment(head=np.concatenate((left.head, right.head)))
    if not left.cut:
        return right._replace(head=np.concatenate((left.head, right.head)))
    if not right.cut:
        return left._replace(tail=np.concatenate((left.tail, right.head)))
    between = np.concatenate((left.tail, right.head))
    text, links = group(between) if len(between) else ("", NO_TOKENS)
    return Fragment(left.head, True, ";".join(t for t in (left.groups, text, right.groups) if t),
                    left.n_groups + bool(len(between)) + right.n_groups,
                    np.concatenate((left.links, links, right.links)), right.tail)


def counted(pairs: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Distinct pairs, each with its count above it (count << 32 | pair)."""
    if not len(pairs):
        return NO_TOKENS
    if times is None:
        pair, count = np.unique(pairs, return_counts=True)
        return count << 32 | pair
    order = np.argsort(pairs, kind="stable")
    pairs, total = pairs[order], np.cumsum(times[order])
    last = np.flatnonzero(np.append(pairs[1:] != pairs[:-1], True))
    return np.diff(total[last], prepend=0) << 32 | pairs[last]


class Words:
    """The groups of whole words, remembered: a row of numbers and a text for
    each word. A row is [ok, tokens A, tokens B, groups, links...]."""

    def __init__(self, path_a: str, path_b: str):
        self.tokenizers = tokenizers(path_a, path_b)
        self.texts: list[str] = []
        self.memo = Memo(self._make)
        # an id as text, with what follows it: , | ; or the end of a word
        self.written = [f"{i}{mark}" for mark in ",|;\n" for i in range(1 << 16)]

    def _make(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words at once, as tokens along one line of bytes."""
        if not self.memo.n:
            self.texts.clear()
        found_a, found_b, ok = self.tokenizers.encode(words)
        if not ok.all():  # words without tokens: their rows are zeros
            bad = np.flatnonzero(~ok).tolist()
            for i in bad:
                found_a[i], found_b[i] = [], []
        t = self.tokenizers
        size = np.where(ok, np.fromiter(map(len, words), np.int64, len(words)) + 1, 0)
        word_end = np.cumsum(size)
        ids, starts, ends, counts = [], [], [], []
        for found, lengths in ((found_a, t.length_a), (found_b, t.length_b)):
            flat = np.fromiter(chain.from_iterable(found), np.int64)
            end = np.cumsum(lengths[flat])
            ids.append(flat)
            ends.append(end)
            starts.append(end - lengths[flat])
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
        common = np.intersect1d(*ends, assume_unique=True)  # words end at common ends, too
        # each pair that overlaps does so first where the later one starts
        first = np.union1d(*starts)
        links = (ids[0][np.searchsorted(starts[0], first, "right") - 1] << 16
                 | ids[1][np.searchsorted(starts[1], first, "right") - 1]) if len(first) else NO_TOKENS
        upto = np.searchsorted(first, word_end)
        n_links = np.diff(upto, prepend=0)
        n_groups = np.diff(np.searchsorted(common, word_end, "right"), prepend=0)
        # groups as text: A ids, then B ids of each group
        order = np.concatenate([np.searchsorted(common, e) * 2 + kind for kind, e in enumerate(ends)])
        at = np.argsort(order, kind="stable")
        flat, where = np.concatenate(ids)[at], order[at]
        end = np.concatenate(ends)[at]
        after = np.append(where[1:], -1)
        mark = np.where(after == where, 0, np.where(where % 2 == 0, 1, np.where(np.isin(end, word_end), 3, 2)))
        texts = "".join(map(self.written.__getitem__, (mark << 16 | flat).tolist())).split("\n")[:-1]
        if len(texts) == len(words):
            self.texts += texts
        else:
            each = iter(texts)
            self.texts += [next(each) if x else "" for x in ok.tolist()]
        row = np.empty(len(links) + 4 * len(words), np.int64)
        begin = np.cumsum(n_links + 4) - n_links - 4
        number = np.zeros(len(row), bool)
        for k, column in enumerate((ok, counts[0], counts[1], n_groups)):
            row[begin + k] = column
            number[begin + k] = True
        row[~number] = links
        return row, n_links + 4

    def align(self, words: list[bytes]) -> tuple[bool, int, int, int, str, np.ndarray]:
        """Whether all words' bytes are covered, tokens A, tokens B, groups,
        their text, and counted links of the words in a row."""
        return self._sum(self.memo.index(words))

    def align_each(self, texts: list[list[bytes]]) -> list[tuple[bool, int, int, int, str, np.ndarray]]:
        """``align`` of each text's words; new words are worked out together."""
        index = self.memo.index(list(chain.from_iterable(texts)))
        ends = np.cumsum([len(t) for t in texts])
        return [self._sum(index[e - len(t):e]) for t, e in zip(texts, ends.tolist())]

    def _sum(self, index: np.ndarray) -> tuple[bool, int, int, int, str, np.ndarray]:
        if not len(index):
            return True, 0, 0, 0, "", NO_TOKENS
        ok, n_a, n_b, n_groups = (self.memo.flat[self.memo.at[index] + k] for k in range(4))
        if not ok.all():
            return False, 0, 0, 0, "", NO_TOKENS
        text = ";".join(map(self.texts.__getitem__, index.tolist()))
        word, times = np.unique(index, return_counts=True)
        rows, size = self.memo.gather(word)
        number = np.ones(len(rows), bool)
        start = np.cumsum(size) - size
        for k in range(4):
            number[start + k] = False
        links = counted(rows[number], np.repeat(times, size)[number])
        return True, int(n_a.sum()), int(n_b.sum()), int(n_groups.sum()), text, links


@functools.lru_cache(2)
def words_of(path_a: str, path_b: str) -> Words:
    return Words(path_a, path_b)


def ranges(text: bytes, chunk: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(lo, hi, base, piece): byte ranges (lo, hi] of a space and the text, and
    what to tokenise for each, which begins at ``base`` with the space."""
    data = b" " + text
    lo, begin = 0, 0
    while lo < len(data):
        hi = lo + chunk
        found = CUT.search(data, hi) if hi < len(data) else None
        if found is None:
            yield lo, len(data), begin, data[begin:]
            return
        # where the run that goes over hi is longer than a range, it goes with this one
        over = found.start()
        hi = max(hi, over - over % chunk) if over - hi >= chunk else hi
        yield lo, hi, begin, data[begin:over]
        begin, at = 0, hi
        while at > 0:  # the last place at or before hi
            at = data.rfind(b" ", 0, at + 1)
            if at <= 0 or CUT.match(data, at):
                begin = max(at, 0)
                break
            at -= 1
        lo = hi


def range_fragment(known: Words, piece: bytes, lo: int, hi: int, base: int) -> tuple[bool, int, int, Fragment]:
    """The fragment of the tokens that end in (lo, hi], and how many there are."""
    words = CUT.split(piece[1:])
    size = np.array([len(w) + 1 for w in words], np.int64)
    end = base + np.cumsum(size)
    inside = (end - size >= lo) & (end <= hi)
    first, last = (int(np.flatnonzero(inside)[0]), int(np.flatnonzero(inside)[-1]) + 1) if inside.any() else (0, 0)
    ok, n_a, n_b, n_groups, text, links = True, 0, 0, 0, "", NO_TOKENS
    middle = Fragment()
    if last > first:
        ok, n_a, n_b, n_groups, text, links = known.align(words[first:last])
        middle = Fragment(NO_TOKENS, True, text, n_groups, NO_TOKENS)
    whole = [Fragment()]
    for i in [*range(first), None, *range(last, len(words))]:
        if i is None:
            whole.append(middle)
            continue
        tokens = known.tokenizers.tokens(words[i])
        if tokens is None:
            ok = False
            continue
        tokens = tokens + (int(end[i] - size[i]) << 17)
        ends = tokens >> 17
        mine = tokens[(ends > lo) & (ends <= hi)]
        n_b += int(((mine >> 16) & 1).sum())
        n_a += len(mine) - int(((mine >> 16) & 1).sum())
        whole.append(fragment(mine, starts_cut=int(end[i] - size[i]) >= lo))
    total = functools.reduce(compose, whole)
    return ok, n_a, n_b, total._replace(links=merge_counted(links, counted(total.links)))


def merge_counted(*many: np.ndarray) -> np.ndarray:
    every = np.concatenate(many)
    return counted(every & 0xFFFFFFFF, every >> 32)


RESULT = ["row long", "doc_id long", "n_a long", "n_b long", "n_groups long", "groups string", "links array<long>"]


def short_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches):
        known = words_of(path_a, path_b)
        for batch in slices(batches):
            out = known.align_each([CUT.split(t) if t else [] for t in batch.column("text").cast(pa.binary()).to_pylist()])
            _, n_a, n_b, n_groups, text, links = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                 pa.array(n_groups, pa.int64()), pa.array(text, pa.string()), pa.array(links, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return docs.mapInArrow(run, ", ".join(RESULT))


FRAGMENT = ["row long", "chunk long", "doc_id long", "ok boolean", "n_a long", "n_b long", "n_groups long", "cut boolean",
            "head array<long>", "groups string", "tail array<long>", "links array<long>"]


def cut_documents(docs: DataFrame, chunk: int) -> DataFrame:
    """The byte ranges of long documents, each with what to tokenise for it."""
    def run(batches):
        for batch in slices(batches, 8):
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id")),
                                         batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for k, (lo, hi, base, piece) in enumerate(ranges(text, chunk)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "chunk": k, "lo": lo, "hi": hi,
                                                       "base": base, "piece": piece}], schema)

    schema = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "chunk", "lo", "hi", "base")] + [("piece", pa.binary())])
    return docs.mapInArrow(run, "row long, doc_id long, chunk long, lo long, hi long, base long, piece binary")


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in FRAGMENT]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(col, types[c.split()[1]]) for c, col in zip(FRAGMENT, zip(*rows), strict=True)],
                                      names=names)


def range_fragments(chunks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches):
        known = words_of(path_a, path_b)
        for batch in slices(batches, 16):
            rows = []
            for r in batch.to_pylist():
                ok, n_a, n_b, f = range_fragment(known, r["piece"], r["lo"], r["hi"], r["base"])
                rows.append((r["row"], r["chunk"], r["doc_id"], ok, n_a, n_b, f.n_groups, f.cut, f.head, f.groups, f.tail, f.links))
            yield _fragments(rows)

    return chunks.mapInArrow(run, ", ".join(FRAGMENT))


def compose_round(fragments: DataFrame, fan: int) -> DataFrame:
    """Composes each run of ``fan`` neighbouring fragments of a document; the
    links of a row are those of the groups that this round closes."""
    def run(batches):
        for batch in slices(batches, 4):
            rows = []
            for members in batch.column("members").to_pylist():
                total, new = Fragment(), []
                for m in members:
                    right = Fragment(np.array(m["head"], np.int64), m["cut"], m["groups"], m["n_groups"], NO_TOKENS,
                                     np.array(m["tail"], np.int64))
                    total = compose(total, right)
                one = members[0]
                rows.append((one["row"], one["chunk"] // fan, one["doc_id"], all(m["ok"] for m in members),
                             sum(m["n_a"] for m in members), sum(m["n_b"] for m in members), total.n_groups, total.cut,
                             total.head, total.groups, total.tail, counted(total.links)))
            yield _fragments(rows)

    return (fragments.groupBy("row", F.floor(F.col("chunk") / fan).alias("parent"))
            .agg(F.sort_array(F.collect_list(F.struct(
                "chunk", *[c.split()[0] for c in FRAGMENT if not c.startswith(("chunk", "links"))]))).alias("members"))
            .select("members").mapInArrow(run, ", ".join(FRAGMENT)))


def long_documents(docs: DataFrame, path_a: str, path_b: str, chunk: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Results of the long documents, and their links: (row, links)."""
    chunks = cut_documents(docs, chunk)
    # a long document's ranges go to different tasks
    chunks = chunks.repartition(F.xxhash64("row", "chunk"))
    level = materialize(range_fragments(chunks, path_a, path_b), "fragments")
    links = level.select("row", "links")
    most = level.agg(F.max("chunk")).first()[0] or 0
    while most:
        level = materialize(compose_round(level, fan), "fragments")
        links = links.unionByName(level.select("row", "links"))
        most //= fan
    bad = level.where("NOT ok").select("row")
    links = links.join(bad, "row", "left_anti").where(F.size("links") > 0)
    zero = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    done = level.select("row", "doc_id", zero("n_a"), zero("n_b"), zero("n_groups"),
                        F.when(F.col("ok"), F.col("groups")).otherwise(F.lit("")).alias("groups"))
    return done, links


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = 1 << 16,
          fan: int = 8) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_a, n_b, n_groups, groups) of every document, and the
    links (row, links): count << 32 | a << 16 | b, in any number of rows."""
    paths = path_a or default_a(), path_b or default_b()
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    short = materialize(short_documents(docs.where(~is_long), *paths), "aligned")
    done, links = long_documents(docs.where(is_long).withColumn("row", -1 - F.col("row")), *paths, chunk, fan)
    return (short.drop("links").unionByName(done),
            short.select("row", "links").where(F.size("links") > 0).unionByName(links))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold each pair, and whether that is
    the most of any pair with its B id."""
    each = links.select(F.explode("links").alias("v"))
    counts = materialize(each.groupBy(F.col("v").bitwiseAND(0xFFFFFFFF).alias("pair"))
                         .agg(F.sum(F.shiftrightunsigned("v", 32)).alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(0xFFFF)
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))  # a row per id of B: 65,536 at most
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def link_scores(links: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(row, n_links, n_best, count_sum) of every row with links.

    Up to ``broadcast_pairs`` the pair table goes to every task. Beyond, the
    frequent pairs go to every task, and the others, each of which has a small
    share of the rows, meet their counts in a shuffle.
    """
    counts = materialize(pair_counts(links), "pair-counts")
    size = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")).first()
    each = links.select("row", F.explode("links").alias("v")).select(
        "row", F.shiftrightunsigned("v", 32).alias("m"), F.col("v").bitwiseAND(0xFFFFFFFF).alias("pair"))
    if size.n <= broadcast_pairs:
        scored = each.join(F.broadcast(counts), "pair")
    else:
        often = F.col("count") * FREQUENT >= F.lit(size.total)
        marked = each.join(F.broadcast(counts.where(often)), "pair", "left")
        rare = marked.where("count IS NULL").select("row", "m", "pair").join(counts.where(~often), "pair")
        scored = marked.where("count IS NOT NULL").unionByName(rare)
    return scored.groupBy("row").agg(
        F.sum("m").alias("n_links"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"),
        F.sum(F.col("m") * F.col("count")).alias("count_sum"))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Groups and links of byte_bpe_50k and piece_bpe_32k over all documents."""
    done, links = align(documents(spark, sf_dir))
    scores = link_scores(links)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    narrow = done.select("row", "doc_id", "n_a", "n_b", "n_groups", digest)
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return narrow.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *filled, "groups_sha256")
