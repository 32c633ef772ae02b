"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

The most frequent words of the corpus are encoded once, and compiled into an
acyclic automaton whose equal suffixes are shared; the sum of the outputs
along a path numbers the accepted word, and the number selects its ids. The
automaton is a handful of flat integer arrays in one file that Spark ships to
every executor, where all Python workers map the same pages. Words that it does not
accept are merged exactly, by rank, many words at a time. The lexicon
therefore decides speed only, never the ids.

Null text is the empty text and has no ids. Rows repeat and ids tie freely:
each row is encoded on its own. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import sys
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.llm.common import discard, documents, materialize, slices, texts_of

# White space (the Unicode property) and the contractions of the
# byte-level pattern.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

SPACE, LETTER, NUMBER, OTHER = range(4)
NONE = np.int32(2**31 - 1)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)],
                   dtype=np.uint8)
    out[WHITE_SPACE] = SPACE
    return out


class Vocabulary:
    """Ids, merge ranks and bytes of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # The file writes each byte as a printable character: itself where
        # printable, else the next free one from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in char.items()}
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.first = np.array([vocab[char[b]] for b in range(256)], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        # A merge of two symbols is looked up in an open table of pairs.
        bits = max(17, int(len(merges) * 4).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.pair = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.full(1 << bits, NONE, dtype=np.int32)
        self.made = made
        key = left * self.size + right
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.pair[at] < 0
            slots, who = np.unique(np.where(free, at, -1), return_index=True)
            who = who[slots >= 0]
            self.pair[at[who]], self.rank[at[who]] = key[todo[who]], todo[who]
            left_over = np.ones(len(todo), bool)
            left_over[who] = False
            todo, at = todo[left_over], (at[left_over] + 1) & self.mask
        tokens = [b""] * self.size
        for t, i in vocab.items():
            tokens[i] = bytes(byte[c] for c in t)
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_len = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)))[:-1]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x2545F4914F6CDD1D)) >> np.int64(30)) & self.mask

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = self._slot(key)
        out = np.full(len(key), NONE, dtype=np.int32)
        rows = None
        while True:
            found = self.pair[at]
            hit = found == key
            out[hit if rows is None else rows[hit]] = self.rank[at[hit]]
            more = np.flatnonzero(~hit & (found >= 0))
            if not len(more):
                return out
            rows = more if rows is None else rows[more]
            key, at = key[more], (at[more] + 1) & self.mask

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        return self.merge_flat(np.frombuffer(b"".join(words), dtype=np.uint8), size)

    def merge_flat(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge`` for words of the given sizes that lie end to end in ``data``."""
        sym = self.first[data]
        word = np.repeat(np.arange(len(size)), size)
        done_sym, done_word = [], []
        rank = np.full(len(sym), NONE, dtype=np.int32)
        inner = word[:-1] == word[1:] if len(word) else np.empty(0, bool)
        at = np.flatnonzero(inner)
        rank[at] = self.ranks(sym[at], sym[at + 1])
        while len(sym):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(np.concatenate((begin, [len(sym)])))
            open_ = best != NONE
            live = np.repeat(open_, count)
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            sym, word, rank = sym[live], word[live], rank[live]
            if not len(sym):
                break
            best = np.repeat(best[open_], count[open_])
            take = rank == best
            # of overlapping occurrences (aaa) every second one merges, from the left
            both = np.flatnonzero(take[1:] & take[:-1])
            if len(both):
                pos = np.arange(len(take))
                run = pos - np.maximum.accumulate(np.where(take, -1, pos))
                take &= (run & 1) == 1
            hit = np.flatnonzero(take)
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[hit] = True
            changed[np.maximum(hit - 1, 0)] = True
            sym, word, rank, changed = sym[keep], word[keep], rank[keep], changed[keep]
            # a merge changes the pair before it too
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed)
            rank[at] = NONE
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at] = self.ranks(sym[at], sym[at + 1])
        sym = np.concatenate(done_sym) if done_sym else np.empty(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(size))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become the replacement sign."""
        n = self.token_len[ids]
        total = int(n.sum())
        at = np.repeat(self.token_at[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        return self.token_bytes[at].tobytes().decode("utf-8", "replace")


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def split_words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Word bounds of byte-level BPE for all texts at once.

    Returns the texts' UTF-8 bytes, the byte offsets at which words start
    (with the total length as last item), and the first word of each text
    (with the number of words as last item).
    """
    joined = "".join(texts)
    chars = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    doc = np.concatenate(([0], np.cumsum(chars)))
    data = joined.encode("utf-8", "surrogatepass")
    n = len(joined)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes()[cp]
    head = np.zeros(n + 1, bool)  # the first character of a text
    head[doc] = True
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    start[1:n] = kind[1:] != kind[:-1]
    start |= head
    # the last of some white space stands apart from the word that follows it,
    # or with it if it is a blank
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    quote = np.flatnonzero((cp[:-1] == 39) & start[:n - 1] & (kind[1:] == LETTER) & ~head[1:n])
    if len(quote):
        for q in quote.tolist():
            for c in CONTRACTIONS:
                end = q + 1 + len(c)
                if joined.startswith(c, q + 1) and not head[q + 2:end].any():
                    start[q + 1] = False
                    start[end] = True
                    break
    if len(data) == n:
        offset = None
    else:
        width = 1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF)
        offset = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    at = np.flatnonzero(start)
    first = np.searchsorted(at, doc)
    return data, at if offset is None else offset[at], first


class Lexicon:
    """A minimal acyclic automaton over bytes that numbers the words it accepts."""

    ARRAYS = ["base", "check", "target", "output", "final", "begin", "ids"]

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.longest = int(self.begin[-1])
        self.n_words = len(self.begin) - 2

    @classmethod
    def compile(cls, words: Iterable[bytes], vocab: Vocabulary) -> Lexicon:
        words = sorted(set(words) - {b""})
        children: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # from, byte, to: not yet shared

        def share(keep: int) -> None:
            while len(path) > keep:
                source, byte, node = path.pop()
                same = known.setdefault((final[node], *children[node].items()), node)
                if same != node:
                    children[source][byte] = same

        before = b""
        for w in words:
            common = len(os.path.commonprefix([before, w]))
            share(common)
            node = path[-1][2] if path else 0
            for b in w[common:]:
                children.append({})
                final.append(False)
                children[node][b] = len(children) - 1
                path.append((node, b, len(children) - 1))
                node = len(children) - 1
            final[node] = True
            before = w
        share(0)
        # words below each state, children first (a child that was made earlier
        # than its parent is possible, so walk with a stack)
        below: dict[int, int] = {}
        order, stack = [], [0]
        while stack:
            s = stack[-1]
            todo = [t for t in children[s].values() if t not in below]
            if todo:
                stack.extend(todo)
                continue
            stack.pop()
            if s not in below:
                below[s] = final[s] + sum(below[t] for t in children[s].values())
                order.append(s)
        # row displacement: states with many transitions first, each at the
        # first offset at which its transitions meet free slots
        number = {s: i for i, s in enumerate(sorted(order, key=lambda s: (s != 0, -len(children[s]))))}
        room = 2048 + 2 * sum(len(children[s]) for s in order)
        check = np.full(room, -1, np.int32)
        target, output = np.zeros(room, np.int32), np.zeros(room, np.int32)
        base, free = [0] * len(number), 256
        for s, i in number.items():
            kids = sorted(children[s].items())
            if not kids:
                continue
            while check[free] >= 0:
                free += 1
            shift = np.array([b - kids[0][0] for b, _ in kids])
            slot, reach = free, 64
            while True:
                if slot + reach + 512 > len(check):
                    check = np.concatenate((check, np.full(reach + room, -1, np.int32)))
                    target, output = (np.concatenate((x, np.zeros(reach + room, np.int32))) for x in (target, output))
                fits = check[slot:slot + reach] < 0
                for k in shift[1:]:
                    fits &= check[slot + k:slot + k + reach] < 0
                if fits.any():
                    slot += int(fits.argmax())
                    break
                slot, reach = slot + reach, min(reach * 4, 1 << 14)
            base[i] = slot - kids[0][0]
            passed = int(final[s])
            for b, t in kids:
                check[base[i] + b], target[base[i] + b], output[base[i] + b] = i, number[t], passed
                passed += below[t]
        ends = np.zeros(len(number), dtype=np.int32)
        ends[[number[s] for s in order if final[s]]] = 1
        ids, count = vocab.merge(words) if words else (np.empty(0, np.int32), np.empty(0, np.int64))
        used = max(base) + 256
        begin = np.concatenate(([0], np.cumsum(count), [max(map(len, words), default=0)]))
        return cls({"base": np.array(base, np.int32), "check": check[:used + 1],
                    "target": target[:used + 1], "output": output[:used + 1],
                    "final": ends, "begin": begin.astype(np.int32), "ids": ids.astype(np.int32)})

    def save(self, path: str) -> None:
        arrays = [getattr(self, a).astype("<i4") for a in self.ARRAYS]
        with open(path, "wb") as f:
            np.array([len(a) for a in arrays], "<i4").tofile(f)
            for a in arrays:
                a.tofile(f)

    @classmethod
    def map(cls, path: str) -> Lexicon:
        """Open a saved lexicon without reading it: workers share its pages."""
        whole = np.memmap(path, dtype="<i4", mode="r")
        k = len(cls.ARRAYS)
        ends = k + np.cumsum(whole[:k])
        return cls({a: whole[e - n:e] for a, n, e in zip(cls.ARRAYS, whole[:k], ends, strict=True)})

    def find(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word data[at:at+size], or -1."""
        out = np.full(len(at), -1, dtype=np.int64)
        if not self.n_words:
            return out
        rows = np.flatnonzero((size <= self.longest) & (size > 0))
        at, size = at[rows], size[rows]
        state, total = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        base, check, target, output = self.base, self.check, self.target, self.output
        step = 0
        while len(rows):
            slot = base[state] + data[at + step]
            ok = check[slot] == state
            if not ok.all():
                keep = np.flatnonzero(ok)
                rows, at, size, state, total, slot = (rows[keep], at[keep], size[keep], state[keep],
                                                      total[keep], slot[keep])
            total = total + output[slot]
            state = target[slot]
            step += 1
            end = size == step
            if end.any():
                hit = np.flatnonzero(end & (self.final[state] > 0))
                out[rows[hit]] = total[hit]
                keep = np.flatnonzero(~end)
                rows, at, size, state, total = rows[keep], at[keep], size[keep], state[keep], total[keep]
        return out


class Encoder:
    """Encodes texts; keeps the ids of merged words up to ``memory`` words."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None, memory: int = 400_000):
        self.vocab, self.lexicon, self.memory = vocab, lexicon, memory
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.short = np.empty(0, np.uint64)  # sorted; words of up to 8 bytes
        self.short_number = np.empty(0, np.int64)
        lex = self.lexicon
        self.ids = np.array(lex.ids) if lex else np.empty(0, np.int32)
        self.begin = np.array(lex.begin[:-1], dtype=np.int64) if lex else np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (and the end)."""
        special = [s for s in self.vocab.special if any(s in t for t in texts)]
        if special:
            return self._encode_special(texts)
        if len(self.seen) + len(self.short) > self.memory:
            self._forget()
        data, at, first = split_words(texts)
        raw, size = np.frombuffer(data, dtype=np.uint8), np.diff(at)
        at = at[:-1]
        if self.lexicon is not None:
            number = self.lexicon.find(raw, at, size)
            rest = np.flatnonzero(number < 0)
        else:
            number, rest = np.empty(len(at), np.int64), np.arange(len(at))
        number[rest] = self._number(data, raw, at[rest], size[rest])
        n = self.begin[number + 1] - self.begin[number]
        before = np.concatenate(([0], np.cumsum(n)))
        flat = self.ids[np.repeat(self.begin[number] - before[:-1], n) + np.arange(before[-1])]
        return flat, before[first]

    def _add(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merge new words and remember their ids; returns their numbers."""
        base = len(self.begin) - 1
        ids, count = self.vocab.merge_flat(flat, size)
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(count)))
        self.ids = np.concatenate((self.ids, ids))
        return np.arange(base, base + len(size))

    def _number(self, data: bytes, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of words that the lexicon lacks; new ones are merged here."""
        # words of up to 8 bytes, none of them 0, are told apart as integers
        short = np.flatnonzero(size <= 8)
        column = np.arange(8)
        packed = raw[np.minimum(at[short, None] + column, len(raw) - 1)]
        inside = column < size[short, None]
        packed = np.where(inside, packed, 0).astype(np.uint8)
        plain = (packed != 0).sum(1) == size[short]
        short, packed = short[plain], np.ascontiguousarray(packed[plain]).view(np.uint64).ravel()
        keys, one, which = np.unique(packed, return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.short, keys), max(len(self.short) - 1, 0))
        new = self.short[where] != keys if len(self.short) else np.ones(len(keys), bool)
        if new.any():
            rows = short[one[new]]
            n = size[rows]
            flat = np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            numbers = self._add(raw[flat], n)
            spot = np.searchsorted(self.short, keys[new])
            self.short = np.insert(self.short, spot, keys[new])
            self.short_number = np.insert(self.short_number, spot, numbers)
            where = np.searchsorted(self.short, keys)
        out = np.empty(len(at), np.int64)
        out[short] = self.short_number[where][which] if len(keys) else 0
        long_ = np.ones(len(at), bool)
        long_[short] = False
        rows = np.flatnonzero(long_)
        words = [data[i:j] for i, j in zip(at[rows].tolist(), (at + size)[rows].tolist(), strict=True)]
        seen = self.seen
        fresh = list(dict.fromkeys(w for w in words if w not in seen))
        if fresh:
            n = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh))
            numbers = self._add(np.frombuffer(b"".join(fresh), dtype=np.uint8), n)
            seen.update(zip(fresh, numbers.tolist(), strict=True))
        out[rows] = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
        return out

    def _encode_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode`` where a special token's string occurs: it is one id."""
        import re
        pattern = re.compile("(" + "|".join(map(re.escape, self.vocab.special)) + ")")
        parts = [pattern.split(t) for t in texts]
        plain, at = self.encode([p for x in parts for p in x[::2]])
        out, ends, k = [], [0], 0
        for x in parts:
            for i, p in enumerate(x):
                if i % 2:
                    out.append(np.array([self.vocab.special[p]], np.int32))
                else:
                    out.append(plain[at[k]:at[k + 1]])
                    k += 1
            ends.append(ends[-1] + sum(map(len, out[len(out) - len(x):])))
        return np.concatenate(out), np.array(ends)


def pieces(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters, at least one text each."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if i > begin and chars + len(t) > limit:
            yield begin, i
            begin, chars = i, 0
        chars += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all whole texts."""
    def count(batches):
        total: Counter = Counter()
        for batch in slices(batches):
            texts = texts_of(batch)
            for i, j in pieces(texts):
                data, at, _ = split_words(texts[i:j])
                at = at.tolist()
                total.update(data[a:b] for a, b in zip(at, at[1:]))
            if len(total) > 500_000:
                yield emit(total)
                total = Counter()
        yield emit(total)

    def emit(total):
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())],
                                          names=["word", "n"])

    return (docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def compile_lexicon(docs: DataFrame, tokenizer: str, size: int = 32_768, longest: int = 24) -> Lexicon:
    """The lexicon of the most frequent words of at most ``longest`` bytes, at
    most ``size``: all words above a frequency. The driver sees a few thousand
    counts (64 steps for each doubling of the frequency), then these words."""
    counts = materialize(word_counts(docs).where(F.length("word") <= longest), "word-counts")
    step = F.floor(F.log2("n") * 64).cast("int")
    cut, total = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r.s):
        total += r.c
        if total > size:
            break
        cut = r.s
    top = counts.where(step >= cut).collect() if cut is not None else []
    discard(counts)
    return Lexicon.compile((bytes(r.word) for r in top), vocabulary(tokenizer))


def ship(spark, lexicon: Lexicon) -> str:
    """Give every executor the lexicon's file; returns the name to map it by."""
    folder = tempfile.mkdtemp(prefix="lexicon-")
    path = os.path.join(folder, "lexicon.bin")
    lexicon.save(path)
    with open(path, "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:24]}-{os.path.basename(folder)}.bin"
    named = os.path.join(folder, name)
    os.link(path, named)
    spark.sparkContext.addFile(named)
    return name


def encode_documents(docs: DataFrame, tokenizer: str | None = None, lexicon: Lexicon | None = None,
                     size: int = 32_768) -> DataFrame:
    """(doc_id, ids, decoded): little-endian unsigned 32-bit ids of every whole
    text as one binary value, and the text that these ids decode to."""
    path = tokenizer or default_tokenizer()
    name = ship(docs.sparkSession, lexicon or compile_lexicon(docs, path, size))

    def run(batches):
        encoder = Encoder(vocabulary(path), Lexicon.map(SparkFiles.get(name)))
        for batch in slices(batches):
            texts = texts_of(batch)
            for i, j in pieces(texts):
                flat, at = encoder.encode(texts[i:j])
                flat = flat.astype("<u4")
                rows = [flat[a:b] for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([r.tobytes() for r in rows], pa.binary()),
                     pa.array([encoder.vocab.decode(r) for r in rows], pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """BPE of every whole document through the lexicon transducer, and back."""
    return encode_documents(documents(spark, sf_dir)).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
