"""Hierarchical residual packing: best fit by task, then underfull bins as items.

A document's ids, with an end id, are cut into pieces of ``width`` only where
they are longer. Each task packs its pieces by best fit, longest first, in
blocks of ``block`` pieces. Bins with at most ``slack`` tokens to spare are
done; every other bin becomes one item of its fill. The items of several tasks
are dealt into groups of about ``group`` items and packed by best fit again,
and so on up the tree, until one group holds what is left, or a round of
several groups closes no bin any more (all items more than half full, say). A
piece's place is the sum of the offsets on its way to the root. Only
(bin, fill) pairs move between rounds; ids and texts never do.

Words between ASCII white space are tokenised on their own, since this kind of
tokenizer drops white space and never joins across it, so a worker remembers
the ids of words that it has met. New words are tokenised many to a text, with
a mark of one id between them, since each text costs the tokenizer as much as a
few words; where words hold the mark themselves, each is a text of its own.

New words of printable ASCII and the letters of Latin-1 are first cut into the
pieces that the tokenizer's own pattern finds in them, in lower case, and the
ids of pieces are remembered too: a piece stands in many words, with capitals,
commas and brackets. New pieces go through the tokenizer without its normaliser
and pattern, which would leave them as they are. All other words, those that
hold a special token, and all words of a tokenizer with other rules go through
it whole.

Null and empty texts consist of the end id alone. Rows that repeat, and rows
with a null doc_id, are packed each on their own. Extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.llm.common import documents, materialize, slices
from ragscope.llm.memo import Memo

BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECES = ("doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, bin long, offset long, fill long")
END = b""  # stands for the end of a document; no word is empty
MARK = "\x01"  # stands between the words of a text that are tokenised together
JOINED = 128  # words of such a text

# The rules that words may be cut by, as the tokenizer's file has them. In words of
# PLAIN characters, which NFC leaves alone, PIECE finds what RULES' pattern finds.
RULES = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_LINES = re.compile("[\n!-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile("\n|'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@functools.lru_cache(2)
def mark_id(path: str) -> int:
    """The id of a mark between two words; -1 if it has not one id of its own."""
    one, marked = (tokenizer(path).encode(t, add_special_tokens=False).ids for t in ("a", f"a {MARK} a"))
    return marked[len(one)] if len(marked) == 2 * len(one) + 1 and marked == [*one, marked[len(one)], *one] else -1


def tokenise(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each has."""
    runs = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
    mark, flat, sizes = mark_id(path), [], []
    found = tokenizer(path).encode_batch_fast([f" {MARK} ".join([*r, ""]) for r in runs], add_special_tokens=False)
    for run, e in zip(runs, found, strict=True):
        ids = np.array(e.ids, np.int64)
        at = np.flatnonzero(ids == mark)
        if len(at) == len(run):
            flat.append(np.delete(ids, at))
            sizes.append(np.diff(at, prepend=-1) - 1)
        else:  # a word holds the mark, or its id
            apart = [x.ids for x in tokenizer(path).encode_batch_fast(run, add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(apart), np.int64))
            sizes.append(np.fromiter(map(len, apart), np.int64, len(apart)))
    return np.concatenate([np.empty(0, np.int64), *flat]), np.concatenate([np.empty(0, np.int64), *sizes])


@functools.lru_cache(2)
def piece_rules(path: str):
    """The tokenizer of pieces, which ids are the last of a piece, and the special
    tokens that no piece may be cut from; None if words may not be cut by ``RULES``."""
    from tokenizers import Tokenizer, pre_tokenizers
    pieces = Tokenizer.from_file(path)
    rules = json.loads(pieces.to_str())
    model, special = rules["model"], [re.escape(t["content"]) for t in rules["added_tokens"]]
    if ({k: (rules[k] or {}).get(k.replace("_", "") + "s") for k in RULES} != RULES or not model.get("end_of_word_suffix")
            or model.get("continuing_subword_prefix") or model.get("dropout")):
        return None
    pieces.normalizer = None
    pieces.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    last = np.zeros(pieces.get_vocab_size(), bool)
    last[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
    return pieces, last, re.compile("|".join(special) or "(?!)")


def tokenise_pieces(path: str, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces one after another, and how many each has."""
    encoder, last, _ = piece_rules(path)
    runs, flat, sizes = [pieces[i:i + JOINED] for i in range(0, len(pieces), JOINED)], [], []
    for run, e in zip(runs, encoder.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.int64)
        ends = np.flatnonzero(last[ids])
        if len(ends) == len(run) and ends[-1] == len(ids) - 1:
            flat.append(ids)
            sizes.append(np.diff(ends, prepend=-1))
        else:  # a character that the vocabulary has not
            ids, size = tokenise(path, run)
            flat.append(ids)
            sizes.append(size)
    return np.concatenate([np.empty(0, np.int64), *flat]), np.concatenate([np.empty(0, np.int64), *sizes])


def tokenise_words(path: str, words: list[str], known: Memo) -> tuple[np.ndarray, np.ndarray]:
    """As ``tokenise``, by way of the pieces of plain words, which ``known`` keeps."""
    rules = piece_rules(path)
    if rules is None:
        return tokenise(path, words)
    special = rules[2].search
    lines = "\n".join([*words, ""])  # no word holds a line feed
    if special(lines) or not PLAIN_LINES.fullmatch(lines):
        lines = "\n".join([*(w if PLAIN.fullmatch(w) and not special(w) else "" for w in words), ""])
    found = PIECE.findall(lines.lower())  # the line feeds among them end the words
    ends = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
    ids, sizes = known.gather(known.index([p for p in found if p != "\n"]))
    count = np.diff(ends, prepend=-1) - 1
    size = np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(count)], prepend=0)
    whole = np.flatnonzero(count == 0)
    if len(whole):
        more, each = tokenise(path, [words[i] for i in whole.tolist()])
        ids = np.insert(ids, np.repeat(np.cumsum(size)[whole], each), more)
        size[whole] = each
    return ids, size


@functools.lru_cache(2)
def word_ids(path: str, end_id: int) -> Memo:
    """The ids of words, kept from task to task of a worker."""
    known = Memo(functools.partial(tokenise_pieces, path), keys=1 << 19)

    def make(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = tokenise_words(path, [w.decode() for w in words], known)
        if END in words:
            k = words.index(END)
            flat, sizes[k] = np.insert(flat, sizes[:k].sum(), end_id), 1
        return flat, sizes

    return Memo(make)


def parts(data: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """The text cut at white space into parts of about ``limit`` bytes."""
    at = 0
    while len(data) - at > limit:
        cut = BLANK.search(data, at + limit)
        if cut is None:
            break
        yield data[at:cut.start()]
        at = cut.start()
    yield data[at:] if at else data


def encode(memo: Memo, texts: pa.Array, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """Each text's ids and the end id, as little-endian unsigned 32-bit integers,
    worked out for about ``limit`` bytes of texts at a time. Arrow splits them and
    numbers the different words, each of which is looked up once."""
    texts = texts.cast(pa.string()).fill_null("")

    def some(first: int, after: int) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(texts.slice(first, after - first))
        coded = words.flatten().dictionary_encode()
        # an empty word, before or after the outer white space, is no end
        different = [w or b" " for w in coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
        rows = memo.index([*different, END])
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        flat, sizes = memo.gather(np.insert(rows[coded.indices.to_numpy()], ends, rows[-1]))
        upto = np.cumsum(sizes)[ends + np.arange(len(ends))]
        return np.split(flat.astype("<u4"), upto[:-1])

    first = size = 0
    for i, length in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + length > limit:
            yield from some(first, i)
            first, size = i, 0
        if length > limit:  # a long text goes on its own, by parts
            if first < i:
                yield from some(first, i)
            whole = [memo.gather(memo.index(p.split()))[0].astype("<u4") for p in parts(texts[i].as_py().encode(), limit)]
            yield np.concatenate([*whole, memo.gather(memo.index([END]))[0].astype("<u4")])
            first, size = i + 1, 0
        else:
            size += length
    if first < len(texts):
        yield from some(first, len(texts))


def best_fit(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: the longest item
    first, each into the open bin that it leaves the least room in."""
    bin_of, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(width + 1)]
    fills: list[int] = []
    open_rooms = 0  # bit r: some bin has room for r more
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = open_rooms >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = width, len(fills)
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += s
        left = r - s
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bin_of, offset, np.array(fills, np.int64)


def _bins(level: int) -> int:
    """The first number of a task's bins; no other task or level uses them."""
    return (level << 56) + (TaskContext.get().partitionId() << 34)


def local_pieces(docs: DataFrame, path: str, width: int, end_id: int, block: int, with_ids: bool) -> DataFrame:
    """All pieces, each with its bin, offset and the bin's fill, packed by task."""
    def run(batches):
        memo, first = word_ids(path, end_id), _bins(1)
        held: list[tuple] = []

        def flush():
            nonlocal first
            doc, piece, start, length, ids, crc = zip(*held)
            sizes = np.array(length, np.int64)
            bins, offset, fill = best_fit(sizes, width)
            out = pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes),
                 pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), pa.array(bins + first), pa.array(offset),
                 pa.array(fill[bins])],
                names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "bin", "offset", "fill"])
            first += len(fill)
            held.clear()
            return out

        waiting = 0
        for batch in slices(batches, 1 << 12):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(memo, batch.column("text")), strict=True):
                raw = ids.tobytes()
                for piece, a in enumerate(range(0, len(ids), width)):
                    mine = raw[4 * a:4 * (a + width)]
                    held.append((doc, piece, a, len(mine) // 4, mine if with_ids else None, zlib.crc32(mine)))
                waiting += len(ids)
                if len(held) >= block or waiting >= 1 << 24:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def merge_bins(items: DataFrame, level: int, groups: int, width: int) -> DataFrame:
    """(bin, root, offset, fill): the bins of ``groups`` groups packed again."""
    def run(batches):
        table = pa.Table.from_batches(batches, pa.schema([("bin", pa.int64()), ("fill", pa.int64())]))
        if not table.num_rows:
            return
        bins, offset, fill = best_fit(table.column("fill").to_numpy(), width)
        yield from pa.table({"bin": table.column("bin"), "root": bins + _bins(level), "offset": offset,
                             "fill": fill[bins]}).to_batches(1 << 16)

    return (items.repartition(groups, F.xxhash64("bin", F.lit(level))).sortWithinPartitions("bin")
            .mapInArrow(run, "bin long, root long, offset long, fill long"))


def pack(docs: DataFrame, path: str | None = None, width: int = 2048, end_id: int = 0, block: int = 1 << 16,
         slack: int = 4, group: int = 1 << 16, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian
    unsigned 32-bit; null unless ``with_ids``), ids_crc32, sequence_id, offset."""
    pieces = materialize(local_pieces(docs, path or default_tokenizer(), width, end_id, block, with_ids), "pieces")
    underfull = F.col("fill") < width - slack
    # a bin has one piece at offset 0, which stands for it
    items = pieces.where(underfull & (F.col("offset") == 0)).select("bin", "fill")
    rounds, count = [], items.count()
    while count > 1:
        groups = -(-count // group)
        merged = materialize(merge_bins(items, len(rounds) + 2, groups, width), "bins")
        rounds.append(merged)
        items = merged.where(underfull & (F.col("offset") == 0)).select(F.col("root").alias("bin"), "fill")
        before, count = count, items.count()
        if groups == 1 or count > 0.95 * before:
            break
    # from the last round down: where each bin ends up
    place = None
    for merged in reversed(rounds):
        step = merged.select("bin", "root", "offset")
        if place is not None:
            up = place.select(F.col("bin").alias("root"), F.col("root").alias("top"), F.col("offset").alias("more"))
            step = step.join(up, "root", "left").select(
                "bin", F.coalesce("top", "root").alias("root"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
        place = step
    shown = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]
    if place is None:
        return pieces.select(*shown, F.col("bin").alias("sequence_id"), "offset")
    done = pieces.where(~underfull).select(*shown, F.col("bin").alias("sequence_id"), "offset")
    place = place.select("bin", "root", F.col("offset").alias("more"))
    moved = pieces.where(underfull).join(place, "bin", "left").select(
        *shown, F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
    return done.unionByName(moved)


def op13_residual_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, as few as can be."""
    return pack(documents(spark, sf_dir), with_ids=False).drop("ids")
