"""Order-preserving packing of tokenised documents into sequences.

The documents of an input partition form one stream, in their order. Windows
of at most ``width`` tokens cut the stream; a cut may fall after a document
(free), after a sentence (a small penalty) or, only where neither comes within
``width`` tokens, anywhere else (a large one). Dynamic programming over these
places finds the cuts with the least padding plus penalties:

    f(j) = penalty(j) + min over i of  f(i) + width - (p_j - p_i)

The minimum of f(i) + p_i over the last ``width`` tokens comes from a monotone
queue, so a block costs time in proportion to its places. A window whose
length is a power of two needs no padding. Blocks end at a document's end, and
a stream is cut into blocks of about ``block`` tokens, so memory is bounded by
a block plus the longest document.

Null text is the empty text, and consists of the end id alone. Repeated rows
are packed each on their own. Extra columns are not read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.llm.bpe import Encoder, Vocabulary, default_tokenizer, pieces, vocabulary
from ragscope.llm.common import documents, slices, texts_of

SENTENCE_COST, SPLIT_COST, WINDOW_COST = 4, 64, 8
ENDS = b".!?\n"
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, from 0 to its length, and their penalties."""
    cost = np.full(len(ids) + 1, -1, dtype=np.int64)
    cost[1:][sentence[ids]] = SENTENCE_COST
    cost[0] = 0
    cost[doc_ends] = 0
    at = np.flatnonzero(cost >= 0)
    far = np.flatnonzero(np.diff(at) > width)
    if len(far):  # no boundary for more than a window
        extra = [np.arange(at[i] + width, at[i + 1], width) for i in far]
        more = np.concatenate(extra)
        cost[more] = SPLIT_COST
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def choose_cuts(at: np.ndarray, cost: np.ndarray, width: int) -> np.ndarray:
    """The places at which to cut, first and last included: the cheapest windows."""
    places, costs = at.tolist(), cost.tolist()
    # earlier places at a distance that is a power of two
    exact: dict[int, list[int]] = {}
    for k in range(4, width.bit_length()):
        if 1 << k < width:
            i = np.searchsorted(at, at - (1 << k))
            j = np.flatnonzero(at[i] == at - (1 << k))
            for a, b in zip(j.tolist(), i[j].tolist()):
                exact.setdefault(a, []).append(b)
    best, came = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f + p, p, index
    none: tuple[int, ...] = ()
    for j in range(1, len(places)):
        p = places[j]
        while queue[0][1] < p - width:
            queue.popleft()
        low, _, source = queue[0]
        low += width - p
        for i in exact.get(j, none):
            if best[i] < low:
                low, source = best[i], i
        f = best[j] = low + costs[j] + WINDOW_COST
        came[j] = source
        key = f + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts, j = [len(places) - 1], len(places) - 1
    while j:
        j = came[j]
        cuts.append(j)
    return at[cuts[::-1]]


def pack_block(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, width: int):
    """Pieces of a block: document, start, end, window and offset of each."""
    cuts = choose_cuts(*cut_places(ids, doc_ends, sentence, width), width)
    bounds = np.union1d(cuts, doc_ends)
    bounds = bounds[bounds > 0]
    begin = np.concatenate(([0], bounds[:-1]))
    doc = np.searchsorted(doc_ends, begin, side="right")
    window = np.searchsorted(cuts, begin, side="right") - 1
    doc_begin = np.concatenate(([0], doc_ends[:-1]))
    return doc, begin - doc_begin[doc], begin, bounds, window, begin - cuts[window]


def sentence_ends(vocab: Vocabulary) -> np.ndarray:
    """Which ids end a sentence: their last byte is a full stop, or a line's end."""
    last = vocab.token_bytes[np.maximum(vocab.token_at + vocab.token_len - 1, 0)]
    return np.isin(last, list(ENDS)) & (vocab.token_len > 0)


def pack(docs: DataFrame, tokenizer: str | None = None, width: int = 1024, end_id: int = 0,
         block: int = 1 << 18) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id and offset. No row is shuffled."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        vocab = vocabulary(path)
        encoder, sentence = Encoder(vocab), sentence_ends(vocab)
        sequence = TaskContext.get().partitionId() << 40
        doc_ids, held, sizes = [], [], []

        def flush():
            nonlocal sequence
            ids = np.concatenate(held)
            size = np.array(sizes, dtype=np.int64)
            doc, start, a, b, window, offset = pack_block(ids, np.cumsum(size), sentence, width)
            raw = ids.astype("<u4").tobytes()
            out = pa.RecordBatch.from_arrays(
                [pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(start, pa.int64()),
                 pa.array(b - a, pa.int64()),
                 pa.array([raw[4 * i:4 * j] for i, j in zip(a.tolist(), b.tolist())], pa.binary()),
                 pa.array(size[doc], pa.int64()), pa.array(window + sequence, pa.int64()),
                 pa.array(offset, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += int(window[-1]) + 1
            for x in (doc_ids, held, sizes):
                x.clear()
            return out

        waiting = 0
        for batch in slices(batches):
            texts, keys = texts_of(batch), batch.column("doc_id").to_pylist()
            for i, j in pieces(texts):
                flat, at = encoder.encode(texts[i:j])
                for k in range(j - i):
                    one = flat[at[k]:at[k + 1]]
                    held += [one, np.array([end_id], np.int32)]
                    sizes.append(len(one) + 1)
                    doc_ids.append(keys[i + k])
                    waiting += len(one) + 1
                    if waiting >= block:
                        yield flush()
                        waiting = 0
        if waiting:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return digest(pack(documents(spark, sf_dir)))
