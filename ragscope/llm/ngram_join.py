"""Near-duplicate documents by Jaccard similarity of word n-grams.

An exact self-join with a token-group matrix. Documents with equal shingle
sets are one unit. Units are put into groups of similar ones (equal smallest
hashes, similar size; a hot key is split into groups of bounded size); the
matrix holds, for each group, the union of its units' tokens, one row per
(token, group). Two groups are opened only if the tokens that they share leave
room for a link, and within an opened pair only the units whose overlap with
the other group's whole union is large enough are compared, as one product of
small 0/1 matrices. A block returns a spanning forest of its links, never all
pairs.

Near copies of one text differ in their smallest hashes, and all hold its
tokens. Units with a token of more than ``HOT`` units are therefore first held
against one other each, the hub: of the units that have such a token, the one
that has most of them. Those that link with a hub are a family, one component,
whose groups need no comparison with each other; the matrix has one row per
(token, family). Those at least half like it are grouped by it. Which hub a
unit meets changes the work and never the result.

Only a prefix of each unit enters the matrix: under one order of all tokens,
two linked units share a token among their first |x| - ceil(t|x|) + 1. The
order is by hash, but tokens that are frequent in the corpus come last, so
common lines and passages do not bring unrelated documents together. Which
tokens count as frequent changes the work and never the result.

Null, empty and blank texts have no shingles and link with nothing; a text of
fewer words than the shingle size is one shingle. Rows with a null doc_id keep
a null component. Repeated rows of one doc_id with equal texts are one unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragscope.llm.common import (as_long, connected_components, discard, documents, give_back, materialize, mix64, slices,
                                 small_batches, texts_of, window_hashes, word_hashes)

HOT = 64  # units that hold a token beyond which it comes last in the order
GROUP_UNITS, GROUP_TOKENS = 128, 1 << 17


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes (as signed integers)."""
    words, _, _, _ = word_hashes(text, lower=True)
    if not len(words):
        return np.empty(0, np.int64)
    if len(words) < size:
        return as_long(mix64(window_hashes(words, len(words)) + np.uint64(len(words))))
    return np.unique(as_long(window_hashes(words, size)))


def prefix_size(n, percent: int):
    """|x| - ceil(t|x|) + 1."""
    return n - (percent * n + 99) // 100 + 1


def describe(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, the set's signature, its group key and its first tokens.

    ``first`` is null where a text with the same set came earlier in the task.
    """
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            n, sig, key, first, shown = [], [], [], [], []
            for text in texts_of(batch):
                t = shingles(text, size)
                u = t.view(np.uint64)
                s = (int(mix64(u).sum(dtype=np.uint64).view(np.int64)),
                     int(mix64(u ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64).view(np.int64)))
                n.append(len(t))
                sig.append(s)
                if not len(t) or s in seen:
                    key.append(0)
                    first.append(None)
                    continue
                if len(seen) < 500_000:  # a miss costs a repeated row, nothing else
                    seen.add(s)
                # two smallest hashes of other functions, and the size class
                a, b = mix64(u ^ np.uint64(0x9E3779B97F4A7C15)).min(), mix64(u ^ np.uint64(0xC2B2AE3D27D4EB4F)).min()
                level = np.uint64(int(np.log(len(t)) / np.log(1.25)))
                mixed = np.array([a, b, level]) * np.array([31, 1, 0x9E3779B97F4A7C15], np.uint64)
                key.append(int(mix64(mixed.sum(keepdims=True)).view(np.int64)[0]))
                k = prefix_size(len(t), percent)
                first.append(t[:k + max(k // 2, min(k, 32))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([s[0] for s in sig], pa.int64()),
                 pa.array([s[1] for s in sig], pa.int64()), pa.array(key, pa.int64()),
                 pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "n", "sig_a", "sig_b", "key", "first"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, sig_a long, sig_b long, key long, first array<long>")


def texts_of_units(units: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.join(units.select(F.col("unit").alias("doc_id"), "unit"), "doc_id").select("unit", "text")


def token_rows(units: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """unit and its whole token set (little-endian 64-bit), from the texts."""
    def run(batches):
        for batch in slices(batches):
            sets = [shingles(t, size).astype("<i8").tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(sets, pa.binary())],
                                             names=["unit", "tokens"])

    return texts_of_units(units, docs).mapInArrow(run, "unit long, tokens binary")


def exploded_tokens(units: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(unit, t) for every token of the units, from the texts."""
    def run(batches):
        for batch in slices(batches):
            for unit, text in zip(batch.column("unit").to_pylist(), texts_of(batch), strict=True):
                t = shingles(text, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), unit)), pa.array(t)], names=["unit", "t"])

    return texts_of_units(units, docs).mapInArrow(run, "unit long, t long")


def matrix_rows(described: DataFrame, units: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(t, unit): each unit's prefix under the order, without tokens of one unit alone."""
    emitted = described.where("first IS NOT NULL").select("doc_id", F.posexplode("first").alias("pos", "t"))
    shared = materialize(emitted.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t"), "shared")
    member = units.select(F.col("unit").alias("doc_id"), "unit", "k", "m", "n")
    rows = materialize(emitted.join(shared, "t").join(member, "doc_id").select("t", "unit", "pos", "k", "m", "n"),
                       "postings")
    count = materialize(rows.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
                        .select("t", (F.col("c") > HOT).alias("hot")), "counts")
    first, rows = rows, materialize(rows.join(count, "t"), "postings2")
    discard(first)
    # how far a unit's prefix reaches once its frequent tokens stand last
    late = (rows.where("hot").groupBy("unit").agg(F.sort_array(F.collect_list("pos")).alias("late"),
                                                  F.first("k").alias("k"), F.first("m").alias("m"),
                                                  F.first("n").alias("n"))
            .withColumn("reach", F.aggregate("late", F.col("k").cast("long"),
                                             lambda a, p: F.when(p < a, a + 1).otherwise(a)))
            .withColumn("fill", F.col("k") - (F.col("n") - F.size("late"))))
    late = materialize(late.select("unit", "reach", "fill", ((F.col("reach") > F.col("m")) & (F.col("m") < F.col("n")))
                                   .alias("hard")), "late")
    rows = rows.join(late, "unit", "left")
    easy = rows.where("NOT coalesce(hard, false)")
    kept = easy.where("NOT hot AND pos < coalesce(reach, k)").select("t", "unit")
    # wholly emitted units with too few rare tokens go on with frequent ones
    order = Window.partitionBy("unit").orderBy("pos")
    more = easy.where("hot AND fill > 0").withColumn("i", F.row_number().over(order)).where("i <= fill").select("t", "unit")
    hard = materialize(late.where("hard").join(units.select("unit", "k"), "unit").select("unit", "k"), "hard-units")
    if hard.isEmpty():
        return kept.unionByName(more)
    everything = exploded_tokens(hard, docs, size).distinct()
    ranked = (everything.join(count.where("hot"), "t", "left").join(hard, "unit")
              .withColumn("i", F.row_number().over(Window.partitionBy("unit").orderBy(F.coalesce("hot", F.lit(False)), "t")))
              .where("i <= k"))
    ranked = materialize(ranked.select("t", "unit", "hot"), "hard")
    # beyond what such a unit had emitted, its tokens may have one holder so far
    last = described.join(hard.select(F.col("unit").alias("doc_id"), "unit"), "doc_id").select(
        "unit", F.element_at("first", -1).alias("last"))
    # (not by shared: there, copies of one unit in other tasks count as holders)
    fresh = (ranked.where("hot IS NULL").join(last, "unit").where("t > last").select("t").distinct()
             .join(count, "t", "left_anti"))
    fresh = materialize(fresh, "fresh")
    reach = late.select("unit", "reach", F.col("hard").alias("is_hard"))
    alone = (emitted.join(fresh, "t").join(member, "doc_id").join(reach, "unit", "left")
             .where("NOT coalesce(is_hard, false) AND pos < coalesce(reach, k)").select("t", "unit"))
    # frequent tokens stand in the prefixes of hard and wholly emitted units only
    return kept.unionByName(more).unionByName(ranked.select("t", "unit")).unionByName(alone)


def _forest(left: np.ndarray, right: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """For each linked unit of a block, an edge to the smallest unit it reaches there."""
    a, b = left.copy(), right.copy()
    big = np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(link, b[None], big).min(1, initial=big))
        b2 = np.minimum(b, np.where(link, a2[:, None], big).min(0, initial=big))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    nodes, roots = np.concatenate((left, right)), np.concatenate((a, b))
    return [(int(u), int(r)) for u, r in zip(nodes, roots) if u != r]


def _compare(left: list[dict], right: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between the units of two groups (or of one), as a forest."""
    sets_a = [np.frombuffer(x["tokens"], "<i8") for x in left]
    sets_b = [np.frombuffer(x["tokens"], "<i8") for x in right]

    def bound(sets, union):
        # a unit's overlap with the whole group bounds that with each member
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
        inside = union[at] == flat
        hits = np.bincount(owner[inside], minlength=len(sets))
        return size, owner[inside], at[inside], np.flatnonzero(100 * hits >= percent * size)

    size_b, own_b, col_b, open_b = bound(sets_b, np.unique(np.concatenate(sets_a)))
    if not len(open_b):
        return []
    union = np.unique(np.concatenate([sets_b[i] for i in open_b]))
    size_a, own_a, col_a, open_a = bound(sets_a, union)
    if not len(open_a):
        return []
    used = np.unique(col_a[np.isin(own_a, open_a)])
    col = np.full(len(union), -1)
    col[used] = np.arange(len(used))
    matrix_a = np.zeros((len(sets_a), len(used)), np.float32)
    ok = col[col_a] >= 0
    matrix_a[own_a[ok], col[col_a[ok]]] = 1
    matrix_b = np.zeros((len(open_b), len(used)), np.float32)
    for row, i in enumerate(open_b):
        c = col[np.searchsorted(union, sets_b[i])]
        matrix_b[row, c[c >= 0]] = 1
    inter = np.rint(matrix_a[open_a] @ matrix_b.T).astype(np.int64)
    link = 100 * inter >= percent * (size_a[open_a][:, None] + size_b[open_b][None] - inter)
    ids_a = np.array([left[i]["unit"] for i in open_a], np.int64)
    ids_b = np.array([right[i]["unit"] for i in open_b], np.int64)
    link &= ids_a[:, None] != ids_b[None]
    return _forest(ids_a, ids_b, link) if link.any() else []


def near_hubs(rows: DataFrame, live: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """unit, hub, linked: the units of frequent tokens that are at least half
    like their hub, and whether they link with it."""
    hot = rows.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("t")
    busy = materialize(rows.join(hot, "t").select("t", "unit"), "busy")
    weight = busy.groupBy("unit").agg(F.count(F.lit(1)).alias("w"))
    hub = (busy.join(weight, "unit").groupBy("t").agg(F.min(F.struct((-F.col("w")).alias("w"), "unit")).alias("m"))
           .select("t", F.col("m.unit").alias("hub")))
    met = busy.join(hub, "t").where("unit <> hub").groupBy("unit", "hub").agg(F.count(F.lit(1)).alias("c"))
    met = met.groupBy("unit").agg(F.min(F.struct((-F.col("c")).alias("c"), "hub")).alias("m")).select("unit", F.col("m.hub").alias("hub"))
    met = materialize(met.join(live.select("unit", "n").dropDuplicates(["unit"]), "unit"), "met")
    parts = met.groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_UNITS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("parts"))
    met = materialize(met.join(parts, "hub").select("unit", "hub", F.pmod(F.xxhash64("unit"), "parts").alias("part")), "met-parts")
    ids = materialize(met.select("unit").union(met.select("hub")).distinct().sortWithinPartitions("unit"), "met-ids")
    tokens = materialize(token_rows(ids, docs, size).dropDuplicates(["unit"]), "met-tokens")
    members = met.join(tokens, "unit").groupBy("hub", "part").agg(F.collect_list(F.struct("unit", "tokens")).alias("members"))
    heads = met.select("hub", "part").distinct().join(tokens.select(F.col("unit").alias("hub"), F.col("tokens").alias("head")), "hub")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                hub, head = batch.column("hub")[i].as_py(), np.frombuffer(batch.column("head")[i].as_py(), "<i8")
                units, linked = [], []
                for x in batch.column("members")[i].as_py():
                    mine = np.frombuffer(x["tokens"], "<i8")
                    inter = len(np.intersect1d(mine, head, assume_unique=True))
                    union = len(mine) + len(head) - inter
                    if 2 * inter >= union or 100 * inter >= percent * union:
                        units.append(x["unit"])
                        linked.append(100 * inter >= percent * union)
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array([hub] * len(units), pa.int64()),
                                                  pa.array(linked, pa.bool_())], names=["unit", "hub", "linked"])
        give_back()

    found = members.join(heads, ["hub", "part"]).select("hub", "head", "members").mapInArrow(run, "unit long, hub long, linked boolean")
    found = materialize(found, "near-hubs")
    discard(busy, met, ids, tokens)
    return found


def with_families(live: DataFrame, near: DataFrame) -> DataFrame:
    """``live`` with the family ``f`` of each unit (null without one), and the
    key of its hub in place of its own where it has one."""
    heads = near.where("linked").select(F.col("hub").alias("unit")).distinct()
    placed = near.join(heads, "unit", "left_anti").select("unit", "hub", F.when(F.col("linked"), F.col("hub")).alias("f"))
    placed = placed.unionByName(heads.select("unit", F.col("unit").alias("hub"), F.col("unit").alias("f")))
    level = F.when(F.col("f").isNull(), F.floor(F.log("n") / F.log(F.lit(1.25))))
    return live.join(placed, "unit", "left").select(
        "unit", F.when(F.col("hub").isNull(), F.col("key")).otherwise(F.xxhash64("hub", level)).alias("key"), "n", "k", "f")


def open_groups(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links found within the pairs (g1, g2) of groups, and within each
    group that is not of a family."""
    def run(batches):
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                x = batch.column("x")[i].as_py()
                y = batch.column("y")[i].as_py()
                for u, v in _compare(x, x if y is None else y, percent):
                    a.append(u)
                    b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    own = groups.where("NOT family").where(F.size("members") > 1).select(F.col("members").alias("x"), F.lit(None).cast(
        groups.schema["members"].dataType).alias("y"))
    cross = (pairs.join(groups.select(F.col("g").alias("g1"), F.col("members").alias("x")), "g1")
             .join(groups.select(F.col("g").alias("g2"), F.col("members").alias("y")), "g2").select("x", "y"))
    return own.unionByName(cross).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links
    of Jaccard similarity of at least ``percent`` / 100."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs.select("doc_id", "text"), size, percent)


def _near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """All tables that Python makes are written here."""
    described = materialize(describe(docs, size, percent), "described")
    sets = described.where("n > 0 AND doc_id IS NOT NULL")
    units = sets.groupBy("sig_a", "sig_b", "n").agg(
        F.min("doc_id").alias("rep"),
        F.min(F.when(F.col("first").isNotNull(), F.struct("doc_id", "key", F.size("first").alias("m")))).alias("c"))
    units = materialize(units.select("sig_a", "sig_b", "n", "rep", F.col("c.doc_id").alias("unit"), F.col("c.key").alias("key"),
                                     F.col("c.m").cast("long").alias("m"),
                                     F.expr(f"n - ({percent} * n + 99) DIV 100 + 1").alias("k")), "units")
    rows = materialize(matrix_rows(described.where("doc_id IS NOT NULL"), units, docs.where("doc_id IS NOT NULL"), size)
                       .distinct(), "matrix")
    # what the rest needs of the texts' description is narrow
    described, wide = materialize(described.select("doc_id", "n", "sig_a", "sig_b"), "documents"), described
    discard(wide)
    # groups: units with the same key, split where they are many
    live = rows.select("unit").distinct().join(units.select("unit", "key", "n", "k"), "unit")
    live = materialize(live, "live")
    near = near_hubs(rows, live, docs.where("doc_id IS NOT NULL"), size, percent)
    live = materialize(with_families(live, near), "live-families")
    hot = (live.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
           .withColumn("parts", F.greatest(F.ceil(F.col("c") / GROUP_UNITS), F.ceil(F.col("s") / GROUP_TOKENS)))
           .where("c > 1").select("key", "parts"))
    grouped = live.join(hot, "key", "left").withColumn(
        "g", F.when(F.col("parts").isNull(), F.col("unit")).otherwise(
            F.xxhash64("key", F.pmod(F.xxhash64("unit"), F.col("parts")))))
    grouped = grouped.select("unit", "g", "n", "k", F.coalesce("f", "g").alias("f"), F.col("f").isNotNull().alias("family"))
    grouped = materialize(grouped, "groups")
    stats = grouped.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("k")).alias("rest"))
    held = rows.join(grouped.select("unit", "g", "f"), "unit").select("t", "g", "f").distinct().join(stats, "g")
    matrix = held.groupBy("t", "f").agg(F.collect_list(F.struct("g", "lo", "hi", "rest")).alias("gs"), F.min("lo").alias("lo"),
                                        F.max("hi").alias("hi"))
    matrix = materialize(matrix, "token-group")
    p, q = matrix.alias("p"), matrix.alias("q")
    room = f"100 * p.hi >= {percent} * q.lo AND 100 * q.hi >= {percent} * p.lo"
    need = F.ceil(F.lit(percent) * (F.col("lo1") + F.col("lo2")) / F.lit(100 + percent) - F.lit(1e-9))
    # families meet by token first; only those that differ unfold into groups
    met = p.join(q, F.expr("p.t = q.t AND p.f < q.f") & F.expr(room)).select(F.explode("p.gs").alias("p"), F.col("q.gs").alias("gs"))
    pairs = (met.select("p", F.explode("gs").alias("q")).where(room).groupBy(F.col("p.g").alias("g1"), F.col("q.g").alias("g2"))
             .agg(F.count(F.lit(1)).alias("c"), F.first("p.lo").alias("lo1"), F.first("q.lo").alias("lo2"),
                  F.greatest(F.first("p.rest"), F.first("q.rest")).alias("rest"))
             .where(F.col("c") + F.col("rest") >= need).select("g1", "g2"))
    pairs = materialize(pairs, "pairs")
    many = grouped.where("NOT family").groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g")
    wanted = pairs.select(F.col("g1").alias("g")).union(pairs.select(F.col("g2").alias("g"))).union(many).distinct()
    chosen = materialize(grouped.join(wanted, "g").select("unit", "g", "family"), "opened")
    # ids alone, in order: a table small enough to be sent to the texts up to
    # some size, beyond which the planner shuffles both
    ids = materialize(chosen.select("unit").sortWithinPartitions("unit"), "opened-ids")
    tokens = token_rows(ids, docs.where("doc_id IS NOT NULL"), size).dropDuplicates(["unit"])
    groups = materialize(tokens.join(chosen, "unit").groupBy("g").agg(
        F.collect_list(F.struct("unit", "tokens")).alias("members"), F.first("family").alias("family")), "members")
    links = open_groups(pairs, groups, percent).unionByName(near.where("linked").select(F.col("unit").alias("a"), F.col("hub").alias("b")))
    links = materialize(links.distinct(), "links")
    # components of units, then of documents
    cc = connected_components(links)
    unit = units.join(cc, units.unit == cc.node, "left").select(
        "sig_a", "sig_b", "n", "rep", F.coalesce("component", "unit").alias("root"))
    best = unit.groupBy("root").agg(F.min("rep").alias("component_id"))
    unit = unit.join(best, "root").select("sig_a", "sig_b", "n", "component_id")
    return described.select("doc_id", "n", "sig_a", "sig_b").join(unit, ["sig_a", "sig_b", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(
            F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: five words, Jaccard 0.8 or more."""
    return near_duplicates(documents(spark, sf_dir))
