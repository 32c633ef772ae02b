"""Repeated passages: rows that share a doc_id, clashing columns, heavy windows, levels."""

import random
import re

from ragscope.llm import substring


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def plain(rows, window):
    """Words kept by every row, looking at each window of each document."""
    first = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def test_rows_of_one_document_and_clashing_columns(spark):
    common = words("c", 70)
    rows = [(1, words("a", 60)), (1, "short"), (1, common), (2, common + " " + words("a", 60)), (2, "x " + common),
            (2, "x " + common), (3, ""), (3, None), (4, words("b", 55)), (4, words("b", 55))]
    rows += [(i, common) for i in range(10, 60)]
    r = random.Random(3)
    rows += [(100 + i, " ".join(r.choices(["p", "q"], k=r.randint(0, 120)))) for i in range(30)]
    for window in (50, 7):
        table = spark.createDataFrame([(i, t, 1, "k", 2, 3) for i, t in rows],
                                      "doc_id long, text string, drop int, kept string, n_words int, seen int").repartition(4)
        got = substring.remove_repeats(table, window)
        assert got.columns == ["doc_id", "text", "drop", "seen", "n_words", "n_removed", "kept"]
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == plain(rows, window)


def test_levels_go_on_until_nothing_survives(spark):
    long = words("m", 210)
    rows = [(1, long), (2, "x " + long + " y"), (3, words("m", 120)), (4, words("z", 400)), (5, None), (6, words("m", 49)),
            (6, words("z", 60))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.longest for r in substring.longest_repeats(table).collect()}
    assert got == {1: 200, 2: 200, 3: 100, 4: 50, 6: 50}
    assert substring.longest_repeats(table.where("doc_id = 4")).isEmpty()
