"""Exact distribution statistics per group by selection.

The values are stored once as a narrow table. A group is a cell at first. A
cell of more than ``most`` values is cut by a sketch of bounded size into
``cells`` of about equal size; a pass counts the rows of every new cell where
they are (only one count per task and cell moves), and the counts tell which
cells hold the wanted ranks. These are cut again in the same way until they are
small; only the opened cells' values move and are sorted, no more than ``most``
of them in one task. The cuts decide where the work goes and never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragscope.storage import store

QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
CELLS = 256
#: Values of one opened cell that are sorted in one task.
MOST = 1 << 18
#: Rows of per-group facts (cuts, cells) up to which they are sent to every task.
BROADCAST_ROWS = 1 << 13


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns], F.lit(True))


def _facts(df: DataFrame, name: str) -> DataFrame:
    """Per-group facts, stored; sent to every task while they are few."""
    df = store(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _cell(cuts: Column, value: Column, cells: int) -> Column:
    """How many of the rising ``cuts`` (``cells`` - 1 at most) lie below
    ``value``, by halving. (A fold: as nested conditions, the expression would
    double with every step.)"""
    steps = [1 << k for k in reversed(range((cells - 1).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def _counted(values: DataFrame, cuts: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """(keys, part, cell, rows, lo, hi) of the values inside the parts of ``cuts``:
    (keys, part, lo, hi, cuts), a part being the values from lo to hi."""
    inside = _same("q", "s", keys) & (F.col("q.v") >= F.col("s.lo")) & (F.col("q.v") <= F.col("s.hi"))
    placed = values.where("v IS NOT NULL").alias("q").join(cuts.alias("s"), inside).select(
        *[F.col(f"q.{k}") for k in keys], "s.part", "q.v", F.col("s.cuts").alias("_cuts"))
    placed = placed.withColumn("cell", _cell(F.col("_cuts"), F.col("v"), cells)).drop("_cuts")
    return placed.groupBy(*keys, "part", "cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _open(counts: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """The cells that hold a wanted rank, each with the rows before it.
    ``ranks``: (keys, part, before, wanted array of 0-based ranks)."""
    order = Window.partitionBy(*keys, "part").orderBy("cell")
    upto = F.sum("rows").over(order)
    joined = counts.withColumn("_upto", upto).alias("c").join(
        ranks.alias("r"), _same("c", "r", keys) & (F.col("c.part") == F.col("r.part"))).select(
        *[F.col(f"c.{k}") for k in keys], "c.cell", "c.rows", "c.lo", "c.hi",
        (F.col("r.before") + F.col("c._upto") - F.col("c.rows")).alias("before"),
        F.col("r.wanted").alias("_w"))
    mine = F.filter("_w", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("rows")))
    return joined.select(*keys, "rows", "lo", "hi", "before", mine.alias("wanted")).where(F.size("wanted") > 0)


def distribution_of(df: DataFrame, keys: list[str], value: Column, extra: list[Column] | None = None,
                    cells: int = CELLS, most: int = MOST) -> DataFrame:
    """A2 per group: n, mean, min, max, p25, median, p75 (linear interpolation
    at ``(n-1)p``), population std_dev, and ``extra`` aggregates, which may use
    the keys, ``v`` and any other column of ``df``.

    Null values count towards ``extra`` alone; a group of nulls has n = 0 and
    null statistics. Groups whose key is null are groups like others. NaN
    sorts after every number.
    """
    used = [c for c in df.columns if c not in keys and c != "v"] if extra else []
    values = store(df.select(*keys, value.cast("double").alias("v"), *used), "values")
    stats = store(values.groupBy(*keys).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.stddev_pop("v").alias("std_dev"), *(extra or [])), "stats")
    last = F.col("n") - 1
    wanted = F.array_sort(F.array_distinct(F.array(
        *[f(last * F.lit(p)).cast("long") for p in QUANTILES.values() for f in (F.floor, F.ceil)])))
    # whole groups are the first cells
    opened = stats.where("n > 0").select(*keys, F.col("n").alias("rows"), F.col("min").alias("lo"), F.col("max").alias("hi"),
                                         F.lit(0).cast("long").alias("before"), wanted.alias("wanted"))
    # one value: nothing to sort. Few: sorted below. Others are cut again.
    is_large = (F.col("lo") < F.col("hi")) & (F.col("rows") > most)
    small, few = opened.where(~is_large), stats.count() <= BROADCAST_ROWS
    while not opened.where(is_large).isEmpty():
        large = store(opened.where(is_large).withColumn("part", F.xxhash64("lo", "hi")), "large")
        inside = _same("q", "s", keys) & (F.col("q.v") >= F.col("s.lo")) & (F.col("q.v") <= F.col("s.hi"))
        mine = values.alias("q").join(_facts(large.select(*keys, "part", "lo", "hi"), "ranges").alias("s"), inside)
        sketch = F.percentile_approx("q.v", [i / cells for i in range(1, cells)], 4 * cells)
        parts = mine.groupBy(*[F.col(f"q.{k}").alias(k) for k in keys], "s.part", "s.lo", "s.hi").agg(
            F.array_distinct(sketch).alias("cuts"))
        ranks = large.select(*keys, "part", "before", "wanted")
        opened = store(_open(_counted(values, _facts(parts, "parts"), keys, cells), ranks, keys), "opened")
        small, few = small.unionByName(opened.where(~is_large)), few and opened.count() <= BROADCAST_ROWS
    one = small.where("lo = hi").select(*keys, F.explode("wanted").alias("rank"), F.col("lo").alias("v"))
    ranges = F.broadcast(small.where("lo < hi")) if few else small.where("lo < hi")
    inside = _same("q", "s", keys) & (F.col("q.v") >= F.col("s.lo")) & (F.col("q.v") <= F.col("s.hi"))
    moved = values.alias("q").join(ranges.alias("s"), inside).groupBy(
        *[F.col(f"q.{k}").alias(k) for k in keys], F.col("s.before").alias("before"), F.col("s.wanted").alias("wanted"),
        F.col("q.v").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    end = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "before").orderBy("v"))
    moved = moved.withColumn("_end", end)
    hit = F.filter("wanted", lambda r: (r >= F.col("_end") - F.col("c")) & (r < F.col("_end")))
    found = one.unionByName(moved.select(*keys, F.explode(hit).alias("rank"), "v"))
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))
    # six ranks a group at most
    named = [c for c in stats.columns if c not in (*keys, "_cuts", "std_dev")]
    both = stats.alias("a").join(found.alias("b"), _same("a", "b", keys), "left").select(
        *[F.col(f"a.{k}") for k in keys], *[F.col(f"a.{c}") for c in named], "a.std_dev", "b._at")

    def between(p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(p)
        low = F.try_element_at("_at", F.floor(at).cast("long"))
        high = F.try_element_at("_at", F.ceil(at).cast("long"))
        share = at - F.floor(at)
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share)

    return both.select(*keys, *named, *[between(p).alias(q) for q, p in QUANTILES.items()], "std_dev")
