"""Row selection: metadata filter, exact-N sample, preview, tag filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscope.functions.text import preview


def path_equals(expr: str) -> Column:
    """``field.path=value`` as a predicate.

    ``metadata.<key>`` reads the map; a top-level name reads the column;
    deeper paths read JSON text stored in the map. A missing path never
    matches (Q11); booleans compare as ``true``/``false``.
    """
    if "=" not in expr:
        raise ValueError(f"Invalid filter format: {expr!r}. Use field=value "
                         "(e.g. metadata.category=tech).")
    path, _, value = expr.partition("=")
    parts = path.split(".")
    if parts[0] == "metadata" and len(parts) >= 2:
        v = F.try_element_at(F.col("metadata"), F.lit(parts[1]))
        if len(parts) > 2:
            v = F.get_json_object(v, "$." + ".".join(parts[2:]))
    elif len(parts) == 1:
        v = F.col(parts[0]).cast("string")
    else:
        v = F.get_json_object(F.to_json(F.col(parts[0])), "$." + ".".join(parts[1:]))
    return v.isNotNull() & (v == F.lit(value))


def filter_samples(samples: DataFrame, expr: str) -> DataFrame:
    return samples.where(path_equals(expr))


def sample_n(samples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """exactly ``n`` rows (all rows when fewer), chosen by a seeded hash
    order: deterministic, without replacement; ``limit`` is the feature."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("sample_id").cast("string")))
    return samples.orderBy(order, F.col("sample_id")).limit(int(n))


def sample_fraction(samples: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """F2, approximate size: Bernoulli sample."""
    return samples.sample(withReplacement=False, fraction=fraction, seed=seed)


def preview_samples(samples: DataFrame, n: int = 3, seed: int = 0, width: int = 200) -> DataFrame:
    """a few rows with texts cut to ``width`` characters."""
    picked = sample_n(samples, n, seed)
    return picked.select("sample_id", F.substring("query", 1, width).alias("query"),
                         F.substring("answer", 1, width).alias("answer"),
                         F.transform("context", lambda c: F.substring(c, 1, width)).alias("context"),
                         preview("query").alias("query_preview"))


def by_tag(runs: DataFrame, tag: str | None) -> DataFrame:
    """F7."""
    return runs if tag is None else runs.where(F.col("tag") == tag)
