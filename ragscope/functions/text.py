"""Deterministic text functions as Spark Columns (JVM-side, codegen-friendly).

Each function takes Columns and returns a Column, so every metric built from
them stays one projection per sample row with no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules for equal results.
# ---------------------------------------------------------------------------

# Characters Python's str.split()/str.strip() treat as whitespace, in code
# point order: \t \n \v \f \r, the four separators \x1c-\x1f, space, \x85,
# NBSP, OGHAM SPACE MARK, EN QUAD..HAIR SPACE, LINE SEPARATOR, PARAGRAPH
# SEPARATOR, NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex class body (Java and RE2 both read \x{..}).
WS_CLASS = (r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}"
            r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Same class without the newline (for per-line rules run on a whole text).
WS_CLASS_NO_NL = (r"\t\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}"
                  r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

TOKEN_PATTERN = "[a-z0-9]+"

# Keyword scan for toxic content: insults, threats, hate groups, generalised
# hate. Case-insensitive, word-bounded; one hit per pattern at most.
TOXIC_PATTERNS = [
    r"\b(idiot|stupid|dumb|moron|fool|loser|trash|garbage)\b",
    r"\b(kill|murder|attack|hurt|harm|destroy)\s+(yourself|them|him|her)\b",
    r"\b(racist|sexist|bigot|nazi|supremacist)\b",
    r"\b(hate|despise|loathe)\s+(all|every|these|those)\b",
]

# Format rules.
HEADING_RULE = r"^#{1,6}\s+"          # on the stripped text
BULLET_RULE = r"^\s*[-*+]\s+"         # per line, at least two lines
NUMBERED_RULE = r"^\s*\d+[.)]\s+"     # per line, at least two lines

# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(text) -> Column:
    """``str.strip()``: drop Python whitespace at both ends."""
    return F.trim(_col(text), F.lit(PY_WHITESPACE))


def token_set(text) -> Column:
    """Distinct lowercase ``[a-z0-9]+`` tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), 0))


def token_f1_from_counts(na, nr, common) -> Column:
    """X2 from set sizes: both empty -> 1.0; one empty or no overlap -> 0.0;
    else ``2pr/(p+r)`` with ``p = common/na`` and ``r = common/nr``."""
    na, nr, common = _col(na), _col(nr), _col(common)
    precision = common / na
    recall = common / nr
    f1 = F.lit(2.0) * precision * recall / (precision + recall)
    return (F.when((na == 0) & (nr == 0), F.lit(1.0))
            .when((na == 0) | (nr == 0) | (common == 0), F.lit(0.0))
            .otherwise(f1))


def token_f1_from_sets(a_tokens, r_tokens) -> Column:
    """X2 on precomputed token sets.

    Both empty -> 1.0; one empty or no overlap -> 0.0; else 2pr/(p+r).
    """
    a, r = _col(a_tokens), _col(r_tokens)
    na, nr = F.size(a), F.size(r)
    common = F.size(F.array_intersect(a, r))
    precision = common / na
    recall = common / nr
    f1 = F.lit(2.0) * precision * recall / (precision + recall)
    return (F.when((na == 0) & (nr == 0), F.lit(1.0))
            .when((na == 0) | (nr == 0) | (common == 0), F.lit(0.0))
            .otherwise(f1))


def token_f1(answer, reference) -> Column:
    """Token-set F1 of two texts.

    For large inputs select ``token_set`` of each side into columns first and
    call ``token_f1_from_sets``: the sets are then computed once per row.
    """
    return token_f1_from_sets(token_set(answer), token_set(reference))


def _spaces(text, keep_newline: bool = False) -> Column:
    """Every Python whitespace character mapped to a plain space (``translate``
    is a per-character table lookup, far cheaper than a Unicode class)."""
    chars = PY_WHITESPACE.replace("\n", "") if keep_newline else PY_WHITESPACE
    return F.translate(_col(text), chars, " " * len(chars))


def word_count(text) -> Column:
    """Number of words as ``len(text.split())`` counts them."""
    t = F.trim(_spaces(text))
    return F.when(t == F.lit(""), F.lit(0)).otherwise(F.size(F.split(t, " +")))


def _ws(rule: str, no_nl: bool = False) -> str:
    return rule.replace(r"\s", f"[{WS_CLASS_NO_NL if no_nl else WS_CLASS}]")


def starts_with_heading(text) -> Column:
    """The stripped text starts with 1-6 ``#`` and whitespace."""
    return py_strip(text).rlike(_ws(HEADING_RULE))


def _count_line_rule(text, rule: str) -> Column:
    # Lines of the stripped text matching the rule. Whitespace other than \n
    # becomes a space first, so \n is the only line terminator left and
    # ``(?m)^`` marks exactly the line starts of ``split("\n")``; `` `` inside a
    # line cannot cross into the next one.
    pattern = "(?m)(?U)" + rule.replace(r"\s", " ")
    return F.regexp_count(_spaces(py_strip(text), keep_newline=True), F.lit(pattern))


def bullet_items(text) -> Column:
    """Number of bullet lines."""
    return _count_line_rule(text, BULLET_RULE)


def numbered_items(text) -> Column:
    """Number of numbered lines (Unicode digits, as Python's ``\\d``)."""
    return _count_line_rule(text, NUMBERED_RULE)


def toxic_hits(text) -> Column:
    """First match of each toxic pattern, in pattern order, empties dropped."""
    t = _col(text)
    found = F.array(*[F.regexp_extract(t, "(?iu)" + _ws(p), 0) for p in TOXIC_PATTERNS])
    return F.filter(found, lambda x: x != F.lit(""))


def context_bullets(context) -> Column:
    """``- chunk`` lines."""
    return F.array_join(F.transform(_col(context), lambda c: F.concat(F.lit("- "), c)), "\n")


def context_numbered(context) -> Column:
    """``  [i] chunk`` lines, 1-based."""
    return F.array_join(
        F.transform(_col(context),
                    lambda c, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), c)),
        "\n")


def clamp01(x) -> Column:
    """``max(0.0, min(1.0, x))``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(x)))


def preview(text, n: int = 100) -> Column:
    """first ``n`` characters plus ``...`` when longer."""
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def failure_message(score, threshold: float) -> Column:
    """``Score 0.xxxx < threshold t``."""
    return F.format_string(f"Score %.4f < threshold {threshold}", _col(score))


def direction(delta, band: float = 0.001) -> Column:
    """X18 per metric: up / down / same with a dead band."""
    d = _col(delta)
    return F.when(d > band, F.lit("up")).when(d < -band, F.lit("down")).otherwise(F.lit("same"))


def verdict(delta) -> Column:
    """X18 overall: better / worse / no difference."""
    d = _col(delta)
    return (F.when(d > 0, F.lit("better")).when(d < 0, F.lit("worse"))
            .otherwise(F.lit("no difference")))


def short_ts(ts) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` or ``?``."""
    return F.coalesce(F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss"), F.lit("?"))
