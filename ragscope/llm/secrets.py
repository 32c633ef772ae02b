"""Secrets in texts, and multipart credentials linked by an interval join.

Base spans are strong on their own: key assignments, access key ids, long hex
runs. Weak parts are not: account names, endpoints and token-like strings are
everywhere. They are reported only where complementary parts lie close: an
identifier with a secret, a secret with an identifier, an endpoint with both.
Parts are joined by intervals within a document: each part stands in every
cell of ``reach`` code points that it covers and looks into those around it; a
cell holds, for each role, how far its parts extend there, so a text full of
parts costs no pair of parts, and long parts are found from either end.

Positions are code points, ends exclusive. Null text is the empty text and has
no spans. Rows are told apart by position in the table, so repeated or null
doc_ids do not mix. All of it is built-in expressions; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscope.llm.common import documents, materialize

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak parts: kind, role, pattern, what a match must contain.
WEAK = [
    ("account", "identifier",
     r"""(?i:client_?id|access_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", None),
    ("short_key", "identifier", r"(?:AKIA|ASIA|AIza)[A-Za-z0-9_-]{4,}", None),
    ("blob", "secret", r"[A-Za-z0-9+/_=-]{16,}", r"(?=.*[0-9])(?=.*[A-Za-z])"),
    ("endpoint", "endpoint", r"""[a-z][a-z0-9+]{1,9}://[^\x20\t\r\n"'<>]+""", None),
    ("host", "endpoint", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?", None),
]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: r for k, r, _, _ in WEAK}
RANK = {k: i for i, k in enumerate(ROLE)}
REACH = 240


SPAN = "struct<start:int,rank:int,end:int,kind:string>"
#: How many elements of an array an inner fold appends to its own short list.
BLOCK = 256


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks(items: Column) -> Column:
    """An array as an array of arrays of at most ``BLOCK`` elements."""
    return let(items, lambda a: F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / BLOCK).cast("int")),
                                            lambda i: F.slice(a, i * BLOCK + 1, BLOCK)))


def scan(items: Column, state: Column, emits: str, step) -> Column:
    """What ``step`` emits over ``items`` from left to right, as one array.

    ``step(state, x)`` gives the next state and an array of ``emits``. An append
    copies a block at most, and blocks are put together once, so the work grows
    with the number of items and not with its square.
    """
    def one(acc: Column, x: Column) -> Column:
        after, emitted = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], emitted).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{emits}>").alias("out"))
        return let(F.aggregate(part, start, one),
                   lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{emits}>>").alias("out"))
    return F.flatten(F.aggregate(blocks(items), start, block, lambda acc: acc["out"]))


def matches(text: Column, pattern: str, kind: str, keep=None, group: int = 0) -> Column:
    """The spans of a pattern: array of (start, rank, end, kind), leftmost first.

    Splitting by the pattern gives what lies between the matches; the running
    sum of both lengths gives the places. ``keep`` tests the text of ``group``.
    """
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(pos: Column, x: Column):
        begin = pos + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(RANK[kind]).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        good = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["value"])
        return F.coalesce(end, begin), F.when(good, F.array(span)).otherwise(empty)

    return F.when(F.regexp_like(text, p), scan(parts, F.lit(0), SPAN, step)).otherwise(empty)


def separate_parts(spans: Column) -> Column:
    """The spans that count as parts: one string is never two parts.

    In order of start (the longer first, then as the kinds are listed), a span
    that overlaps a counted one of another role goes. Base spans go only for
    base spans.
    """
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(
        a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["rank"] - b["rank"]))
    roles = ("identifier", "secret", "endpoint")
    fields = [(r, w) for r in roles for w in ("base", "any")]
    state = F.struct(*[F.lit(0).alias(f"{r}_{w}") for r, w in fields])
    of = lambda x, r: x["kind"].isin(*[k for k, v in ROLE.items() if v == r])
    is_base = lambda x: x["rank"] < RANK[WEAK[0][0]]

    def step(ends: Column, x: Column):
        hidden = F.lit(False)
        for r in roles:
            reach = F.when(is_base(x), ends[f"{r}_base"]).otherwise(ends[f"{r}_any"])
            hidden = hidden | (~of(x, r) & (reach > x["start"]))
        after = F.struct(*[F.when(~hidden & of(x, r) & (is_base(x) if w == "base" else F.lit(True)),
                                  F.greatest(ends[f"{r}_{w}"], x["end"])).otherwise(ends[f"{r}_{w}"]).alias(f"{r}_{w}")
                           for r, w in fields])
        return after, F.when(hidden, F.array().cast(f"array<{SPAN}>")).otherwise(F.array(x))

    return scan(ordered, state, SPAN, step)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def find_spans(docs: DataFrame, *more: Column) -> DataFrame:
    """row, doc_id, assign, access, hex and weak: the spans of every whole text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *more,
                       matches(text, ASSIGN, "assign", lambda v: F.length(v) >= 6, 2).alias("assign"),
                       matches(text, ACCESS, "access").alias("access"), matches(text, HEX, "hex").alias("hex"),
                       F.concat(*[matches(text, p, k, None if has is None else (lambda v, has=has: F.regexp_like(v, F.lit(has))))
                                  for k, _, p, has in WEAK]).alias("weak"))
    return materialize(base, "spans")


def link_parts(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, linked): the weak spans with complementary parts within ``reach``."""
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col("s.kind"))
    parts = (found.where(F.size("weak") > 0)
             .select("row", F.explode(separate_parts(F.concat("assign", "access", "hex", "weak"))).alias("s"))
             .select("row", "s", role.alias("role"), (F.col("s.rank") >= RANK[WEAK[0][0]]).alias("is_weak")))
    cell = lambda at: F.floor(at / reach)
    covered = parts.select("row", "role", "s", F.explode(F.sequence(cell(F.col("s.start")), cell(F.col("s.end") - 1))).alias("cell"))
    cells = covered.groupBy("row", "cell", "role").agg(
        F.min(F.greatest(F.col("s.start"), F.col("cell") * reach)).alias("lo"),
        F.max(F.least(F.col("s.end"), (F.col("cell") + 1) * reach)).alias("hi"))
    around = F.sequence(cell(F.col("s.start") - reach), cell(F.col("s.end") + reach))
    ask = parts.where("is_weak").select("row", "s", "role", F.explode(around).alias("cell"))
    near = ask.alias("p").join(cells.alias("c"), F.expr(
        f"p.row = c.row AND p.cell = c.cell AND p.role <> c.role AND c.lo <= p.s.end + {reach} AND c.hi + {reach} >= p.s.start"))
    seen = near.groupBy("p.row", "p.s", "p.role").agg(F.collect_set("c.role").alias("others"))
    has = lambda r: F.array_contains("others", r)
    good = (F.when(F.col("role") == "identifier", has("secret")).when(F.col("role") == "secret", has("identifier"))
            .otherwise(has("secret") & has("identifier")))
    return seen.where(good).groupBy("row").agg(F.collect_list("s").alias("linked"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex, linked: all spans of every document."""
    found = find_spans(docs)
    linked = link_parts(found)
    return found.join(linked, "row", "left").select(
        "row", "doc_id", "assign", "access", "hex",
        F.coalesce("linked", F.array().cast(found.schema["weak"].dataType)).alias("linked"))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets and linked multipart credentials of every whole document."""
    base = F.concat("assign", "access", "hex")
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, "linked")).alias("spans"))


def mask(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``."""
    nothing = F.array().cast("array<string>")

    def block(acc: Column, part: Column) -> Column:
        # only this stretch of the text is cut again for each of its spans
        stop = F.array_max(F.transform(part, lambda s: s["end"]))
        stretch = F.substring(text, acc["pos"], F.greatest(stop + 1 - acc["pos"], F.lit(0)))

        def folded(near: Column) -> Column:
            def step(own: Column, s: Column) -> Column:
                new = F.when(s["start"] + 1 >= own["pos"], F.array(
                    F.substring(near, own["pos"] - acc["pos"] + 1, s["start"] + 1 - own["pos"]), F.lit(mark))).otherwise(nothing)
                return F.struct(F.greatest(own["pos"], s["end"] + 1).alias("pos"), F.concat(own["out"], new).alias("out"))

            return F.aggregate(part, F.struct(acc["pos"].alias("pos"), nothing.alias("out")), step)

        return let(let(stretch, folded), lambda r: F.struct(
            r["pos"].alias("pos"), F.concat(acc["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

    return F.aggregate(blocks(F.array_sort(spans)), F.struct(F.lit(1).alias("pos"), nothing.alias("out")), block,
                       lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"], F.length(text))))


def mask_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with all spans masked, and n_chars as the masked text has it."""
    found = find_spans(docs, F.xxhash64("text").alias("text_hash"))
    spans = found.join(link_parts(found), "row", "left").select(
        "doc_id", "text_hash", F.concat("assign", "access", "hex", F.coalesce("linked", F.array().cast(
            found.schema["weak"].dataType))).alias("spans")).where(F.size("spans") > 0)
    # equal rows have equal spans
    spans = spans.groupBy("doc_id", "text_hash").agg(F.any_value("spans").alias("spans")).alias("s")
    out = docs.alias("d").join(spans, F.expr("d.doc_id <=> s.doc_id AND xxhash64(d.text) = s.text_hash"), "left")
    none = F.col("s.spans").isNull()
    text = F.when(none, F.col("d.text")).otherwise(mask(F.col("d.text"), F.col("s.spans"), mark))
    count = F.when(none, F.col("d.n_chars")).otherwise(F.length(text)).cast("long") if "n_chars" in docs.columns else None
    return out.select(*[text.alias(c) if c == "text" else count.alias(c) if c == "n_chars" else F.col(f"d.`{c}`").alias(c)
                        for c in docs.columns])
