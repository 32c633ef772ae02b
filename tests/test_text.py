from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ragscope.functions import text as X

# text, words, heading, bullets, numbered, toxic hits, tokens: worked by hand
EXPECTED = [
    ('hello world', 2, False, 0, 0, [], ['hello', 'world']),
    ('Hello, world!', 2, False, 0, 0, [], ['hello', 'world']),
    ('STRASSE İstanbul', 2, False, 0, 0, [], ['i', 'stanbul', 'strasse']),
    ('5Kx', 1, False, 0, 0, [], ['5kx']),
    ('ſt', 1, False, 0, 0, [], ['t']),
    ('é9', 1, False, 0, 0, [], ['9']),
    ('a\xa0b\u3000c\x1cd\x85e', 5, False, 0, 0, [], ['a', 'b', 'c', 'd', 'e']),
    ('  # Title\nbody', 3, True, 0, 0, [], ['body', 'title']),
    ('#NoSpace', 1, False, 0, 0, [], ['nospace']),
    ('####### seven', 2, False, 0, 0, [], ['seven']),
    ('- a\n- b\n* c', 6, False, 3, 0, [], ['a', 'b', 'c']),
    ('- only one', 3, False, 1, 0, [], ['one', 'only']),
    ('1. a\n2) b\n3 c', 6, False, 0, 2, [], ['1', '2', '3', 'a', 'b', 'c']),
    ('١. x\n٢) y', 4, False, 0, 2, [], ['x', 'y']),
    ('You idiot, go hurt yourself', 5, False, 0, 0, ['idiot', 'hurt yourself'], ['go', 'hurt', 'idiot', 'you', 'yourself']),
    ('éidiot', 1, False, 0, 0, [], ['idiot']),
    ('idiot_x', 1, False, 0, 0, [], ['idiot', 'x']),
    ('stupidly', 1, False, 0, 0, [], ['stupidly']),
    ('I HATE ALL of this', 5, False, 0, 0, ['HATE ALL'], ['all', 'hate', 'i', 'of', 'this']),
    ('kill\xa0them', 2, False, 0, 0, ['kill\xa0them'], ['kill', 'them']),
    ('', 0, False, 0, 0, [], []),
    ('   ', 0, False, 0, 0, [], []),
    ('\n- a\n- \n', 3, False, 1, 0, [], ['a']),
    ('- a\n-\n- b', 5, False, 2, 0, [], ['a', 'b']),
]


def _one(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_token_f1_cases(spark):
    cases = [("hello world", "hello world", 1.0), ("foo bar", "baz qux", 0.0),
             ("the cat sat", "the dog sat", 2 / 3), ("", "", 1.0), ("", "some text", 0.0),
             ("some text", "", 0.0), ("Hello WORLD", "hello world", 1.0),
             ("Hello, world!", "hello world", 1.0)]
    df = spark.createDataFrame([(a, r) for a, r, _ in cases], "a string, r string")
    got = [row[0] for row in df.select(X.token_f1("a", "r")).collect()]
    for (a, r, want), g in zip(cases, got):
        assert g == pytest.approx(want), (a, r)


def test_worked_strings(spark):
    texts = [r[0] for r in EXPECTED]
    got = zip(*[_one(spark, texts, e) for e in (
        X.word_count("t"), X.starts_with_heading("t"), X.bullet_items("t"), X.numbered_items("t"), X.toxic_hits("t"),
        X.token_set("t"))])
    for row, (words, heading, bullets, numbered, hits, tokens) in zip(EXPECTED, got):
        assert (words, heading, bullets, numbered, hits, sorted(tokens)) == row[1:], row[0]


ALPHABET = "ab1 \n\t-*+#.)é\u00a0\u3000\x1c\x85İK9"
DIGITS_AND_LETTERS = set("abcdefghijklmnopqrstuvwxyz0123456789")


def _list_marker(line, after_number):
    """Whether a line opens with a list marker and white space after it."""
    line = line.lstrip()
    if after_number:
        rest = line.lstrip("".join(c for c in set(line) if c.isdecimal()))
        return rest != line and rest[:1] in (".", ")") and rest[1:2].isspace()
    return line[:1] in ("-", "*", "+") and line[1:2].isspace()


def _counted(text):
    """Tokens as a counter: every other character is a blank."""
    return Counter("".join(c if c in DIGITS_AND_LETTERS else " " for c in text.lower()).split()).keys()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(ALPHABET, max_size=40), st.text(ALPHABET, max_size=20)), min_size=20, max_size=60))
def test_random_strings(spark, pairs):
    df = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(pairs)], "i long, t string, r string")
    rows = df.orderBy("i").select(X.word_count("t"), X.token_f1("t", "r"), X.bullet_items("t"),
                                  X.numbered_items("t")).collect()
    for (t, r), row in zip(pairs, rows):
        a, b = _counted(t), _counted(r)
        f1 = 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
        lines = t.strip().split("\n")
        assert row[0] == len(t.split()), repr(t)
        assert row[1] == pytest.approx(f1), (t, r)
        # a last line that is a bare marker has lost its white space
        assert row[2] == sum(_list_marker(x, False) for x in lines), repr(t)
        assert row[3] == sum(_list_marker(x, True) for x in lines), repr(t)


def test_context_join(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "c array<string>")
    rows = df.select(X.context_bullets("c"), X.context_numbered("c")).collect()
    assert rows[0][0] == "- a\n- b"
    assert rows[0][1] == "  [1] a\n  [2] b"
    assert rows[1][0] == "" and rows[1][1] == ""


def test_preview_and_clamp(spark):
    df = spark.createDataFrame([("x" * 150, 1.5), ("short", -0.2)], "t string, s double")
    rows = df.select(X.preview("t"), X.clamp01("s")).collect()
    assert rows[0][0] == "x" * 100 + "..." and rows[0][1] == 1.0
    assert rows[1][0] == "short" and rows[1][1] == 0.0


JSON_PROBES = ["NaN", '{"a":1,"a":2}', '{"a":1} x', "1 2", "[1,]", "{'a': 1}", "", "  ",
               "\n\n  Hello", "plain prose", '  {"score": 0.5}', "true", "-1.5e3", "﻿{}",
               "Infinity", "\r\n\tx", "[", '"str"']


def test_json_check_matches_python(spark):
    import json
    from ragscope.functions.jsoncheck import json_check

    def py(t):
        try:
            json.loads(t)
            return True, "Valid JSON"
        except json.JSONDecodeError as exc:
            return False, f"Invalid JSON: {exc}"

    rows = _one(spark, JSON_PROBES, json_check(F.col("t")))
    for t, r in zip(JSON_PROBES, rows):
        assert (r["valid"], r["detail"]) == py(t), repr(t)
