"""JSON validity exactly as Python's ``json.loads`` decides it.

No Spark built-in agrees with ``json.loads`` (``try_parse_json`` accepts
trailing text and rejects NaN), so this one check is an Arrow-batched pandas
UDF. Callers pass null for rows that do not ask for JSON, which keeps the
Python side to the rows that need it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RESULT = T.StructType([T.StructField("valid", T.BooleanType()),
                       T.StructField("detail", T.StringType())])


@F.pandas_udf(_RESULT)
def _json_check(texts: pd.Series) -> pd.DataFrame:
    valid, detail = [], []
    for t in texts:
        if t is None:
            valid.append(None)
            detail.append(None)
            continue
        try:
            json.loads(t)
            valid.append(True)
            detail.append("Valid JSON")
        except json.JSONDecodeError as exc:
            valid.append(False)
            detail.append(f"Invalid JSON: {exc}")
        except (ValueError, RecursionError) as exc:  # a number too long, nesting too deep
            valid.append(False)
            detail.append(f"Invalid JSON: {type(exc).__name__}")
    return pd.DataFrame({"valid": valid, "detail": detail})


# JSON whitespace, the characters a JSON value may start with
# in Python's decoder (object, array, string, number, true, false, null,
# NaN, Infinity), and the decoder's message for anything else.
JSON_WS = " \t\n\r"
VALUE_START = r"[\{\[\"\-0-9tfnNI]"
BOM = "\ufeff"
EXPECTING_VALUE = "Invalid JSON: Expecting value: line %d column %d (char %d)"


def json_check(text: Column) -> Column:
    """Struct ``(valid, detail)``; null in, null out.

    Only texts whose first non-whitespace character can start a JSON value
    (or that start with a BOM) go to Python. For every other text
    ``json.loads`` fails at that character with "Expecting value"; the
    message (line, column, char offset) is computed on the JVM.
    """
    ws_len = F.length(text) - F.length(F.ltrim(text, F.lit(JSON_WS)))
    first = F.substring(text, ws_len + 1, 1)
    plausible = first.rlike(VALUE_START) | F.startswith(text, F.lit(BOM))
    prefix = F.substring(text, 1, ws_len)
    newlines = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit("")))
    # 1-based position of the last newline in the prefix, 0 if none.
    last_nl = F.when(newlines == 0, F.lit(0)).otherwise(
        ws_len - F.locate("\n", F.reverse(prefix)) + 1)
    colno = ws_len - last_nl + 1
    failed = F.struct(F.lit(False).alias("valid"),
                      F.format_string(EXPECTING_VALUE, newlines + 1, colno, ws_len).alias("detail"))
    checked = _json_check(F.when(plausible, text))
    return F.when(text.isNull(), F.lit(None).cast(_RESULT)) \
        .when(plausible, checked).otherwise(failed)
