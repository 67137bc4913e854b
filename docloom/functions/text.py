"""White space and regular expressions with one meaning in all engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as white space (the ECMAScript set), as the inside of a class.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+", "")


def trim(c: Column) -> Column:
    return F.regexp_replace(trim_start(c), f"[{SPACE}]+$", "")


def tail(c: Column, n: int) -> Column:
    """The last n characters, null if there are none (n = 0: no context)."""
    return F.nullif(F.right(c, F.lit(n)), F.lit("")) if n else F.lit(None).cast("string")
