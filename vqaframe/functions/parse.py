"""Parsing text values with Python's ``float()`` rules as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python float() grammar: optional sign, digits with single underscores
# between them, optional fraction and exponent; or nan / inf / infinity.
_DIGITS = r"[0-9](?:_?[0-9])*"
FLOAT_RE = (r"^[+-]?(?:(?:" + _DIGITS + r"(?:\.(?:" + _DIGITS + r")?)?|\." + _DIGITS + r")"
            r"(?:[eE][+-]?" + _DIGITS + r")?|(?i:nan|inf|infinity))$")
# str.strip() removes this whitespace set at both ends.
STRIP_RE = r"^[ \t\n\r\f\u000b]+|[ \t\n\r\f\u000b]+$"


def python_float(c) -> Column:
    """The double that ``float(line.strip())`` gives, or null where it raises.

    Spark's own cast accepts ``1.5d`` and rejects ``1_000``; Python does the
    reverse, so a regular expression guards the cast and underscores
    between digits are removed first.
    """
    col = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(col, STRIP_RE, "")
    ok = s.rlike(FLOAT_RE)
    # Spark's cast takes a signed inf but only an unsigned nan; the sign of
    # nan means nothing, so drop it
    body = F.regexp_replace(F.regexp_replace(s, "_", ""), "^[+-](?=(?i:nan)$)", "")
    return F.when(ok, body.try_cast("double"))
