"""Secret value helpers: Shannon entropy, masking, placeholder test."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results:
# lower-cased markers that make a matched value a placeholder.
PLACEHOLDER_MARKERS = [
    "xxx", "yyy", "zzz", "placeholder", "changeme", "your-", "your_",
    "example", "sample", "<", ">", "${", "#{", "insert", "replace",
    "todo", "fixme", "test-", "-test", "_test", "fake", "dummy",
    "abc123", "12345", "password", "secret123", "qwerty", "localhost",
]

PLACEHOLDER_RE = "|".join(re.escape(m) for m in PLACEHOLDER_MARKERS)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shannon_entropy(value) -> Column:
    """Bits per character over the distinct characters of ``value``.

    Runs as array higher-order functions inside one expression: no UDF,
    no explode, no shuffle. Empty / null values give 0.
    """
    v = _c(value)
    chars = F.split(v, "")
    n = F.length(v).cast("double")
    probs = F.transform(
        F.array_distinct(chars),
        lambda ch: F.size(F.filter(chars, lambda x: x == ch)).cast("double") / n,
    )
    h = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.coalesce(F.length(v), F.lit(0)) == 0, F.lit(0.0)).otherwise(h)


def mask_value(value) -> Column:
    """<= 8 chars -> ****; else first 4 + min(n-8, 20) stars + last 4."""
    v = _c(value)
    n = F.length(v)
    return F.when(n <= 8, F.lit("****")).otherwise(
        F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), F.least(n - 8, F.lit(20))),
                 F.substring(v, -4, 4)))


def is_placeholder(value) -> Column:
    """True when the lower-cased value contains any placeholder marker."""
    return F.lower(_c(value)).rlike(PLACEHOLDER_RE)
