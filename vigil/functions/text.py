"""String helpers that mirror JavaScript string semantics with built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x) -> Column:
    """JavaScript ``trim()``: strips all whitespace, not just U+0020."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def json_object(content, schema) -> Column:
    """``from_json`` of a text that is a whole JSON object; null for a broken one, of which
    ``from_json`` alone keeps what it could read."""
    return F.when(F.json_object_keys(_c(content)).isNotNull(), F.from_json(_c(content), schema))


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dirname(path) -> Column:
    return F.regexp_replace(_c(path), r"/[^/]*$", "")


def file_tail2(path) -> Column:
    """Last two path parts, joined by '/'."""
    parts = F.split(_c(path), "/")
    n = F.size(parts)
    return F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), "/")


def truncate_ellipsis(x, n: int) -> Column:
    s = _c(x)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def snippet_trim120(line) -> Column:
    return F.substring(js_trim(line), 1, 120)


def contains_ci(haystack, needle: str) -> Column:
    return F.contains(F.lower(_c(haystack)), F.lit(needle.lower()))
