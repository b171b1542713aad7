"""Line-level views of file content.

Everything here works on the per-file line array, so neighbouring-line
context (snippets, look-around frames) needs no shuffle and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim


def with_line_array(files: DataFrame) -> DataFrame:
    """Add ``lines``: content split on '\\n' only, trailing empties kept."""
    return files.withColumn("lines", F.split(F.col("content"), "\n", -1))


def lines_explode(files: DataFrame, keep=("project", "path"), with_array: bool = False) -> DataFrame:
    """One row per line: ``line`` numbered from 1, ``text`` the raw line.

    ``content`` is dropped here so that it never reaches a later shuffle.
    With ``with_array`` the whole line array is kept for context slicing.
    """
    arr = F.split(F.col("content"), "\n", -1)
    cols = [F.col(c) for c in keep]
    if with_array:
        cols.append(arr.alias("lines"))
    exploded = files.select(*cols, F.posexplode(arr).alias("pos", "text"))
    return exploded.select(*keep, *(["lines"] if with_array else []),
                           (F.col("pos") + 1).cast("int").alias("line"), "text")


def snippet_window(lines: Column, line: Column, context: int = 2) -> Column:
    """Lines ``line-context .. line+context`` joined by '\\n', clipped to the file."""
    start = F.greatest(line - context, F.lit(1))
    stop = F.least(line + context, F.size(lines))
    return F.array_join(F.slice(lines, start, stop - start + 1), "\n")


def is_comment_line(text: Column) -> Column:
    """Trimmed line starts with '//' or '#!' (a plain '#' is not a comment)."""
    t = js_trim(text)
    return t.startswith("//") | t.startswith("#!")


def match_column(text: Column, matched: Column) -> Column:
    """0-based index of the first occurrence of the matched text."""
    return F.instr(text, matched) - 1
