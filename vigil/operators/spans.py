"""Statement extents of JavaScript / TypeScript files, without a parser and without a shuffle.

One pass of a single alternation cuts a file into *units*: the code up to a
mark, and the mark (a comment, a string, a template, a bracket, a comma). What
stands inside a comment, string or template is therefore never code, over
however many lines it runs. Brackets raise and lower the depth, a running sum
over the file's marks. Sorted by depth, then place, a bracket stands next to the
commas of its own depth and the bracket that closes it, so one flat pattern over
that sequence yields every call with its arguments, however long or nested.

A call's callee is the code in front of its bracket. Where that begins with a
dot (``f().x(``, ``a[0]`` newline ``.x(``) the expression goes on from the group
before it at the same depth, whose start is carried forward.

All of it is array expressions over one row, linear in the file's length but
for the sort; the file's text does not leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_max, running_sum

_ANY = r"(?s:.)"
#: Comments, strings, templates, regular expressions (with the mark in front of them), brackets and commas.
#: ``*+`` never gives back, which changes no match here and keeps long ones off the stack.
MARKS = "|".join([
    r"//[^\n]*", rf"/\*{_ANY}*?\*/",
    rf"'[^'\\\n]*+(?:\\{_ANY}[^'\\\n]*+)*+'", rf'"[^"\\\n]*+(?:\\{_ANY}[^"\\\n]*+)*+"',
    rf"`[^`\\]*+(?:\\{_ANY}[^`\\]*+)*+`",
    r"[(,=:\[!&|?;][ \t]*/(?:[^/*\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])*+/",
    r"[()\[\]{},]",
])
#: The name or member chain that ends a piece of code, with type arguments after it.
CHAIN = r"((?:new\s+)?[\w$]+(?:\s*!?\s*\.\s*[\w$]+)*+)\s*(?:<[^<>()]*>)?\s*$"
#: The attribute that ends a piece of code, before a brace.
ATTRIBUTE = r"([\w$]+)\s*=\s*$"
#: Strings and templates keep their quotes only.
STRINGS = (rf"""(')[^'\\\n]*+(?:\\{_ANY}[^'\\\n]*+)*+'|(")[^"\\\n]*+(?:\\{_ANY}[^"\\\n]*+)*+"|(`)[^`\\]*+(?:\\{_ANY}[^`\\]*+)*+`""")
COMMENTS = (rf"""('[^'\\\n]*+(?:\\{_ANY}[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\{_ANY}[^"\\\n]*+)*+"|`[^`\\]*+(?:\\{_ANY}[^`\\]*+)*+`)"""
            rf"|//[^\n]*|/\*{_ANY}*?\*/")
#: How often innermost parentheses are emptied in an argument's shape.
NESTING = 4


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def without_comments(arg: Column) -> Column:
    return trimmed(F.regexp_replace(arg, COMMENTS, "$1"))


def shape(arg: Column) -> Column:
    """An argument with emptied strings, templates and parentheses."""
    out = F.regexp_replace(arg, STRINGS, "$1$1$2$2$3$3")
    for _ in range(NESTING):
        out = F.regexp_replace(out, r"\([^()]+\)", "()")
    return out


def parts(arg_shape: Column) -> Column:
    """The shapes between the commas of its own depth."""
    flat = F.regexp_replace(F.regexp_replace(arg_shape, r"\{[^{}]*\}", "{}"), r"\[[^\[\]]*,[^\[\]]*\]", "[]")
    return F.transform(F.split(flat, ","), trimmed)


def _newlines(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("long")


def with_units(df: DataFrame, content: str = "content") -> DataFrame:
    """Column ``#units``: the code before each mark (g), the mark (t), its first character (k), where g begins (at), and the
    lines (nl) and the line start (ls) there; a last unit holds the code after the last mark. Arrays that a lambda looks
    into are bound by ``let``: a column named once in a lambda would be inlined there, and computed for each element."""
    none = F.lit("")
    mark = lambda toks, i: F.coalesce(F.get(toks, i), none)
    raw = let(F.col("#toks"), lambda toks: F.transform(F.split(content, MARKS, -1), lambda g, i: F.struct(
        g.alias("g"), mark(toks, i).alias("t"), F.substring(mark(toks, i), 1, 1).alias("k"), F.concat(g, mark(toks, i)).alias("u"))))
    starts = let(F.col("#ends"), lambda ends: F.transform("#raw", lambda x, i: F.when(
        F.contains(x["u"], F.lit("\n")), F.get(ends, i) - F.length(F.substring_index(x["u"], "\n", -1)))))
    units = let(F.col("#ends"), lambda ends: let(F.col("#nl"), lambda nl: let(F.col("#starts"), lambda begun: F.transform(
        "#raw", lambda x, i: F.struct(
            x["g"].alias("g"), x["t"].alias("t"), x["k"].alias("k"), (F.get(ends, i) - F.length(x["u"])).alias("at"),
            (F.get(nl, i) - _newlines(x["u"])).alias("nl"), F.coalesce(F.get(begun, i - 1), F.lit(0).cast("long")).alias("ls"))))))
    return (
        df.withColumn("#toks", F.regexp_extract_all(content, F.lit(MARKS), F.lit(0))).withColumn("#raw", raw)
        .withColumn("#ends", running_sum(F.transform("#raw", lambda x: F.length(x["u"]).cast("long"))))
        .withColumn("#nl", running_sum(F.transform("#raw", lambda x: _newlines(x["u"]))))
        .withColumn("#starts", running_max(starts, F.lit(0).cast("long")))
        .withColumn("#units", units).drop("#toks", "#raw", "#ends", "#nl", "#starts"))


def _place(unit: Column, chars: Column, before: Column) -> Column:
    """(at, line, column) of the point ``chars`` into a unit; ``before``: the text up to it."""
    at = unit["at"] + chars
    line_start = F.when(F.contains(before, F.lit("\n")), at - F.length(F.substring_index(before, "\n", -1))).otherwise(unit["ls"])
    return F.struct(at.alias("at"), (unit["nl"] + _newlines(before) + 1).cast("int").alias("line"), (at - line_start).cast("int").alias("column"))


HEAD = "struct<depth:long,at:long,line:int,column:int>"


def _at(depth: Column, unit: Column, before: Column) -> Column:
    place = _place(unit, F.length(before), before)
    return F.struct(depth.cast("long").alias("depth"), *(place[c].alias(c) for c in ("at", "line", "column"))).cast(HEAD)


def _callee(u: Column, group: int) -> Column:
    """What stands before a unit's bracket: a chain, or before a brace an attribute."""
    return F.when(u["k"] == "{", F.regexp_extract(u["g"], ATTRIBUTE, group)).otherwise(F.regexp_extract(u["g"], CHAIN, group))


def _before(u: Column) -> Column:
    """The code before that."""
    return F.left(u["g"], F.length(u["g"]) - F.length(_callee(u, 0)))


def with_calls(df: DataFrame, callee: str) -> DataFrame:
    """Column ``#calls``, to a frame with units: every bracket whose code in front matches ``callee``, as callee (without
    blanks; a leading dot where it goes on from another group, ``?.`` where optionally), how it is opened, prefix (code
    before the callee), args (trimmed, without comments), after (code and mark that follow), line and column where the
    expression begins."""
    def mark(units: Column, depth: Column, u: Column, i: Column) -> Column:
        """By the depth inside, then place. own: where the code right before an opening bracket begins; head: where its
        expression begins, null if it goes on from another group."""
        opens, closes = u["k"].isin("(", "[", "{"), u["k"].isin(")", "]", "}")
        inside = F.get(depth, i) + F.when(closes, 1).otherwise(0)
        kind = F.when(opens, F.when(u["g"].rlike(callee), F.lit("C")).otherwise(F.lit("O"))).otherwise(u["k"])

        def with_prefix(p: Column) -> Column:
            own, before = _at(inside, u, p), F.get(units, i - 1)
            head = (F.when(~p.rlike(r"\.\s*$"), own)
                    .when(before["k"] == "/", F.when(_callee(before, 1) != "", _at(inside, before, _before(before))))  # a comment in the chain
                    .when(~before["k"].isin(")", "]", "}"), _at(inside, before, before["g"])))
            return F.struct(inside.alias("depth"), i.alias("i"), kind.alias("kind"),
                            F.when(opens, own).alias("own"), F.when(opens, head).alias("head"))

        return F.when(opens | closes | (u["k"] == ","), let(F.when(opens, _before(u)).otherwise(F.lit("")), with_prefix))

    def said(heads: Column, x: Column, i: Column) -> Column:
        head = F.when(F.get(heads, i)["depth"] == x["depth"], F.get(heads, i)).otherwise(x["own"])
        where = F.concat(F.lit("@"), head["line"].cast("string"), F.lit(":"), head["column"].cast("string"))
        return F.concat(x["kind"], x["i"].cast("string"), F.when(x["kind"] == "C", where).otherwise(F.lit("")))

    def one(units: Column, g: Column, at: Column) -> Column:
        first, after = F.get(units, F.element_at(at, 1)), F.get(units, F.element_at(at, -1) + 1)
        text = lambda a, b: F.concat(F.array_join(F.transform(
            F.slice(units, a + 2, b - a - 1), lambda u: F.concat(u["g"], u["t"])), ""), F.get(units, b)["g"])
        args = F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda a, j: without_comments(text(a, F.get(at, j + 1))))
        kept = let(args, lambda v: F.when(F.element_at(v, -1) == "", F.slice(v, F.lit(1), F.size(v) - 1)).otherwise(v))  # none, or a trailing comma
        chain = _callee(first, 1)
        name = F.concat(F.when(chain.rlike(r"^new\s"), F.lit("new ")).otherwise(F.lit("")),
                        F.regexp_replace(F.regexp_replace(chain, r"^new\s+", ""), r"[\s!]", ""))
        goes_on = lambda p: F.when(p.rlike(r"\?\.\s*$"), F.lit("?.")).when(p.rlike(r"\.\s*$"), F.lit(".")).otherwise(F.lit(""))
        return F.struct(
            F.concat(goes_on(_before(first)), name).alias("callee"), first["k"].alias("opened"), _before(first).alias("prefix"),
            kept.alias("args"), F.concat(after["g"], after["k"]).alias("after"),
            F.regexp_extract(g, "@([0-9]+)", 1).cast("int").alias("line"), F.regexp_extract(g, ":([0-9]+)", 1).cast("int").alias("column"))

    step = F.transform("#units", lambda u: F.when(u["k"].isin("(", "[", "{"), 1).when(u["k"].isin(")", "]", "}"), -1).otherwise(0).cast("long"))
    marks = let(F.col("#units"), lambda units: let(F.col("#depth"), lambda depth: F.array_sort(F.filter(
        F.transform(units, lambda u, i: mark(units, depth, u, i)), lambda x: x.isNotNull()))))
    text = let(F.col("#heads"), lambda heads: F.array_join(F.transform("#marks", lambda x, i: said(heads, x, i)), ""))
    found = let(F.col("#units"), lambda units: F.transform("#groups", lambda g: let(F.transform(
        F.split(F.regexp_replace(g, "@[0-9]+:[0-9]+", ""), r"[,)\]}]"), lambda x: x.cast("int")), lambda at: one(units, g, at))))
    return (
        df.withColumn("#depth", running_sum(step)).withColumn("#marks", marks)
        .withColumn("#heads", running_max(F.transform("#marks", lambda x: x["head"]), F.lit(None).cast(HEAD)))
        .withColumn("#groups", F.regexp_extract_all(text, F.lit(r"C([0-9]+@[0-9]+:[0-9]+(?:,[0-9]+)*[)\]}][0-9]+)"), F.lit(1)))
        .withColumn("#calls", found)
        .drop("#depth", "#marks", "#heads", "#groups"))


def with_strings(df: DataFrame, name: str) -> DataFrame:
    """Column ``#strings``, to a frame with units: every string literal whose code in front matches ``name``, as that
    pattern's group (name), the code before it (prefix) and the mark before that, the value, the code after, and line and
    column of the name."""
    def one(units: Column, u: Column, i: Column) -> Column:
        whole, own = F.regexp_extract(u["g"], name, 0), F.regexp_extract(u["g"], name, 1)
        prefix = F.left(u["g"], F.length(u["g"]) - F.length(whole) + F.instr(whole, own) - 1)
        return let(prefix, lambda p: F.struct(
            own.alias("name"), p.alias("prefix"), F.coalesce(F.get(units, i - 1)["k"], F.lit("")).alias("before"),
            F.substring(u["t"], F.lit(2), F.length(u["t"]) - 2).alias("value"), F.coalesce(F.get(units, i + 1)["g"], F.lit("")).alias("after"),
            _place(u, F.length(p), p)["line"].alias("line"), _place(u, F.length(p), p)["column"].alias("column")))

    return df.withColumn("#strings", let(F.col("#units"), lambda units: F.filter(F.transform(
        units, lambda u, i: F.when(u["k"].isin("'", '"') & u["g"].rlike(name), one(units, u, i))), lambda x: x.isNotNull())))
