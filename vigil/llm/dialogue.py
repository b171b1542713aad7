"""Repair of conversation structure: the cheapest edits that make the roles ``(s?(ua)+)?``.

Edits are Delete, Insert (an empty user or assistant turn), Keep and Rerole (to
user or assistant). The edits of a conversation are a path through a graph whose
nodes are (rows consumed, what the roles so far allow next, turns inserted), and
a path has one integer as its weight: the high digits are its cost, the low ones
its audit, one octal digit for each letter (D 1, I 2, K 3, R 4, in ASCII order)
at a fixed place, with zeros after the last letter. So the least integer is the
cheapest path, and among equally cheap ones that with the ASCII-least audit: a
plain minimum of integers decides everything.

How many turns can be inserted is bounded without a loss (``insert_bound``). With
the default costs no cheapest path inserts any: dropping an inserted turn and its
partner, and a system turn that would stand alone, costs at most two deletions,
less than the insertion; one insertion is allowed for all the same.

One conversation may hold a third of all rows. Equal rows are counted first
(row and number of repeats); first occurrences come from a pre-aggregated minimum
and a join; rows are dealt by ranges of (conversation, turn, ...), so a long
conversation is spread over tasks, and each task folds its stretch into blocks:
matrices of least weights from every state to every state. Matrices multiply
associatively (weights are shifted to their new places), so blocks of a
conversation meet as a few numbers per letter, merged pairwise. Texts stay out of
all of that; they are sorted behind their conversation's audit and pass through
the digest as a stream, since a SHA-256 over one conversation is one sequence.

Defined results: rows are ordered by turn (nulls first), then role, then the
text's SHA-256. A null role or text counts as one space. A null conversation id
is a conversation of its own. Roles other than s..., u..., a... can't be kept.
Repeated rows are duplicates. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.llm.common import col, map_batches, staged

#: Fixed values of the task: what each edit costs.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = " DIKR"
D, I, K, R = 1, 2, 3, 4
#: What the roles so far allow: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, DONE = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": DONE}, DONE: {"u": USER}}
#: The role that an inserted or reroled turn gets in each state.
FILL = {START: "user", SYSTEM: "user", USER: "assistant", DONE: "user"}
ENDS = (START, DONE)
LEGAL = ("su", "ua", "au")
#: Rows that a task folds into one block.
BLOCK = 256
BLANK = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Costs:
    keep: int = KEEP
    rerole: int = REROLE
    delete: int = DELETE
    insert: int = INSERT
    truncated: int = TRUNCATED


def insert_bound(rows: int, costs: Costs) -> int:
    """No cheapest path inserts more turns. An insertion dearer than two deletions is never worth it (one is allowed
    still); else deleting all rows bounds the cost, and so the insertions."""
    return 1 if costs.insert > 2 * costs.delete else max(1, rows * costs.delete // max(costs.insert, 1))


class Row(NamedTuple):
    initial: str
    must_go: bool      # blank or a duplicate
    truncated: bool


class Matrix(NamedTuple):
    """Least weights from state to state over some rows: {(from, to, inserted): weight}, weights of ``width`` digits below the cost."""

    rows: int
    width: int
    weights: dict[tuple[int, int, int], int]


def fold(rows: list[Row], costs: Costs, most: int, starts: tuple[int, ...] = (START, SYSTEM, USER, DONE)) -> Matrix:
    """The least weights over ``rows`` from each of the starting states, with up to ``most`` insertions."""
    width = len(rows) + most
    weights: dict[tuple[int, int, int], int] = {}
    step = lambda cost, letter, place: (cost << 3 * width) + (letter << 3 * (width - 1 - place))
    for start in starts:
        at = {(start, 0): 0}
        for i in range(len(rows) + 1):
            for j in range(most):  # insertions before row i, fewer first
                edge = step(costs.insert, I, i + j)
                for state in NEXT:
                    if (state, j) in at:
                        to, w = (NEXT[state][FILL[state][0]], j + 1), at[state, j] + edge
                        if w < at.get(to, w + 1):
                            at[to] = w
            if i == len(rows):
                break
            row, after = rows[i], {}
            extra = costs.truncated if row.truncated else 0
            for (state, j), w in at.items():
                edges = [(state, step(costs.delete, D, i + j))]
                if not row.must_go:
                    if row.initial in NEXT[state]:
                        edges.append((NEXT[state][row.initial], step(costs.keep + extra, K, i + j)))
                    edges.append((NEXT[state][FILL[state][0]], step(costs.rerole + extra, R, i + j)))
                for to, edge in edges:
                    if w + edge < after.get((to, j), w + edge + 1):
                        after[to, j] = w + edge
            at = after
        weights |= {(start, state, j): w for (state, j), w in at.items()}
    return Matrix(len(rows), width, weights)


def deletions(n: int, costs: Costs) -> Matrix:
    """n rows that must go, without insertions among them where those can't be worth it."""
    w = (n * costs.delete << 3 * n) + ((1 << 3 * n) - 1) // 7 * D
    return Matrix(n, n, {(s, s, 0): w for s in NEXT})


def times(a: Matrix, b: Matrix, most: int) -> Matrix:
    """The rows of ``a``, then those of ``b``: letters of b move behind a's, padding goes to the end."""
    rows = a.rows + b.rows
    width = rows + most
    split = lambda m: [(f, t, j, w >> 3 * m.width, (w & ((1 << 3 * m.width) - 1)) >> 3 * (m.width - m.rows - j))
                       for (f, t, j), w in m.weights.items()]
    right: dict[int, list] = {}
    for f, *rest in split(b):
        right.setdefault(f, []).append(rest)
    out: dict[tuple[int, int, int], int] = {}
    for f, t, j, cost, digits in split(a):
        for to, dj, more, behind in right.get(t, ()):
            if j + dj <= most:
                w = (cost + more << 3 * width) + ((digits << 3 * (b.rows + dj) | behind) << 3 * (most - j - dj))
                if w < out.get((f, to, j + dj), w + 1):
                    out[f, to, j + dj] = w
    return Matrix(rows, width, out)


def best(m: Matrix) -> tuple[int, str]:
    """Cost and audit of the least weight from the start to an end."""
    w = min(w for (f, t, _), w in m.weights.items() if f == START and t in ENDS)
    return w >> 3 * m.width, audit_of(w & ((1 << 3 * m.width) - 1))


def audit_of(digits: int) -> str:
    return f"{digits:o}".rstrip("0").translate({ord("1"): "D", ord("2"): "I", ord("3"): "K", ord("4"): "R"})


class Merged:
    """Matrices in sequence, merged pairwise like the digits of a binary counter."""

    def __init__(self, most: int):
        self.most, self.stack = most, []

    def add(self, m: Matrix) -> None:
        level = 0
        while self.stack and self.stack[-1][0] == level:
            m = times(self.stack.pop()[1], m, self.most)
            level += 1
        self.stack.append((level, m))

    def all(self) -> Matrix:
        m = self.stack[-1][1]
        for _, before in reversed(self.stack[:-1]):
            m = times(before, m, self.most)
        return m


# --- Spark -----------------------------------------------------------------------------------------------------------

KEY = ["conv", "turn", "role", "sha"]


def _order(*before: str) -> list:
    """Turn with nulls first, role, text."""
    return [*map(F.col, before), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) of the rows, of which crc32 of ``conv:turn`` drops, empties, cuts, repeats or reroles some."""
    said = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")), F.lit(20))
    rows = df.select(hit.alias("hit"), col(conv).alias("conv"), col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("hit <> 0").withColumn("copy", F.explode(copies)).select(
        "conv", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation and turn as one, with their number."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.groupBy("conv", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(
        F.max("text").alias("text"), F.count(F.lit(1)).alias("copies")).select(
        "*", (~F.col("text").rlike(BLANK)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))


def with_faults(runs: DataFrame) -> DataFrame:
    """Without texts; ``seen``: role and text occur at an earlier turn."""
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))  # nulls first
    first = runs.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(F.min(place).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s"))
    return runs.drop("text").join(first, same).select(*KEY, "copies", "blank", "cut", (~F.col("first").eqNullSafe(place)).alias("seen"))


def _streamed(dealt: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``run`` turns groups (iterators over the rows of one conversation, sorted) into rows of ``schema``; nothing but
    the rows not yet sent is held."""
    to = to_arrow_schema(schema)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
        rows = (r for b in batches for r in b.to_pylist())
        ahead = [next(rows, None)]

        def own() -> Iterator[dict]:
            conv = ahead[0]["conv"]
            while ahead[0] is not None and ahead[0]["conv"] == conv:
                row, ahead[0] = ahead[0], None
                yield row
                ahead[0] = next(rows, None)

        while ahead[0] is not None:
            group = own()
            yield group
            for _ in group:
                pass

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in groups(batches):
            for row in run(group):
                held.append(row)
                size += 200 + sum(len(v) for v in row.values() if isinstance(v, str | bytes))
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=to)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=to)

    return map_batches(dealt, out, schema)


def _schema(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in columns), *T._parse_datatype_string(more).fields])


def block(runs: list[dict], costs: Costs) -> dict:
    """A stretch of a conversation as one matrix, with what its neighbours need to see."""
    merged, plain = Merged(1), []
    for r in runs:
        gone = r["blank"] or r["seen"]
        plain.append(Row(r["role"][:1], gone, r["cut"] and not gone))
        if r["copies"] > 1:
            merged.add(fold(plain, costs, 1))
            plain = []
            merged.add(deletions(r["copies"] - 1, costs))
    if plain:
        merged.add(fold(plain, costs, 1))
    m = merged.all()
    initials = [r["role"][:1] for r in runs]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(r["copies"] - 1 for r in runs)
    return {c: runs[0][c] for c in KEY} | {
        "rows": m.rows, "width": m.width, "first": initials[0], "last": initials[-1], "illegal": illegal,
        "weights": [{"f": f, "t": t, "j": j, "w": w.to_bytes(w.bit_length() // 8 + 1, "big")} for (f, t, j), w in m.weights.items()]}


def blocks(faults: DataFrame, costs: Costs) -> DataFrame:
    """Stretches of up to BLOCK rows of each conversation, with the key of their first row."""
    def run(group: Iterator[dict]) -> Iterator[dict]:
        while held := list(islice(group, BLOCK)):
            yield block(held, costs)

    return _streamed(faults.repartitionByRange(*_order("conv")).sortWithinPartitions(*_order("conv")), run, _schema(
        faults, KEY, "rows int, width int, first string, last string, illegal long, weights array<struct<f: int, t: int, j: int, w: binary>>"))


def solved(parts: DataFrame) -> DataFrame:
    """(conv, cost, audit, illegal) of each conversation, its blocks multiplied in order."""
    def run(group: Iterator[dict]) -> Iterator[dict]:
        merged, illegal, last = Merged(1), 0, None
        for r in group:
            illegal += r["illegal"] + (last is not None and last + r["first"] not in LEGAL)
            last = r["last"]
            merged.add(Matrix(r["rows"], r["width"], {(e["f"], e["t"], e["j"]): int.from_bytes(e["w"], "big") for e in r["weights"]}))
            conv = r["conv"]
        cost, audit = best(merged.all())
        yield {"conv": conv, "cost": cost, "audit": audit, "illegal": illegal}

    return _streamed(parts.repartition("conv").sortWithinPartitions(*_order("conv")), run,
                     _schema(parts, ["conv"], "cost long, audit string, illegal long"))


def edited(audit: str, rows: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every turn that the audit leaves of the rows; copies of a row have its edit first, then deletions."""
    state, turns = START, (r for r in rows for _ in range(r["copies"]))
    for letter in audit:
        if letter == "I":
            role, text = FILL[state], ""
        else:
            row = next(turns)
            if letter == "D":
                continue
            role, text = FILL[state] if letter == "R" else row["role"], row["text"]
        state = NEXT[state][role[:1]]
        yield letter, role, text


def _behind_audits(runs: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit (in ``text``), then its rows in order, in one partition."""
    head = audits.select("conv", F.lit(None).cast(runs.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                         F.lit("").alias("sha"), F.lit(0).cast("long").alias("copies"), F.col("audit").alias("text"), F.lit(0).alias("seq"))
    both = head.unionByName(runs.select(*KEY, "copies", "text", F.lit(1).alias("seq")))
    return both.repartition("conv").sortWithinPartitions(*_order("conv", "seq"))


def digests(runs: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): over the turns that the audit leaves, as ``role:text`` joined by newlines."""
    def run(group: Iterator[dict]) -> Iterator[dict]:
        head, digest, between = next(group), hashlib.sha256(), ""
        for _, role, text in edited(head["text"], group):
            digest.update(f"{between}{role}:{text}".encode())
            between = "\n"
        yield {"conv": head["conv"], "repaired_sha256": digest.hexdigest()}

    return _streamed(_behind_audits(runs, audits), run, _schema(runs, ["conv"], "repaired_sha256 string"))


def facts(faults: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated): each row's first fault, and the turns missing between the first and the last."""
    n = lambda c: F.sum(c).cast("long")
    counts = faults.groupBy("conv").agg(
        n(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        n(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("seen"), 0).otherwise(1))).alias("duplicate"),
        n((~F.col("blank") & ~F.col("seen") & F.col("cut")).cast("int")).alias("truncated"))
    whole = lambda c: c.cast("decimal(38,0)")
    gaps = faults.select("conv", "turn").distinct().groupBy("conv").agg(
        F.coalesce((whole(F.max("turn")) - whole(F.min("turn")) + 1 - F.count("turn")).cast("long"), F.lit(0).cast("long")).alias("gaps"))
    return counts.unionByName(gaps, allowMissingColumns=True).groupBy("conv").agg(
        *(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")))


def _solve(rows: DataFrame, costs: Costs) -> tuple[DataFrame, DataFrame, DataFrame]:
    if costs.insert <= 2 * costs.delete:
        raise ValueError("blocks allow one insertion, so insertions must cost more than two deletions")
    runs = staged(counted(rows), "turns")
    faults = staged(with_faults(runs), "turn-faults")
    return runs, faults, staged(solved(blocks(faults, costs)), "audits")


def repair(rows: DataFrame, conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row for each of ``conversations`` (column conv): faults found in ``rows`` (conv, turn, role, text), the cheapest
    edits and the digest of what they leave."""
    runs, faults, audits = _solve(rows, costs)
    out = conversations.select("conv")
    for part in (facts(faults), audits, digests(runs, audits)):
        out = out.unionByName(part, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c)
    return out.groupBy("conv").agg(
        *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repaired_turns(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv, place, edit, role, text): the repaired conversations themselves."""
    def run(group: Iterator[dict]) -> Iterator[dict]:
        head = next(group)
        for place, (edit, role, text) in enumerate(edited(head["text"], group)):
            yield {"conv": head["conv"], "place": place, "edit": edit, "role": role, "text": text}

    runs, _, audits = _solve(rows, costs)
    return _streamed(_behind_audits(runs, audits), run, _schema(runs, ["conv"], "place long, edit string, role string, text string"))


def repair_sql(table: str = "conversations") -> str:
    """The same in DuckDB SQL: crc32 by its bits, edits by a fold over a conversation's rows that keeps the least
    (cost, audit) for each state as one string. It has no insertions, which no cheapest path holds (see ``insert_bound``)."""
    least = lambda *of: f"list_min(list_filter([{', '.join(of)}], lambda z: z IS NOT NULL))"
    step = lambda state, cost, letter: f"printf('%09d', CAST(x.{state}[1:9] AS INT) + {cost}) || x.{state}[10:] || '{letter}'"
    may = lambda state, cost, letter, when: f"CASE WHEN {when} THEN {step(state, cost, letter)} END"
    free, more = "NOT y.gone", f"CASE WHEN y.cut THEN {TRUNCATED} ELSE 0 END"
    into = lambda state, *of: least(step(state, DELETE, "D"), *of)
    to_user = [may(q, f"{c} + {more}", e, f"{free}{w}") for q in "abd" for c, e, w in ((KEEP, "K", " AND y.i = 'u'"), (REROLE, "R", ""))]
    fold_sql = f"""{{'i': y.i, 'gone': y.gone, 'cut': y.cut,
            'a': {into("a")},
            'b': {into("b", may("a", f"{KEEP} + {more}", "K", f"{free} AND y.i = 's'"))},
            'c': {into("c", *to_user)},
            'd': {into("d", may("c", f"{KEEP} + {more}", "K", f"{free} AND y.i = 'a'"), may("c", f"{REROLE} + {more}", "R", free))}}}"""
    return rf"""WITH crc_table AS MATERIALIZED (
            SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t
            FROM range(256) r(n)),
        d AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit
            FROM {table}, crc_table),
        e AS (
            SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                   CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM d WHERE hit <> 0),
        f AS (
            SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '{BLANK}') AS blank,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                   regexp_extract(text, '({BLANK})[ 	-
]*\z', 1) NOT IN ('.', '!', '?') AS cut,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n
            FROM e),
        g AS (
            SELECT *, blank OR seen AS gone, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM f),
        h AS MATERIALIZED (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                   sum(blank::INT)::BIGINT AS blank, sum((NOT blank AND seen)::INT)::BIGINT AS duplicate,
                   sum((NOT gone AND cut)::INT)::BIGINT AS truncated,
                   sum((before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal,
                   list({{'role': role, 'text': text}} ORDER BY n) AS turns,
                   list_reduce([{{'i': '', 'gone': false, 'cut': false, 'a': '000000000', 'b': NULL, 'c': NULL, 'd': NULL}}]
                       || list({{'i': i, 'gone': gone, 'cut': NOT gone AND cut, 'a': NULL::VARCHAR, 'b': NULL::VARCHAR, 'c': NULL::VARCHAR, 'd': NULL::VARCHAR}} ORDER BY n),
                       lambda x, y: {fold_sql}) AS s
            FROM g GROUP BY conv_id),
        k AS (SELECT *, list_min(list_filter([s.a, s.d], lambda z: z IS NOT NULL)) AS best FROM h),
        left_turns AS (
            SELECT conv_id, n, best[9 + n] AS edit, turns[n] AS t,
                   row_number() OVER (PARTITION BY conv_id ORDER BY n) AS m
            FROM (SELECT conv_id, best, turns, unnest(range(1, len(turns) + 1)) AS n FROM k) WHERE best[9 + n] <> 'D'),
        starts AS (SELECT conv_id, any_value(left(t.role, 1)) = 's' AND any_value(edit) = 'K' AS s FROM left_turns WHERE m = 1 GROUP BY conv_id),
        r AS (
            SELECT left_turns.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN t.role WHEN (m - s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                       || ':' || t.text, chr(10) ORDER BY m)) AS sha
            FROM left_turns JOIN starts ON left_turns.conv_id IS NOT DISTINCT FROM starts.conv_id
            GROUP BY left_turns.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best[1:9]::BIGINT, 0) AS cost,
               coalesce(best[10:], '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM {table}) o LEFT JOIN k ON o.conv_id IS NOT DISTINCT FROM k.conv_id
        LEFT JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id"""
