"""Personal data: values found by pattern, and terms that give them away.

Values (e-mail, IP address, card, phone number) are found by pattern. A value is
a protected entity; what else discloses it is estimated from the corpus. Over
all documents, n(e) hold the entity, n(t) the term, n(e, t) hold the term within
``WINDOW`` characters of the entity, N are there at all:

    PMI(e; t) = log2(n(e, t) * N / (n(e) * n(t)))      what the term tells about the entity
    IC(e)     = log2(N / n(e))                          all there is to tell

A term whose PMI reaches ``DISCLOSURE`` of the entity's IC, seen with it in at
least ``CONTEXTS`` different surroundings (so not only in copies of one text),
is treated as personal data wherever it stands: it is replaced by its class
([name], [number], [word]), or removed where that class itself discloses an
entity by the same measure.

DataFrame functions only. Positions come without a user function: a text split
at the matches gives the lengths between them, whose running sum (in blocks, so
that its cost stays linear) gives the offsets. Patterns have no way to backtrack
over long runs. Texts stay where they are read: co-occurrences are counted by
(entity, term), with partial sums before each shuffle, and only the terms a text
must lose are joined to it, by the text's digest.

Defined results: null text counts as empty; repeated rows have equal results and
count as often as they occur; an empty table gives an empty one. Offsets are code
points, ends exclusive. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import col, sized, staged

#: Code points on either side of a value in which terms count as near it.
WINDOW = 80
#: Share of an entity's information that a term may give away.
DISCLOSURE = 0.95
#: Different surroundings in which a term must stand near the entity.
CONTEXTS = 3
KINDS = ["email", "ip", "card", "phone"]
#: What the task fixes, written so that no long run is scanned twice: a match begins where the one before ended or
#: where no character precedes that could belong to it, and repetitions do not give back what they took.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without this a text has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"[\p{L}\p{N}]{3,}+"
CLASSES = {"[number]": r"\p{N}", "[name]": r"^\p{Lu}"}
_STEP = 128


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(a: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element the merge of all up to it, in blocks of ``_STEP``: blocks first, then within the block."""
    fold = lambda x: F.aggregate(x, zero, merge)
    block = lambda i: F.floor(i / _STEP).cast("int")
    return let(a, lambda v: F.when(F.size(v) == 0, v).otherwise(let(
        F.transform(F.sequence(F.lit(0), block(F.size(v) - 1)), lambda b: fold(F.slice(v, b * _STEP + 1, F.lit(_STEP)))),
        lambda sums: let(
            F.transform(sums, lambda _, b: fold(F.slice(sums, F.lit(1), b))),
            lambda before: F.transform(v, lambda _, i: merge(
                F.get(before, block(i)), fold(F.slice(v, block(i) * _STEP + 1, i % _STEP + 1))))))))


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """Non-overlapping matches: start, end, value, and ``context`` code points before and after (not over another match)."""
    none = F.array().cast("array<struct<start:long,end:long,value:string,before:string,after:string>>")
    long = lambda x: F.length(x).cast("long")

    def found(values: Column) -> Column:
        def placed(pieces: Column) -> Column:
            steps = F.transform(values, lambda _, i: long(F.get(pieces, i)) + F.coalesce(long(F.get(values, i - 1)), F.lit(0).cast("long")))
            return let(running(steps, F.lit(0).cast("long"), lambda a, b: a + b), lambda starts: F.transform(values, lambda v, i: F.struct(
                F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(v)).alias("end"), v.alias("value"),
                *(x.alias(n) for x, n in ((F.right(F.get(pieces, i), F.lit(context)), "before"), (F.left(F.get(pieces, i + 1), F.lit(context)), "after"))))))

        return F.when(F.size(values) == 0, none).otherwise(let(F.split(text, pattern, -1), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (
        F.when(F.length(q) == 0, F.lit(0)).when(F.length(q) <= 3, q.cast("int")).otherwise(F.lit(999)) <= 255))),
    "card": lambda v: let(_digits(v), luhn),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}
#: One spelling for each entity.
ENTITY = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits}


def values(text: Column, context: int = 0) -> Column:
    """All valid values by start, then kind: start, kind's number, end, kind, value, before, after."""
    def of(n: int, kind: str) -> Column:
        found = F.transform(F.filter(matches(text, PATTERNS[kind], context), lambda m: VALID[kind](m["value"])), lambda m: F.struct(
            m["start"].alias("start"), F.lit(n).alias("nr"), m["end"].alias("end"), F.lit(kind).alias("kind"),
            F.concat(F.lit(kind + ":"), ENTITY[kind](m["value"])).alias("entity"), m["before"].alias("before"), m["after"].alias("after")))
        none = F.array().cast("array<struct<start:long,nr:int,end:long,kind:string,entity:string,before:string,after:string>>")
        return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if kind in NEEDS else found

    return F.array_sort(F.concat(*(of(n, k) for n, k in enumerate(KINDS))))


def class_of(surface: Column) -> Column:
    out = F.lit("[word]")
    for name, pattern in reversed(CLASSES.items()):
        out = F.when(surface.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _text(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("t", F.coalesce(col(text_col).cast("string"), F.lit("")))


def co_occurrences(texts: DataFrame) -> DataFrame:
    """(entity, term, both, contexts): documents with the term, or a term of that class, near the entity, and in how many
    different surroundings. The entity itself stands as term ''; entity '' is any of them."""
    whole = lambda s: F.concat(  # noqa: E731  a word cut by the window's edge does not count
        terms(F.when(F.length(s["before"]) == WINDOW, F.regexp_replace(s["before"], r"^[\p{L}\p{N}]+", "")).otherwise(s["before"])),
        terms(F.when(F.length(s["after"]) == WINDOW, F.regexp_replace(s["after"], r"[\p{L}\p{N}]+\z", "")).otherwise(s["after"])))
    pairs = lambda s: F.transform(
        let(whole(s), lambda w: F.concat(F.array(F.lit("")), F.transform(w, F.lower), F.transform(w, class_of))),
        lambda t: F.array(F.struct(s["entity"].alias("entity"), t.alias("term")), F.struct(F.lit("").alias("entity"), t.alias("term"))))
    held = texts.select(values(F.col("t"), WINDOW).alias("s")).where(F.size("s") > 0)
    held = held.select(F.xxhash64(F.transform("s", lambda s: F.struct(s["before"], s["entity"], s["after"]))).alias("context"),
                       F.explode(F.array_distinct(F.flatten(F.flatten(F.transform("s", pairs))))).alias("p"))
    return held.groupBy("p.entity", "p.term", "context").count().groupBy("entity", "term").agg(
        F.sum("count").alias("both"), F.count(F.lit(1)).alias("contexts"))


def told(both: Column, e: Column, t: Column, n: Column) -> Column:
    """The share of the entity's information that the term gives away; null where there is nothing to tell."""
    information = F.log2(n / e)
    return F.when(information > 0, F.log2(both * n / (e * t)) / information)


def disclosing(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, remove) of the terms over the threshold; (digest, term): the texts that hold a candidate."""
    classes = {"[word]": F.exists(terms(F.col("t")), lambda w: class_of(w) == "[word]"),
               "[name]": F.exists(terms(F.col("t")), lambda w: class_of(w) == "[name]"),
               "[number]": F.exists(terms(F.col("t")), lambda w: class_of(w) == "[number]")}
    total = texts.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c.cast("int")).alias(k) for k, c in classes.items())).first()
    n = F.lit(float(total["n"]))
    of_class = F.create_map(*[x for k in classes for x in (F.lit(k), F.lit(float(total[k] or 0)))])
    seen = staged(co_occurrences(texts), "co-occurrences")
    entities = seen.where("entity <> '' AND term = ''").select("entity", F.col("both").alias("e"))
    anywhere = seen.where("entity = '' AND term <> ''").select("term", F.col("both").alias("near"))
    often = seen.where((F.col("entity") != "") & (F.col("term") != "") & (F.col("contexts") >= CONTEXTS)).join(entities, "entity").join(anywhere, "term")
    often = staged(often, "candidates")
    is_class = F.col("term").startswith("[")
    # a term is in at least as many documents as hold it near any entity: that bound leaves out the common words
    could = often.where(~is_class & (told(F.col("both"), F.col("e"), F.col("near"), n) >= DISCLOSURE))
    held = texts.select(F.sha2(F.col("t").cast("binary"), 256).alias("digest"),
                        F.explode(F.array_distinct(F.transform(terms(F.col("t")), F.lower))).alias("term"))
    holders = staged(held.join(sized(staged(could.select("term").distinct(), "candidate-terms")), "term", "left_semi"), "holders")
    by_class = often.where(is_class).where(told(F.col("both"), F.col("e"), F.element_at(of_class, F.col("term")), n) >= DISCLOSURE)
    counts = holders.groupBy("term").agg(F.count(F.lit(1)).alias("t"))
    found = could.join(counts, "term").where(told(F.col("both"), F.col("e"), F.col("t"), n) >= DISCLOSURE)
    bad = by_class.select("entity", F.lit(True).alias("remove")).distinct()
    found = found.join(bad, "entity", "left").groupBy("term").agg(F.coalesce(F.max("remove"), F.lit(False)).alias("remove"))
    return found, holders


def find_personal(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, and ``personal``: the spans by start, then kind (start, end, kind, put: what takes their place)."""
    texts = _text(df.select(text_col), text_col).select("t")
    found, holders = disclosing(texts)
    found = sized(staged(found, "disclosing"))
    lose = staged(holders.distinct().join(found, "term").groupBy("digest").agg(F.collect_set(F.struct("term", "remove")).alias("lose")), "to-lose")
    taken = set(df.columns)
    name = lambda n: n if n not in taken else name("#" + n)
    t, digest, lost, base = (name(n) for n in ("t", "digest", "lose", "base"))
    lose = sized(lose).select(F.col("digest").alias(digest), F.col("lose").alias(lost))
    whole = df.withColumn(t, F.coalesce(col(text_col).cast("string"), F.lit(""))).withColumn(digest, F.sha2(col(t).cast("binary"), 256))
    spans = "array<struct<start:long,nr:int,end:long,kind:string,put:string>>"
    whole = whole.join(lose, digest, "left").withColumn(base, F.transform(values(col(t)), lambda s: F.struct(
        s["start"], s["nr"], s["end"], s["kind"], F.concat(F.lit("["), s["kind"], F.lit("]")).alias("put"))).cast(spans))

    def term_spans(lose: Column) -> Column:
        away = let(F.transform(lose, lambda x: x["term"]), lambda names: F.filter(
            matches(col(t), TERM), lambda m: F.array_contains(names, F.lower(m["value"]))))
        away = F.filter(away, lambda m: ~F.exists(col(base), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        put = lambda m: F.when(F.exists(lose, lambda x: (x["term"] == F.lower(m["value"])) & x["remove"]), F.lit("")).otherwise(class_of(m["value"]))
        return F.transform(away, lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("nr"), m["end"].alias("end"),
                                                    F.lit("term").alias("kind"), put(m).alias("put"))).cast(spans)

    more = F.when(col(lost).isNull(), F.array().cast(spans)).otherwise(let(col(lost), term_spans))
    return whole.withColumn("personal", F.array_sort(F.concat(col(base), more))).select(*[col(c) for c in df.columns if c != "personal"], "personal")


def sanitized(text: Column, spans: Column) -> Column:
    """The text with what takes the spans' place; overlapping spans go as one, under the first one's name. Groups of
    spans are cut out of the text first, then cut up, so that the cost stays near linear."""
    def built(s: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            size = F.length(text).cast("long")
            begin = lambda i: F.coalesce(F.get(s, i)["start"], size)

            def group(g: Column) -> Column:
                first = begin(g * _STEP)
                part = F.substring(text, (first + 1).cast("int"), (begin((g + 1) * _STEP) - first).cast("int"))
                one = lambda i, p: F.concat(
                    F.when((i > 0) & (begin(i) < F.get(ends, i - 1)), F.lit("")).otherwise(F.get(s, i)["put"]),
                    F.when(begin(i + 1) > F.get(ends, i), F.substring(p, (F.get(ends, i) - first + 1).cast("int"), (begin(i + 1) - F.get(ends, i)).cast("int"))).otherwise(F.lit("")))
                return let(part, lambda p: F.array_join(F.transform(
                    F.sequence(g * _STEP, F.least((g + 1) * _STEP, F.size(s)) - 1), lambda i: one(i, p)), ""))

            groups = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _STEP).cast("int"))
            return F.concat(F.substring(text, F.lit(1), begin(F.lit(0)).cast("int")), F.array_join(F.transform(groups, group), ""))

        ends = running(F.transform(s, lambda x: x["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        return F.when(F.size(s) == 0, text).otherwise(let(ends, with_ends))

    return let(spans, built)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Fixed values of the task: the patterns as given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal_sql(table: str = "documents") -> str:
    """op12's rows in DuckDB SQL, from the patterns as given."""
    term, edge = r"[\p{L}\p{N}]{3,}", r"[\p{L}\p{N}]+"
    class_sql = r"CASE WHEN regexp_matches(w, '\p{N}') THEN '[number]' WHEN regexp_matches(w, '^\p{Lu}') THEN '[name]' ELSE '[word]' END"
    matches_sql = "\n            UNION ALL ".join(
        f"SELECT r, '{k}' AS kind, {n} AS nr, regexp_extract_all(t, '{p}') AS v, string_split_regex(t, '{p}') AS p FROM d"
        for n, (k, p) in enumerate(GIVEN.items()))
    share = lambda t: f"log2(joint::DOUBLE * n / (e::DOUBLE * {t})) / nullif(log2(n::DOUBLE / e), 0) >= {DISCLOSURE}"
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
        total AS (SELECT count(*) AS n FROM d),
        m AS ({matches_sql}),
        placed AS (
            SELECT r, kind, nr, v[i] AS value, right(p[i], {WINDOW}) AS b, left(p[i + 1], {WINDOW}) AS a,
                   (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
            FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m)),
        base AS MATERIALIZED (
            SELECT r, kind, nr, s, s + length(value) AS e, b, a, kind || ':' || CASE kind WHEN 'email' THEN lower(value) WHEN 'ip' THEN value ELSE g END AS entity
            FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS g FROM placed)
            WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(g) BETWEEN 10 AND 15
                  WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR try_cast(right(x, 9) AS INT) > 255)) = 0
                  ELSE length(g) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(g)), lambda i:
                       CASE WHEN i % 2 = 0 THEN g[length(g) - i]::INT WHEN g[length(g) - i]::INT > 4 THEN 2 * g[length(g) - i]::INT - 9
                            ELSE 2 * g[length(g) - i]::INT END)) % 10 = 0 END),
        context AS (SELECT r, list({{'b': b, 'e': entity, 'a': a}} ORDER BY s, nr) AS c FROM base GROUP BY r),
        words AS (
            SELECT r, entity, unnest(list_concat(
                regexp_extract_all(CASE WHEN length(b) = {WINDOW} THEN regexp_replace(b, '^{edge}', '') ELSE b END, '{term}'),
                regexp_extract_all(CASE WHEN length(a) = {WINDOW} THEN regexp_replace(a, '{edge}\z', '') ELSE a END, '{term}'))) AS w FROM base),
        pairs AS (SELECT r, entity, lower(w) AS term FROM words UNION SELECT r, entity, {class_sql} FROM words UNION SELECT r, entity, '' FROM base),
        seen AS (SELECT entity, term, count(*) AS joint, count(DISTINCT c) AS contexts FROM pairs JOIN context USING (r) GROUP BY entity, term),
        often AS MATERIALIZED (
            SELECT seen.*, es.joint AS e FROM seen JOIN (SELECT entity, joint FROM seen WHERE term = '') es USING (entity)
            WHERE term <> '' AND contexts >= {CONTEXTS}),
        spelled AS MATERIALIZED (SELECT DISTINCT r, unnest(regexp_extract_all(t, '{term}')) AS w FROM d),
        held AS (SELECT lower(w) AS term, count(DISTINCT r) AS t FROM spelled WHERE lower(w) IN (SELECT term FROM often) GROUP BY 1),
        found AS (SELECT DISTINCT term FROM often JOIN held USING (term), total WHERE {share("t")}),
        term_matches AS (
            SELECT r, regexp_extract_all(t, '{term}') AS v, string_split_regex(t, '{term}') AS p FROM d
            WHERE r IN (SELECT r FROM spelled WHERE lower(w) IN (SELECT term FROM found))),
        term_spans AS (
            SELECT r, 'term' AS kind, {len(KINDS)} AS nr, s, s + length(value) AS e FROM (
                SELECT r, v[i] AS value, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
                FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM term_matches)) q
            WHERE lower(value) IN (SELECT term FROM found)
              AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = q.r AND base.s < q.s + length(q.value) AND q.s < base.e)),
        every AS (SELECT r, kind, nr, s, e FROM base UNION ALL SELECT r, kind, nr, s, e FROM term_spans),
        said AS (
            SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
                   coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nr) FILTER (kind <> 'term'), '') AS base_spans,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nr) AS spans
            FROM every GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)},
               sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN said USING (r)"""
