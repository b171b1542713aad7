"""Exact similarity join on word shingles with token-combination prefixes.

Two documents link if the Jaccard similarity of their shingle sets is at least
T = 3/4. Shingles (the tokens here) have one order for all documents: rare
ones before frequent ones, by number within each class. If two sets of sizes n
and m link, then

* their prefixes of ``n - ceil(T n) + 1`` tokens share one token, and
* their prefixes extended to ``n - ceil(T n) + l`` tokens share ``l`` of them.

A rare token of the prefix is indexed by itself. Frequent tokens (shared
passages, large groups of near copies) would make long lists; they stand last
in the order, so that most documents have none in the prefix. Where a prefix
reaches them, pairs of them are indexed instead: the prefix is extended to
l = g + 1, its frequent tokens fall into g classes by number, two linked
documents have two shared tokens in one class, and so share a combination of
two within a class. g follows the size (a power of two of about n / 16), so a
document has about as many combinations as tokens; next to its own size class
it is indexed for the neighbour that a linked document may be in. Sets of
under 16 tokens index frequent tokens by themselves.

If a document's prefix reaches frequent tokens, all its rare ones are in the
prefix; so a pair that meets in a combination only can share no more than the
smaller count of frequent tokens, which must reach the overlap that T asks for.
That keeps a group's edited, unlinked copies out of the pairs.

Pairs are found in two rounds so that a large group is not expanded: first
each index list's most typical member meets the others; then, of lists that
still hold several components, the pairs across components. Documents with a
passage in common meet in a list for each of its tokens: of lists with the same
members only the first is kept, and of two lists that a pair is in, the later
one leaves it out (a list is earlier for all its members, as tokens have one
order, so the bound on what is left holds there too). Of those pairs, a bitmap
of each set (every token flips one bit) leaves out pairs that can't link: two
bitmaps differ in no more bits than the sets differ in tokens, and linked sets
differ in at most a seventh of both sizes. All pairs are verified on their texts. Which tokens count as frequent decides cost, never
results: those that several documents of one task share are counted, and the
``MAX_FREQUENT`` most frequent taken (a bounded list).

Equal sets are one class from the start, by the tree merge of exact dedup;
only the class's smallest id takes part in the join.

Defined results: no words: an empty set, linked with nothing. Under five words:
the whole sequence is one token. Rows with a null id get n_shingles and a null
component. An id that repeats is one document per row in the counts; its rows
share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import MAX_BROADCAST_ROWS, col, map_batches, pieces, sized, staged, text_bytes
from vigil.llm.exact_dedup import smallest_by_key
from vigil.llm.textnum import mix, shingle_sets

#: Times from which on a token is frequent, most tokens counted as such, and tokens that a task counts at once.
FREQUENT, MAX_FREQUENT, COUNTED = 16, 1 << 18, 1 << 22
#: Sets of fewer tokens have no combinations.
SMALL = 16
#: Numbers of 64 bits in a set's bitmap; sets of far more tokens than bits fill it, and it leaves out none of theirs.
SKETCH = 8
#: Pairs of one typical member that one stream of texts holds.
SPLIT = 2000


def need(n: int, m: int) -> int:
    """Least overlap of linked sets: 100 i >= 75 (n + m - i)."""
    return -(-3 * (n + m) // 7)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A bitmap: which bits an odd number of tokens have."""
    odd = np.bincount((tokens % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Held:
    """Tokens of a task until they are counted, in one array that is sorted in place."""

    def __init__(self, room: int):
        self.tokens, self.size = np.empty(room, dtype=np.uint64), 0

    def add(self, tokens: np.ndarray) -> None:
        end = self.size + len(tokens)
        if end > len(self.tokens):  # the last texts before a count
            self.tokens = np.concatenate([self.tokens[:self.size], np.empty(end - self.size + len(self.tokens) // 8, dtype=np.uint64)])
        self.tokens[self.size:end] = tokens
        self.size = end

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens held more than once, sorted, with their counts; none are held after that."""
        found = self.tokens[:self.size]
        found.sort()
        again = np.zeros(self.size + 1, dtype=bool)  # the token before is the same
        again[1:-1] = found[1:] == found[:-1]
        first, last = np.flatnonzero(again[1:] & ~again[:-1]), np.flatnonzero(again[:-1] & ~again[1:])
        self.size = 0
        return found[first].copy(), last - first + 1


def describe(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Per row id, n, the set's digest and bitmap; besides, tokens that repeat within a task with their counts."""
    rows = df.select(col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "digest", "sketch", "token", "times"]
        bitmap = pa.list_(pa.int64())
        seen: set[bytes] = set()
        held = Held(COUNTED)

        def repeated() -> pa.RecordBatch:
            tokens, times = held.repeated()
            k = len(tokens)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, bitmap),
                 pa.array(tokens.view(np.int64)), pa.array(times)], names)

        for batch in batches:
            n, digest, bits = [], [], []
            for _, texts in pieces(batch, "text"):
                for s in shingle_sets(texts):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    n.append(len(s))
                    digest.append(d)
                    bits.append(sketch(s))
                    if len(s) and d not in seen:
                        seen.add(d)
                        held.add(s)
                if held.size >= COUNTED:
                    yield repeated()
            none = len(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.array(bits, bitmap), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64())], names)
        if held.size:
            yield repeated()

    return map_batches(rows, run, "id bigint, n bigint, digest binary, sketch array<bigint>, token bigint, times bigint")


def frequent_tokens(described: DataFrame) -> np.ndarray:
    """Sorted; at most MAX_FREQUENT numbers."""
    counts = described.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times"))
    top = counts.where(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "token").limit(MAX_FREQUENT).toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64))


def size_classes(n: int) -> list[int]:
    """g for each power of two that a linked set's size may belong to."""
    low, high = -(-3 * n // 4), 4 * n // 3
    return sorted({max(1, 1 << max(0, m.bit_length() - 5)) for m in (max(1, low), n, high)})


def index_keys(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a sorted set: keys of rare prefix tokens with their places, keys for frequent ones, and how many
    frequent tokens the set has. Keys of different kinds are hashed apart."""
    n = len(tokens)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        rare, common = tokens[~often], tokens[often]
    else:
        rare, common = tokens, tokens[:0]
    prefix = n - -(-3 * n // 4) + 1
    own = rare[:prefix]
    left = prefix - len(own)
    if left <= 0 or 4 * len(common) < 3 * n:  # the bound on overlaps: need(n, m) is at least 3 n / 4
        return own, common[:0], len(common)
    keys = []
    with np.errstate(over="ignore"):
        if n < SMALL:
            keys.append(mix(common[:left] ^ np.uint64(0x5BD1E995)))
        # a set of under SMALL tokens meets larger ones by single tokens, these by combinations
        if 3 * n < 4 * SMALL <= 4 * n:
            keys.append(mix(common[:left] ^ np.uint64(0x5BD1E995)))
        if n >= SMALL:
            for g in size_classes(n):
                part = common[:left + g]  # the extended prefix shares g + 1
                if need(n, -(-3 * n // 4)) < g + 1:
                    part = common
                which = (part >> np.uint64(7)) % np.uint64(g)
                order = np.argsort(which, kind="stable")
                for members in np.split(part[order], np.flatnonzero(np.diff(which[order])) + 1):
                    if len(members) > 1:
                        a, b = np.array(list(combinations(range(len(members)), 2))).T
                        keys.append(mix(mix(members[a]) * np.uint64(0x9E3779B97F4A7C15) + members[b] + np.uint64(g)))
    return own, np.concatenate(keys) if keys else common[:0], len(common)


def index(df: DataFrame, frequent: np.ndarray, text_col: str, id_col: str) -> DataFrame:
    """key, id, place of a rare token (null for others) and frequent tokens in the set."""
    sent = df.sparkSession.sparkContext.broadcast(frequent)
    rows = df.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for start, texts in pieces(batch, "text"):
                keys, own, places, common = [], [], [], []
                for i, s in enumerate(shingle_sets(texts), start):
                    if not len(s) or (d := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                        continue  # a copy of one that this task has indexed
                    seen.add(d)
                    single, combined, c = index_keys(s, sent.value)
                    keys += [single, combined]
                    own.append(np.full(len(single) + len(combined), ids[i]))
                    places += [np.arange(len(single)), np.full(len(combined), -1)]
                    common.append(np.full(len(own[-1]), c))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(own)),
                         pa.array(np.concatenate(places).astype(np.int32)),
                         pa.array(np.concatenate(common).astype(np.int32))], ["key", "id", "place", "common"])

    return map_batches(rows, run, "key bigint, id bigint, place int, common int")


def shared_lists(indexed: DataFrame, classes: DataFrame) -> DataFrame:
    """The index's lists with at least two classes: key, rep, n, place, common."""
    by = Window.partitionBy("key").orderBy("id")
    lists = (indexed.withColumn("before", F.lag("id").over(by)).withColumn("after", F.lead("id").over(by))
             .where("before IS NOT NULL OR after IS NOT NULL").drop("before", "after"))
    reps = (lists.join(classes.select("id", "rep", "n"), "id")
            .groupBy("key", "rep").agg(F.first("n").alias("n"), F.first("place").alias("place"), F.first("common").alias("common")))
    by = Window.partitionBy("key").orderBy("rep")
    return (reps.withColumn("before", F.lag("rep").over(by)).withColumn("after", F.lead("rep").over(by))
            .where("before IS NOT NULL OR after IS NOT NULL").drop("before", "after"))


def may_link(a: str, b: str):
    """Sizes, and what the two can share if this list is the first in which they meet."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    both = F.least(F.col(f"{a}.common"), F.col(f"{b}.common"))
    sizes = (4 * n >= 3 * m) & (4 * m >= 3 * n)
    return sizes & (7 * F.when(F.col(f"{a}.place") >= 0, rest).otherwise(both) >= 3 * (n + m))


def typical_pairs(lists: DataFrame) -> DataFrame:
    """Each list's member with the largest share of frequent tokens, with every other."""
    first = Window.partitionBy("key").orderBy(F.desc(F.col("common") / F.col("n")), "rep") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    me = F.struct("rep", "n", "place", "common")
    return (lists.select("key", me.alias("y"), F.first(me).over(first).alias("x"))
            .where(F.col("x.rep") != F.col("y.rep")).where(may_link("x", "y"))
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def near_enough(a: str, b: str):
    """Linked sets differ in at most (n + m) / 7 tokens; their bitmaps differ in no more bits."""
    bits = sum(F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH))
    return F.coalesce(7 * bits <= F.col(f"{a}.n") + F.col(f"{b}.n"), F.lit(True))


def first_of_equal(lists: DataFrame) -> DataFrame:
    """Of lists with the same members (many, digest, check), the one that all of them have first."""
    kind = [(F.col("place") < 0).alias("combined"), "many", "digest", "check", F.when(F.col("loose"), F.col("key")).alias("own")]
    first = lists.groupBy(*kind).agg(F.min(F.struct("start", "key"))["key"].alias("key")).select("key").distinct()
    return lists.join(first, "key").drop("many", "digest", "check", "start", "loose")


def crossing_pairs(lists: DataFrame, components: DataFrame, tested: DataFrame, sketches: DataFrame, mixed: DataFrame) -> DataFrame:
    """All pairs of a list whose components differ and whose bitmaps (id, sketch) allow a link, without those tested. Members
    in ``mixed`` (rep) stand for several texts, whose tokens have no one order: their lists are all kept."""
    own = lists.join(components.withColumnRenamed("id", "rep"), "rep", "left") \
        .withColumn("component", F.coalesce("component", "rep")) \
        .join(mixed.withColumn("mixed", F.lit(True)), "rep", "left")
    # a list's largest component against nothing of itself: only the others look for partners
    own = own.withColumn("size", F.count("*").over(Window.partitionBy("key", "component")))
    by = Window.partitionBy("key")
    own = own.withColumn("main", F.max(F.struct("size", "component")).over(by)["component"]) \
        .withColumn("several", F.min("component").over(by) != F.max("component").over(by))
    for name, value in (("many", F.count("*")), ("digest", F.bit_xor(F.xxhash64("rep"))), ("check", F.bit_xor(F.xxhash64("rep", F.lit(1)))),
                        ("start", F.sum("place")), ("loose", F.max("mixed"))):
        own = own.withColumn(name, value.over(by))
    own = staged(own.where("several").drop("size", "several"), "crossing")
    own = first_of_equal(own).join(sketches.withColumnRenamed("id", "rep"), "rep", "left")
    # two members meet in many lists: of two lists that both are in, the later one leaves them out
    combined = F.col("place") < 0
    earlier = Window.partitionBy("rep", combined).orderBy("place", "key").rowsBetween(-8, -1)
    own = own.withColumn("before", F.when(F.col("mixed").isNull(), F.collect_list("key").over(earlier)))
    x, y = own.where("component != main").alias("x"), own.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y") \
        & near_enough("x", "y") & ~F.coalesce(F.arrays_overlap("x.before", "y.before"), F.lit(False))
    pairs = x.join(y, on).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def verify(df: DataFrame, pairs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Of the staged ``pairs`` (a, b) those that link, by their texts. The texts of a's partners follow
    a's own in one sorted stream; many partners are dealt over several."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SPLIT)).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    heads = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    roles = staged(dealt.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("role"))
                   .unionByName(heads.select(F.col("a").alias("id"), "a", "part", F.lit(0).alias("role"))), "roles")
    texts = df.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    stream = texts.join(sized(roles), "id").repartition("a", "part").sortWithinPartitions("a", "part", "role") \
        .select("a", "part", "role", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, part, role, ids = (batch.column(i).to_pylist() for i in range(4))
            found = []
            for start, texts_ in pieces(batch, "text"):
                for i, s in enumerate(shingle_sets(texts_), start):
                    if role[i] == 0:
                        group, head = (a[i], part[i]), s
                    elif group == (a[i], part[i]):
                        shared = len(np.intersect1d(head, s, assume_unique=True))
                        if 100 * shared >= 75 * (len(head) + len(s) - shared):
                            found.append((a[i], ids[i]))
            left, right = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return map_batches(stream, run, "a bigint, b bigint")


def connected(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of all ids in the staged ``links`` (a, b): large star and small star
    in turn until nothing changes; each round is written to the shared folder."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u != v").distinct(), "edges")
    sums = None
    while True:
        # large star: each larger neighbour goes to the smallest one; small star: the smaller ones and itself do
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))) \
            .where("u != v").distinct()
        edges = staged(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sums:
            break
        sums = now
    parents = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return parents.unionByName(parents.select(F.col("component").alias("id"), "component").distinct())


def similarity_join(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Per row: id, n_shingles, class_id (smallest id of an equal set), component_id; and the links found
    between classes, which connect the same components as all links do."""
    described = staged(describe(df, text_col, id_col), "sets")
    frequent = frequent_tokens(described)
    # an empty set is equal to none: its digest holds its id
    digest = F.when(F.col("n") > 0, F.col("digest")).otherwise(F.coalesce(F.col("id"), F.lit(-1)).cast("string").cast("binary"))
    rows = described.where("token IS NULL").select("id", F.struct(
        digest.alias("digest"), "n", F.xxhash64(digest).alias("check")).alias("key"))
    classes = staged(smallest_by_key(rows).select("id", F.col("keep_id").alias("rep"), F.col("key.n").alias("n")), "classes")
    lists = staged(shared_lists(index(df, frequent, text_col, id_col), classes.where("id IS NOT NULL").dropDuplicates(["id"])),
                   "lists")
    tested = staged(typical_pairs(lists), "pairs")
    links = staged(verify(df, tested, text_col, id_col), "links")
    # an id of several rows has no bitmap
    sketches = described.where("id IS NOT NULL AND token IS NULL").groupBy("id") \
        .agg(F.when(F.count("*") == 1, F.first("sketch")).alias("sketch"))
    mixed = classes.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows"), F.collect_set("rep").alias("reps")) \
        .where("rows > 1").select(F.explode("reps").alias("rep")).distinct()
    more = staged(crossing_pairs(lists, connected(links), tested, sketches, mixed), "pairs")
    links = staged(links.unionByName(verify(df, more, text_col, id_col)), "links")
    out = classes.join(connected(links).withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.col("rep")).alias("class_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
    return out, links


def drop_similar(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component, with all their columns."""
    found, _ = similarity_join(df, text_col, id_col)
    gone = staged(found.where(F.col("component_id") != col(id_col)).select(col(id_col).alias("__gone")).distinct(), "gone")
    return df.join(sized(gone), col(id_col) == F.col("__gone"), "left_anti")
