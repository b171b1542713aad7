"""Class-based n-gram scoring.

Words are put into classes by exchange clustering, and a text is scored by a
class bigram: P(word | before) = P(class | class before) P(word | class).

Training reads all texts four times. The first pass counts words; the ``head``
most frequent (a bounded list) are then known to every task. The second counts
bigrams of *units*: the most frequent words, and for all other words one of
``buckets`` groups by their last three bytes. On that table, of at most
(units + buckets + 1)**2 sums, the exchange runs on the driver: each unit in
turn moves to the class that raises the bigram likelihood most, until no sweep
moves one or ``sweeps`` are done. The third pass counts, for every word that is
not a unit, the classes on both its sides; each such word then gets, in a Spark
task, the class in which these counts raise the likelihood most, while its
neighbours keep the classes of the exchange. The fourth counts class bigrams
under the classes found. Units and classes grow with the vocabulary
(``units_for``, ``classes_for``).

The classes of all words are a table. Head words have theirs in every task; all
others meet it in a join, in training as (word, class beside it, times) and in
scoring as (word, document, places), so no table of the whole vocabulary is
ever sent to tasks; head words are those that would be its hot keys. A word
never seen in training has its bucket's class.

Scoring reads every text once, and then a path of classes for each, completed
by the classes that the join found.

Smoothing: transitions are mixed with the next class's share (weight
``PRIOR`` counts); a word's share of its class has ``DELTA`` added, with one
unseen word for each class.

Defined results: a null or empty text is the end token alone. Repeated ids are
scored as one row each. Without training rows the base score is that of an
empty model, and so is the score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import col, map_batches, pieces, staged, text_bytes

DELTA, PRIOR = 0.1, 5.0
HEAD, UNITS, BUCKETS, CLASSES, SWEEPS = 1 << 17, 1024, 128, 48, 12
#: Most different words that a task counts before it hands its counts on.
FLUSH = 300_000
FIELDS = ["word", "after", "codes", "counts"]
#: Most context counts that a task holds, and that are weighed at once.
HELD, WEIGHED = 2_000_000, 20_000
#: Counts up to which the rise of n log n is looked up.
FEW = 8


def units_for(words: int) -> int:
    """Units of a vocabulary: their table of bigrams has to fit a task."""
    return min(4 * UNITS, max(UNITS, math.isqrt(words)))


def classes_for(words: int) -> int:
    return max(CLASSES, round(words ** 0.3))


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-3:]) % buckets


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """word (bytes), n: over all rows of ``df``; words folded to lower-case A-Z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def written() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                                             ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for _, texts in pieces(batch, "text"):
                counts.update(b" ".join(texts).lower().split())
                if len(counts) > FLUSH:
                    yield written()
        if counts:
            yield written()

    parts = map_batches(df.select(text_bytes(text_col).alias("text")), run, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes for the units of a square table of bigram counts; the last unit, the
    text's border, stays alone in the last class. Maximises the sum of n log n over class
    bigrams less that over the classes' left and right totals."""
    size = len(bigrams) - 1
    out = bigrams.sum(axis=1)
    order = np.argsort(-out[:size], kind="stable")
    of = np.empty(size + 1, dtype=np.int64)
    of[order] = np.arange(size) % classes  # by frequency, round robin
    of[size] = classes
    k = classes + 1
    member = np.zeros((size + 1, k))
    member[np.arange(size + 1), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # unit before class, class before unit
    table = member.T @ right

    ids = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            old = of[u]
            r, l, own = right[u].copy(), left[u].copy(), bigrams[u, u]
            if not r.any() and not l.any():
                continue
            r[old] -= own
            l[old] -= own
            table[old] -= r
            table[:, old] -= l
            table[old, old] -= own
            rows, cols = (table.sum(axis=1) + l)[:classes], (table.sum(axis=0) + r)[:classes]  # u's neighbours count anywhere
            # the gain of u in class c: its row and column grow by r and l, their crossing by all
            gain = (h(table[:classes] + r) - h(table[:classes])).sum(axis=1)
            gain += (h(table[:, :classes].T + l) - h(table[:, :classes].T)).sum(axis=1)
            cross = table[ids, ids]
            gain += h(cross + r[:classes] + l[:classes] + own) - h(cross + r[:classes]) - h(cross + l[:classes]) + h(cross)
            all_out, all_in = r.sum() + own, l.sum() + own
            gain -= h(rows + all_out) - h(rows) + h(cols + all_in) - h(cols)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9 * abs(gain[old]):
                new = old
            table[new] += r
            table[:, new] += l
            table[new, new] += own
            if new != old:
                moved += 1
                of[u] = new
                right[:, old] -= bigrams[:, u]
                right[:, new] += bigrams[:, u]
                left[:, old] -= bigrams[u]
                left[:, new] += bigrams[u]
        if not moved:
            break
    return of


def grown(base: np.ndarray, row: np.ndarray, n: np.ndarray, old: np.ndarray) -> np.ndarray:
    """What h rises by in each column of the ``row`` of ``base`` as n is added; column ``old`` has that n already. Most
    counts are small: their rises are looked up."""
    known, small = h(base), n <= FEW
    rise = h(base + np.arange(FEW + 1.0)[:, None, None]) - known
    out = rise[np.where(small, n, 0).astype(np.int64), row]
    if not small.all():
        large = np.flatnonzero(~small)
        out[large] = h(base[row[large]] + n[large, None]) - known[row[large]]
    have = base[row, old]
    out[np.arange(len(row)), old] = h(have) - h(have - n)
    return out


def gains(at: np.ndarray, code: np.ndarray, n: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Likelihood gain of each class for each word, its neighbours' classes held: ``at`` (rising, no
    word left out) is the word of a context count, ``code`` the class before it, or the number of
    classes and the class after it, ``n`` the times. ``old`` is the class that ``table``, of class
    bigrams, has the word in."""
    k = len(table)
    beside = np.concatenate([table[:, :k - 1], table.T[:, :k - 1]])
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.add.reduceat(grown(beside, code, n, old[at]), starts)
    times = np.add.reduceat(np.where(code < k, n, 0.0), starts)
    for sums in (table.sum(axis=1), table.sum(axis=0)):
        out -= grown(sums[None, :k - 1], np.zeros(len(old), dtype=np.int64), times, old)
    return out


@dataclass
class Model:
    """What every task needs, of a size that the parameters bound."""

    head: list[bytes]        # most frequent words, by count
    counts: np.ndarray       # theirs
    head_class: np.ndarray   # theirs
    unknown: np.ndarray      # class of each bucket of words not known, then the border's
    moves: np.ndarray        # log10 P(class | class before)
    emits: np.ndarray        # log10 of the denominator of P(word | class), by class
    tokens: int              # N, ends included
    words: int               # V, the end included
    ends: int                # training texts


def contexts(df: DataFrame, text_col: str, head: list[bytes], look: np.ndarray, first: int) -> DataFrame:
    """Counts of what stands side by side. ``look`` has the classes of the ``head`` words, then of
    each bucket of other words, then the border's; -1 is a class not known. Rows are

    * word, codes, counts for words other than the ``first`` of the head: a code is the class before the
      word, or the number of classes and the class after it; sides not known are left out;
    * word, after, counts (one) for two words in turn with classes not known;
    * codes, counts for two known classes in turn: the first times the number of classes, and the second.
    """
    sent = df.sparkSession.sparkContext.broadcast((head, look))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, look = sent.value
        size, k = len(words), int(look[-1]) + 1
        buckets, border = len(look) - size - 1, len(look) - 1
        get = {w: i for i, w in enumerate(words)}.get
        other: dict[bytes, int] = {}
        table = np.zeros(k * k, dtype=np.int64)
        far: dict[bytes, int] = {}  # numbers of words that are not of the head
        beside: list[tuple[np.ndarray, np.ndarray]] = []  # number * 2k + code, n
        turns: list[tuple[np.ndarray, np.ndarray]] = []  # two numbers, n

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            if not parts:
                return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            keys, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([y for _, y in parts])).astype(np.int64)

        def rows(word: pa.Array, after: pa.Array, starts: np.ndarray, code: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            """A row for each of ``word``; its codes and counts begin at its start."""
            ends = pa.array(np.append(starts, len(n)).astype(np.int32))
            codes = pa.nulls(len(word), pa.list_(pa.int32())) if code is None else pa.ListArray.from_arrays(ends, pa.array(code.astype(np.int32)))
            return pa.RecordBatch.from_arrays([word, after, codes, pa.ListArray.from_arrays(ends, pa.array(n))], FIELDS)

        def written() -> Iterator[pa.RecordBatch]:
            names = pa.array([*words, *far], pa.binary())
            keys, n = merged(beside)
            number = keys // (2 * k)
            begin = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(keys))
            for a in range(0, len(begin) - 1, 1 << 14):
                some = begin[a:a + (1 << 14) + 1]
                x, y, starts = some[0], some[-1], some[:-1]
                yield rows(names.take(pa.array(number[starts])), pa.nulls(len(starts), pa.binary()), starts - x, keys[x:y] % (2 * k), n[x:y])
            keys, n = merged(turns)
            for a in range(0, len(keys), 1 << 15):
                part = keys[a:a + (1 << 15)]
                yield rows(names.take(pa.array(part >> 32)), names.take(pa.array(part & 0xFFFFFFFF)), np.arange(len(part)), None,
                           n[a:a + (1 << 15)])
            for held in (beside, turns, far):
                held.clear()

        for batch in batches:
            for _, texts in pieces(batch, "text"):
                ids, at, own_far = [border], [], []
                for text in texts:
                    for w in text.lower().split():
                        i = get(w)
                        if i is None:
                            at.append(len(ids))
                            own_far.append(far.setdefault(w, size + len(far)))
                            i = other.get(w[-3:])
                            if i is None:
                                i = other[w[-3:]] = size + bucket_of(w, buckets)
                        ids.append(i)
                    ids.append(border)
                line = np.array(ids, dtype=np.int64)
                path = look[line]
                known = (path[:-1] >= 0) & (path[1:] >= 0)
                table += np.bincount((path[:-1] * k + path[1:])[known], minlength=k * k)
                number, place = np.array(own_far, dtype=np.int64), np.array(at, dtype=np.int64)
                own = np.flatnonzero((line >= first) & (line < size))
                both, where = np.concatenate([line[own], number]), np.concatenate([own, place])
                before, after = path[where - 1], path[where + 1]
                met = np.concatenate([(both * 2 * k + before)[before >= 0], (both * 2 * k + k + after)[after >= 0]])
                if len(met):
                    beside.append(np.unique(met, return_counts=True))
                two = np.flatnonzero(after[len(own):] < 0)
                if len(two):
                    turns.append(np.unique(number[two] << 32 | number[two + 1], return_counts=True))
                if len(beside) > 16 or len(turns) > 16:
                    beside[:], turns[:] = [merged(beside)], [merged(turns)]
                    if len(beside[0][0]) + len(turns[0][0]) > HELD:
                        yield from written()
                if len(far) > FLUSH:
                    yield from written()
        yield from written()
        at = np.flatnonzero(table)
        yield rows(pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), np.zeros(1, dtype=np.int64), at, table[at])

    return map_batches(df.select(text_bytes(text_col).alias("text")), run,
                       "word binary, after binary, codes array<int>, counts array<bigint>")


def assigned(found: DataFrame, table: np.ndarray, unknown: np.ndarray) -> DataFrame:
    """word, n, class from the words' context counts: the class of the largest gain, the old one if none is larger."""
    # a task has counted a word's contexts in one row: nothing is gained by collecting before the shuffle
    rows = found.where("word IS NOT NULL").repartition("word").groupBy("word").agg(
        F.flatten(F.collect_list("codes")).alias("code"), F.flatten(F.collect_list("counts")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(table)
        for batch in batches:
            words, codes, counts = batch.column("word").to_pylist(), batch.column("code"), batch.column("n")
            keys = np.repeat(np.arange(len(words)), codes.value_lengths().to_numpy()) * 2 * k + codes.flatten().to_numpy()
            keys, where = np.unique(keys, return_inverse=True)  # several tasks have the same
            n, code = np.bincount(where, counts.flatten().to_numpy()), keys % (2 * k)
            many = np.bincount(keys // (2 * k), minlength=len(words))
            ends = np.cumsum(many)
            old = np.array([unknown[bucket_of(w, len(unknown) - 1)] for w in words], dtype=np.int64)
            new, a = old.copy(), 0
            while a < len(words):
                start = int(ends[a] - many[a])
                b = max(a + 1, int(np.searchsorted(ends, start + WEIGHED, side="right")))
                at = np.repeat(np.arange(b - a), many[a:b])
                gain = gains(at, code[start:ends[b - 1]], n[start:ends[b - 1]], old[a:b], table)
                best, each = gain.argmax(axis=1), np.arange(b - a)
                new[a:b] = np.where(gain[each, best] > gain[each, old[a:b]], best, old[a:b])
                a = b
            times = np.add.reduceat(np.where(code < k, n, 0.0), ends - many) if len(words) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(times.astype(np.int64)),
                                              pa.array(new.astype(np.int32))], ["word", "n", "class"])

    return map_batches(rows, run, "word binary, n bigint, class int")


def class_bigrams(found: DataFrame, table: DataFrame, k: int) -> np.ndarray:
    """Counts of two classes in turn, all words' classes known: ``found`` of ``contexts``, the other words' from ``table``."""
    of = table.select("word", F.col("class").alias("__of"))
    each = F.explode(F.arrays_zip("codes", "counts")).alias("x")
    lone = found.where("word IS NOT NULL AND after IS NULL").join(of, "word").select("__of", each).select(
        "__of", F.col("x.codes").alias("code"), F.col("x.counts").alias("n"))
    side = F.pmod(F.col("code"), F.lit(k))
    lone = lone.select(F.when(F.col("code") < k, side * k + F.col("__of")).otherwise(F.col("__of") * k + side).alias("code"), "n")
    both = found.where("after IS NOT NULL").select("word", "after", F.col("counts")[0].alias("n")).join(of, "word") \
        .select("after", F.col("__of").alias("__left"), "n")
    both = both.join(of.withColumnRenamed("word", "after"), "after").select((F.col("__left") * k + F.col("__of")).alias("code"), "n")
    sums = (found.where("word IS NULL").select(each).select(F.col("x.codes").alias("code"), F.col("x.counts").alias("n")).unionByName(lone).unionByName(both)
            .groupBy("code").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(k * k)
    out[sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(k, k)


def train(df: DataFrame, text_col: str = "text", head: int = HEAD, units: int | None = None, buckets: int = BUCKETS,
          classes: int | None = None) -> tuple[Model, DataFrame]:
    """The model, and the staged table of all words with their counts and classes."""
    spark = df.sparkSession
    counts = staged(count_words(df, text_col), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = df.count()
    units, classes = units or units_for(totals[1]), classes or classes_for(totals[1])
    top = counts.orderBy(F.desc("n"), "word").limit(head).collect()
    words = [bytes(r[0]) for r in top]
    own = min(units, len(words))
    size = own + buckets + 1
    unit_of = {w: i for i, w in enumerate(words[:own])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, get = np.zeros(size * size, dtype=np.int64), unit_of.get
        other: dict[bytes, int] = {}  # by last three bytes: at most 2**24, in fact few
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                ids: list[int] = [size - 1]
                for text in texts:
                    for w in text.lower().split():
                        u = get(w)
                        if u is None:
                            u = other.get(w[-3:])
                            if u is None:
                                u = other[w[-3:]] = own + bucket_of(w, buckets)
                        ids.append(u)
                    ids.append(size - 1)
                line = np.array(ids, dtype=np.int64)
                table += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["pair", "n"])

    pairs = (map_batches(df.select(text_bytes(text_col).alias("text")), run, "pair bigint, n bigint")
             .groupBy("pair").agg(F.sum("n").alias("n")).toArrow())
    bigrams = np.zeros(size * size)
    bigrams[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    bigrams = bigrams.reshape(size, size)
    of = exchange(bigrams, classes)
    k = classes + 1
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    # every other word by its own contexts; those of the head have their bucket's class until then
    unknown = of[own:]
    look = np.concatenate([of[:own], np.array([unknown[bucket_of(w, buckets)] for w in words[own:]], dtype=np.int64), unknown])
    rest = assigned(contexts(df, text_col, words, look, own), member.T @ bigrams @ member, unknown)
    first = spark.createDataFrame([(w, int(r[1]), int(c)) for w, r, c in zip(words[:own], top, of, strict=False)],
                                  "word binary, n bigint, class int")
    table = staged(first.unionByName(rest), "word-classes")
    head_class = np.array([r[0] for r in table.orderBy(F.desc("n"), "word").limit(head).select("class").collect()], dtype=np.int64)
    found = staged(contexts(df, text_col, words, np.concatenate([head_class, np.full(buckets, -1), unknown[-1:]]), len(words)),
                   "class-contexts")
    moves = class_bigrams(found, table, k)
    into = moves.sum(axis=0)
    share = (into + DELTA) / (moves.sum() + DELTA * k)
    moves = (moves + PRIOR * share) / (moves.sum(axis=1, keepdims=True) + PRIOR)
    vocabulary = np.zeros(k)  # different words by class
    vocabulary[-1] = 1
    for c, n in table.groupBy("class").count().collect():
        vocabulary[c] += n
    emits = np.log10(into + DELTA * (vocabulary + 1))
    return Model(words, np.array([r[1] for r in top], dtype=np.float64), head_class, unknown, np.log10(moves), emits,
                 int(totals[0]) + ends, int(totals[1]) + (1 if ends else 0), ends), table


def score(df: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, base_score, score for every row; scores are log10 probabilities."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    floor = float(np.log10(model.tokens + DELTA * (model.words + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        get, buckets = {w: i for i, w in enumerate(m.head)}.get, len(m.unknown) - 1
        head_class, unknown = m.head_class.tolist(), m.unknown.tolist()
        log_counts = np.log10(m.counts + DELTA)
        log_end, border = float(np.log10(m.ends + DELTA)), unknown[-1]
        key = TaskContext.get().partitionId() << 40  # a number for each row; the table is written once
        for batch in batches:
            out, tail = [], []
            for _, texts in pieces(batch, "text"):
                for text in texts:
                    words = text.lower().split()
                    rest: dict[bytes, list[int]] = {}
                    path, known = [border], []
                    for w, i in zip(words, map(get, words), strict=True):
                        if i is None:
                            rest.setdefault(w, []).append(len(path))
                            path.append(unknown[bucket_of(w, buckets)])
                        else:
                            known.append(i)
                            path.append(head_class[i])
                    path.append(border)
                    seen = float(log_counts[known].sum()) + log_end if known else log_end
                    out.append((key, len(words) + 1, len(known) + (m.ends > 0), seen, np.array(path, dtype="<u2").tobytes()))
                    tail += [(key, w, len(places), np.array(places, dtype="<u4").tobytes()) for w, places in rest.items()]
                    key += 1
            own = list(zip(*out, strict=True)) or [()] * 5
            far = list(zip(*tail, strict=True)) or [()] * 4
            none, some = (None,) * len(tail), (None,) * len(out)
            yield pa.RecordBatch.from_arrays([
                pa.array(own[0] + far[0], pa.int64()),
                pa.concat_arrays([batch.column("id"), pa.nulls(len(tail), batch.schema.field("id").type)]),
                *[pa.array(own[i] + none, t) for i, t in
                  ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.binary()))],
                pa.array(some + far[1], pa.binary()), pa.array(some + far[2], pa.int64()), pa.array(some + far[3], pa.binary())],
                ["key", "id", "n_tokens", "n_known", "seen", "path", "word", "times", "places"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in batches:
            way = []
            for path, of, places in zip(*(batch.column(c) for c in ("path", "of", "places")), strict=True):
                line = np.frombuffer(path.as_py(), "<u2").astype(np.int64)
                for c, at in zip(of.as_py() or (), places.as_py() or (), strict=True):
                    line[np.frombuffer(at, "<u4")] = c
                way.append(float(m.moves[line[:-1], line[1:]].sum() - m.emits[line[1:]].sum()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "n_tokens", "n_known", "seen")], pa.array(way, pa.float64())],
                ["id", "n_tokens", "n_known", "seen", "way"])

    kind = rows.schema["id"].dataType.simpleString()
    read = staged(map_batches(rows, run, f"key bigint, id {kind}, n_tokens bigint, n_known bigint, seen double, "
                                       "path binary, word binary, times bigint, places binary"), "lm-rows")
    found = read.where("word IS NOT NULL").select("key", "word", "times", "places").join(counts, "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    of, places = (F.when(n > 0, F.col(c)) for c in ("class", "places"))
    tail = found.groupBy("key").agg(F.sum(F.col("times") * F.log10(n + F.lit(DELTA))).alias("more"),
                                    F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
                                    F.collect_list(of).alias("of"), F.collect_list(places).alias("places"))
    own = read.where("word IS NULL").drop("word", "times", "places").join(tail, "key", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce(F.col("more_known"), F.lit(0))).cast("long").alias("n_known"),
        (F.col("seen") + F.coalesce(F.col("more"), F.lit(0.0))).alias("seen"), "path", "of", "places")
    done = map_batches(own, walked, f"id {kind}, n_tokens bigint, n_known bigint, seen double, way double")
    return done.select(F.col("id").alias(id_col), "n_tokens", "n_known",
                       (F.col("seen") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
                       (F.col("seen") + F.col("way")).alias("score"))
