"""Packing tokenised documents into fixed windows by sum of squares.

Each partition packs its documents online. A document's ids are cut at window
size: full windows stand alone, and the rest, of s ids, goes to an open
window. The level array holds how many open windows are filled to each level;
s goes to the level (0: a new window) for which the sum of the squares of the
counts is smallest afterwards, so that no level piles up. At the end of a
partition the windows left open are emptied into full windows, cutting pieces
where needed, and what remains is cut into windows of powers of two, which
need no padding. Nothing is shuffled: a sequence holds documents of one
partition, and its number is made of the partition's and a counter.

Ids: those of the byte-level BPE vocabulary in a tokenizer file. A text is cut
before each run of white space that follows something else; the vocabulary's
word pattern never reaches over such a place, so that the units can be encoded
one by one and frequent ones kept in a bounded table.

Defined results: a null or empty text is the end id alone. Repeated rows are
packed again each. An empty table gives no rows. A very long text is encoded
unit by unit.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import col, map_batches, pieces

WINDOW, END = 2048, 1
#: White space as the word pattern has it, by its Unicode property.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
LINE = re.compile(f"\\x20?[^{_WS}]+")
#: Most units that a worker keeps encoded after one and after several uses, and the longest unit kept.
KEPT_NEW, KEPT_USED, KEPT_CHARS = 250_000, 500_000, 40


def _bytes_of_chars() -> dict[str, int]:
    """The byte for each character that a byte-level vocabulary is written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer file's vocabulary. In it merges are listed in the order of their ids,
    so that ids serve as ranks; ``tests`` hold the ids against those of the file's own library."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model["added_tokens"]}
    chars = _bytes_of_chars()
    ranks = {bytes(chars[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Coder:
    """Texts to ids as little-endian 32-bit numbers, the end id included."""

    def __init__(self, path: str, pattern: str) -> None:
        self.encode = load_encoding(path, pattern).encode_ordinary
        self.new: dict[str, bytes] = {}
        self.used: dict[str, bytes] = {}
        self.end, self.line = packed([END]), self.encode("\n")

    def fresh(self, units: list[str]) -> dict[str, bytes]:
        """Units encoded in one call: each on a line of its own, where line breaks are ids apart.
        Units with more white space than a space in front are encoded alone."""
        lines = [u for u in units if LINE.fullmatch(u)]
        ids = np.array(self.encode("\n".join(lines)), dtype="<u4")
        cuts = [-1, *np.flatnonzero(ids == self.line[0]).tolist(), len(ids)]
        data, out = ids.tobytes(), {}
        if len(cuts) == len(lines) + 1:
            out = {u: data[4 * a + 4:4 * b] for u, a, b in zip(lines, cuts[:-1], cuts[1:], strict=True)}
        return out | {u: packed(self.encode(u)) for u in units if u not in out}

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Encodes units not in use; a unit met again comes into use."""
        found, new = {}, self.new.get
        for u in units:
            ids = new(u)
            if ids is not None:
                found[u] = ids
                if len(self.used) < KEPT_USED:
                    self.used[u] = ids
        rest = self.fresh([u for u in units if u not in found])
        if len(self.new) + len(rest) > KEPT_NEW:
            self.new.clear()
        self.new.update((u, ids) for u, ids in rest.items() if len(u) <= KEPT_CHARS)
        return found | rest

    def ids(self, text: str) -> bytes:
        units = UNIT.findall(text)
        parts = list(map(self.used.get, units))
        at, places = -1, []
        for _ in range(parts.count(None)):
            at = parts.index(None, at + 1)
            places.append(at)
        if places:
            more = self.learn(list(dict.fromkeys([units[i] for i in places])))
            for i in places:
                parts[i] = more[units[i]]
        parts.append(self.end)
        return b"".join(parts)


class Packer:
    """Open windows by fill level; pieces are (document, start, length, crc32, document's ids)."""

    def __init__(self, first: int, window: int = WINDOW) -> None:
        self.window, self.next = window, first
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array
        self.open: dict[int, list[list]] = {}
        self.out: list[tuple] = []

    def close(self, pieces_: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces_:
            self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc: int, ids: bytes) -> None:
        total, whole = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for start in range(0, whole, self.window):
            self.close([(doc, start, ids[4 * start:4 * (start + self.window)], total)])
        if whole < total:
            self.place((doc, whole, ids[4 * whole:], total), total - whole)

    def place(self, piece: tuple, size: int) -> None:
        n, top = self.count, self.window - size
        # what each level's choice adds to the sum of squares: one window less there, one more at level + size
        cost = 1 - 2 * n[:top + 1] + 2 * n[size:self.window + 1] + 1
        cost[0] = 2 * n[size] + 1  # a new window
        cost[top] -= 2 * n[self.window] + 1  # a full window is no longer open
        cost[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        # among equals the fullest window, a new one last
        level = top - int(np.argmin(cost[::-1]))
        own = [piece]
        if level:
            own = self.open[level].pop() + own
            n[level] -= 1
        if level + size == self.window:
            self.close(own)
        else:
            self.open.setdefault(level + size, []).append(own)
            n[level + size] += 1

    def finish(self) -> None:
        """Empties the open windows into full ones; the last is cut into powers of two."""
        left = [p for level in sorted(self.open, reverse=True) for own in self.open[level] for p in own]
        room, total = [], sum(len(p[2]) // 4 for p in left)
        room = [self.window] * (total // self.window)
        room += [1 << b for b in reversed(range(self.window.bit_length())) if total % self.window >> b & 1]
        self.open, own, free, at = {}, [], 0, 0
        self.count[:] = 0
        for doc, start, ids, whole in left:
            while ids:
                if not free:
                    free, at = room[at], at + 1
                take = min(free, len(ids) // 4)
                own.append((doc, start, ids[:4 * take], whole))
                ids, start, free = ids[4 * take:], start + take, free - take
                if not free:
                    self.close(own)
                    own = []

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(df: DataFrame, tokenizer: str, pattern: str, text_col: str = "text", id_col: str = "doc_id",
         window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = df.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, id_type = Coder(tokenizer, pattern), None
        packer = Packer(TaskContext.get().partitionId() << 36, window)

        def written() -> pa.RecordBatch:
            cols = list(zip(*packer.taken(), strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:]], ["id", *names])

        for batch in batches:
            id_type = batch.schema.field("id").type
            ids = batch.column("id").to_pylist()
            for start, texts in pieces(batch, "text"):
                for i, text in enumerate(texts, start):
                    packer.add(ids[i], coder.ids(text or ""))
            yield written()
        packer.finish()
        if packer.out:
            yield written()

    return map_batches(rows, run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
