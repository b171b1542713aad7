"""Exact deduplication: a tree merge of sorted digest runs.

Every row gets a digest of its normalised text, and a slot from its id. The
slots exchange their runs in rounds: written in base ``fan_in``, a slot number
of ``rounds`` digits takes over one digit of the digest's home slot in each
round, so ``fan_in`` sorted runs meet and are merged at every level, and after
the last round a digest is in its home slot alone. A merge is an aggregation by
(slot, digest), for which Spark sorts the runs that meet; it keeps, for each
digest, the smallest identifier and the number of rows. Rows are merged only
if digest, byte length and a second, independent 64-bit hash of the text all
agree. The result then travels the same tree downwards: a level's rows join
their parents' by (slot, digest), so no join ever brings more than a share of
one group together: a group with a third of all rows is dealt over
``fan_in ** (rounds - 1)`` slots where rows are joined, and is merged before
every exchange. DataFrame operations only.

Defined results: a null text counts as empty. Null ids come last: they are
kept only where a group has no other id. Of rows that repeat both id and text,
all are returned and exactly one can be kept. An empty table gives no rows;
columns other than id and text are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import col, sized, staged, text_bytes

#: A run of the six ASCII blanks that is not already one space.
BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(col(text_col).cast("string"), F.lit("")), BLANKS, " ")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and key of each row; the key is digest, byte length and a second hash."""
    norm = normalised(text_col)
    return df.select(col(id_col).alias("id"), F.struct(
        F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"),
        F.octet_length(norm).alias("size"), F.xxhash64(norm).alias("check")).alias("key"))


def smallest_by_key(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """rows(id, key struct with a long ``check``) with keep_id, group_size and
    ``first``, true for one row of each group, by the tree merge."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rounds = max(2, math.ceil(math.log(parts, fan_in)))
    slots = fan_in ** rounds
    home = F.pmod(F.col("key.check"), F.lit(slots))

    def moved(slot: Column, r: int) -> Column:
        """The slot after round r: its r low digits are those of the home slot."""
        unit = F.lit(fan_in ** r)
        return (F.floor(slot / unit) * unit + home % unit).cast("long")

    dealt = rows.withColumn("slot", moved(F.pmod(F.xxhash64("id"), F.lit(slots)), 1))
    # nulls last: (true, null) is larger than (false, id)
    level = dealt.select("slot", "key", F.struct(F.col("id").isNull().alias("none"), "id").alias("best"),
                         F.lit(1).cast("long").alias("n"))
    levels = []
    for r in range(1, rounds + 1):
        if r > 1:
            level = level.withColumn("slot", moved(F.col("slot"), r))
        level = level.groupBy("slot", "key").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        levels.append(level)
    down = levels[-1].select("slot", "key", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
    for r in range(rounds - 1, 0, -1):
        own = levels[r - 1].select(F.col("slot").alias("own"), "key", moved(F.col("slot"), r + 1).alias("slot"))
        down = own.join(down, ["slot", "key"]).select(F.col("own").alias("slot"), "key", "keep_id", "group_size")
    same = Window.partitionBy("slot", "key", "id").orderBy("id")
    return (dealt.join(down, ["slot", "key"])
            .withColumn("first", F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1))
            .select("id", "key", "keep_id", "group_size", "first"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256."""
    rows = staged(digests(df, id_col, text_col), "digests")  # texts are read and hashed once
    return smallest_by_key(rows, fan_in).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("first").alias("kept"),
        F.lower(F.hex("key.digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """The rows of ``df`` that stay, one of each group, with all their columns."""
    found = staged(exact_dedup(df, id_col, text_col, fan_in).filter(~F.col("kept")).select(
        F.col(id_col).alias("__drop_id"), F.unhex("text_sha256").alias("__drop_digest"),
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("__twin")), "dropped")
    own = df.withColumn("__digest", F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)))
    same = col(id_col).eqNullSafe(F.col("__drop_id")) & (F.col("__digest") == F.col("__drop_digest"))
    kept = own.join(sized(found.filter(~F.col("__twin"))), same, "left_anti")
    twins = found.filter("__twin").dropDuplicates(["__drop_id", "__drop_digest"])
    if not twins.isEmpty():  # rows that repeat both id and text: one of them stays
        twins = sized(staged(twins, "twins"))
        one = kept.join(twins, same, "left_semi").dropDuplicates([id_col, "__digest"])
        kept = kept.join(twins, same, "left_anti").unionByName(one)
    return kept.drop("__digest")
