"""Exact deduplication by distributed MSD radix partitioning.

Rows are split by successive runs of bytes of their normalised text until a group holds one row (unique) or
its texts have ended (equal). Nothing is hashed to decide equality. The run at level 0 has ``FIRST`` bytes and
each later one is three times what came before it, so a text of n bytes takes log4(n / FIRST) levels, and every
byte of a text that still has company is compared exactly once; a text that is alone is never read further.

Whole texts are never shuffled, only runs of those with company: which first runs occur twice goes to the tasks as a bounded filter of their hashes, and the
runs of the rows that it lets through are written where the text is read. A row that it lets through for nothing is
alone at level 0.

One level is a groupBy on (group, run) with partial aggregation, so a group that holds a third of all rows sends
one row per task, and a join of the group's new label to its rows, which adaptive execution splits when skewed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import BLANKS, rows_of, table, written, written_alone

FIRST = 64
#: Code points from which the first run is taken, where they hold enough that isn't white space.
HEAD_CHARS = 512
#: Bits for each first run that occurs twice, and in all at most (8 MB), of the filter of their hashes. It only saves
#: work: beyond that size more rows have their runs written, and level 0 drops them.
SHARED_BITS, MOST_SHARED_BITS = 16, 1 << 26


def normalized(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _start(level: Column | int):
    """Bytes before the run of this level, from 1 on."""
    return F.lit(FIRST).cast("long") * F.pow(F.lit(4), level - 1).cast("long") if isinstance(level, Column) else FIRST * 4 ** (level - 1)


def _head(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    short = normalized(F.substring(text, 1, HEAD_CHARS)).cast("binary")
    enough = (F.octet_length(short) >= FIRST) | (F.char_length(text) <= HEAD_CHARS)
    return F.substring(F.when(enough, short).otherwise(normalized(text).cast("binary")), 1, FIRST)


def _bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap (null: empty) has the bit at a position set."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def _shared_heads(rows: DataFrame) -> tuple[int, DataFrame]:
    """Rows (page, bits): a filter of so many bits of the hashes of heads that occur twice or more."""
    hashes = rows.select(F.xxhash64("head").alias("hash")).groupBy("hash").count().where("count > 1").select("hash")
    hashes = written(hashes, "radix-heads")
    bits = min(MOST_SHARED_BITS, 1 << max(15, (SHARED_BITS * hashes.count()).bit_length()))
    place = F.pmod("hash", F.lit(bits))
    places = hashes.select(F.bitmap_bucket_number(place).alias("page"), F.bitmap_bit_position(place).alias("position"))
    return bits, places.groupBy("page").agg(F.bitmap_construct_agg("position").alias("bits"))


def text_key(text: Column) -> Column:
    """SHA-256 of a text as it is written; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after their white space is deleted; a null text is empty, and all
    empty texts are one group. The row with the most code points in its own text stays, then the smallest
    doc_id (null last). Rows that repeat a doc_id are rows of their own: exactly one row of a group stays.
    Other columns are not read, whatever their names. An empty table gives no rows. keyed: also text_key, of the row's
    text.
    """
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    rows = docs.select(*own).withColumn("head", _head(F.col("text")))
    bits, pages = _shared_heads(rows)
    place = F.pmod(F.xxhash64("head"), F.lit(bits))
    norm = normalized(F.col("text"))
    levels = F.filter(F.sequence(F.lit(1), F.lit(20)), lambda n: _start(n) <= F.octet_length("bytes"))
    runs = F.transform(levels, lambda n: F.struct(n.alias("level"), F.substring(F.col("bytes"), (_start(n) + 1).cast("int"), (3 * _start(n)).cast("int")).alias("run")))
    own = F.array(F.struct(F.lit(0).alias("level"), F.col("head").alias("run")))
    hashes = ["text_sha256", *(["text_key"] if keyed else [])]
    table_0 = (
        rows.join(F.broadcast(pages), F.bitmap_bucket_number(place) == F.col("page"), "left")
        .select("doc_id", "head", _bit(F.col("bits"), F.bitmap_bit_position(place)).alias("company"), F.monotonically_increasing_id().alias("rid"), F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), norm.alias("norm"), *([text_key(F.col("text")).alias("text_key")] if keyed else []))
        .withColumn("bytes", F.col("norm").cast("binary"))
        .withColumn("text_sha256", F.sha2("bytes", 256))
        .withColumn("piece", F.explode(F.concat(own, F.when(F.col("company"), runs).otherwise(F.slice(own, 1, 0)))))
        .select("rid", F.when(F.col("piece.level") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("piece.level") == 0, F.col("chars")).alias("chars"),
                *(F.when(F.col("piece.level") == 0, F.col(c)).alias(c) for c in hashes), "company", F.col("piece.run").alias("run"), F.col("piece.level").alias("level"))
    )
    pieces = written(table_0, "radix-runs", "level")
    members, level = [], 0
    active = pieces.where("level = 0 and company").select("rid", F.lit(0).cast("long").alias("gid"))
    while True:
        width = FIRST if level == 0 else 3 * _start(level)
        # merged at every size: what is shuffled then grows as the input does
        here = active.hint("merge").join(pieces.where(F.col("level") == level).select("rid", "run"), "rid")
        # written like company: the rows of a hot run are then dealt by a plain shuffle, which can be split
        split = written(here.groupBy("gid", "run").agg(F.count("*").alias("n"), F.min("rid").alias("new")).where("n > 1").drop("n"), f"radix-split-{level}")
        found = written(here.join(split.hint("merge"), ["gid", "run"]).select("rid", F.col("new").alias("gid"), (F.octet_length("run") < width).alias("ended")), f"radix-{level}")
        members.append(found.where("ended").select("rid", "gid"))
        active, level = found.where("not ended").select("rid", "gid"), level + 1
        if active.isEmpty():
            break
    info = pieces.where("level = 0").select("rid", "doc_id", "chars", *hashes)
    grouped = reduce(DataFrame.unionByName, members)
    # the largest text, then the smallest id: ~id falls as id grows and cannot overflow, and a null is least of all
    order = F.struct(F.col("chars"), F.bitwise_not("doc_id"), F.bitwise_not("rid"))
    best = written(grouped.hint("merge").join(info, "rid").groupBy("gid").agg(F.max_by(F.struct("doc_id", "rid"), order).alias("best"), F.count("*").alias("group_size")), "radix-best")
    return (
        info.join(grouped.join(best.hint("merge"), "gid").hint("merge"), "rid", "left")
        .select("doc_id", F.when(F.col("gid").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)).alias("kept"), *hashes)
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns: of each group of equal texts the one that exact_groups keeps.

    Null and empty texts are one group, of which one row stays; of rows that repeat id and text, one. Columns of any name are carried
    along unread. What stays on disk is the id and the hash of the text of each row that stays. An empty table gives no rows.
    """
    key = [F.col("doc_id").alias("id"), F.col("text_key").alias("key")]
    kept = written_alone(docs.sparkSession, "radix-kept", lambda: exact_groups(docs, keyed=True).where("kept").select(*key))
    return rows_of(docs, kept, text_key, "radix-repeated")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
