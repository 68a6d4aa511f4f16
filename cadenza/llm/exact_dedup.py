"""Exact duplicates behind a two-pass Bloom filter, with DataFrame functions only.

Pass one hashes every digest into a slot space and sets a bit for each slot that two or more rows hit; rows that hit such a slot are hashed
anew, into a second space that only they fill. The two bitmaps are a Bloom filter of the hashes seen at least twice. Pass two probes
every row: a row that misses a bit has no equal and passes straight through; only the others shuffle and meet exactly.

The slot space follows the input, 16 slots a row, so that the filter stays as sharp at any size, and is kept as bitmaps of 2**15 slots. While all of them
are ``max_bits`` bits (2**27, 16 MB) at most they are broadcast. A larger space meets the digests by number of the bitmap, in an equi-join of two written
tables: the plan and the number of jobs are the same for any input, and what shuffles is digests with ids and sizes, never a text. Pass one
shuffles a slot number a distinct digest and task.

Defined cases: a null text counts as empty; equal texts are those identical after the deletion of
ASCII white space (0x20, 0x09-0x0D); of equal rows the longest original text stays, then the smallest id, a null
id last; of rows equal in id and text as well, one stays. An empty table gives an empty result. Extra
columns are carried untouched, inside one struct, so that no name can clash with a working column's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm._common import stage, table

WHITE = " \t\n\x0b\x0c\r"
KEY, SIZE, ID, TEXT = "__xd_key", "__xd_size", "__xd_id", "__xd_text"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the digest of the normalised text and the code points of the original."""
    return docs.withColumns({
        KEY: F.unhex(F.sha2(normalised(F.col(text)), 256)),
        SIZE: F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
    })


def _slot(k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), F.col(KEY)), F.lit(bits)) + 1


def _bits_for(rows: int, max_bits: int | None = None) -> int:
    bits = 1 << 15
    while bits < (16 * rows if max_bits is None else min(16 * rows, max_bits)):
        bits *= 2
    return bits


def bitmap(keys: DataFrame, k: int, bits: int, least: int) -> DataFrame:
    """The bitmaps, by bucket, of the slots of hash function k that at least ``least`` rows hit."""
    hit = keys.groupBy(_slot(k, bits).alias("slot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    found = hit.groupBy(F.bitmap_bucket_number("slot").alias("__xd_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__xd_map"))
    return stage(found, "bitmap")


def probe(rows: DataFrame, k: int, bits: int, found: DataFrame, small: bool = True) -> DataFrame:
    """rows with __xd_maybe: whether the bit of hash function k, and those of the functions before it, are set."""
    at = f"__xd_at{k}"
    rows = rows.withColumns({"__xd_bucket": F.bitmap_bucket_number(_slot(k, bits)), at: F.bitmap_bit_position(_slot(k, bits))})
    rows = rows.join(F.broadcast(found) if small else found, "__xd_bucket", "left")
    byte = F.conv(F.hex(F.expr(f"substring(__xd_map, cast({at} div 8 as int) + 1, 1)")), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("__xd_maybe", hit if k == 0 else F.col("__xd_maybe") & hit).drop("__xd_bucket", "__xd_map", at)


def possible_repeats(keys: DataFrame, max_bits: int) -> DataFrame:
    """keys (staged) with __xd_maybe."""
    bits = _bits_for(keys.count())
    small = bits <= max_bits
    probed = probe(keys, 0, bits, bitmap(keys, 0, bits, 2), small)
    probed = probed if small else stage(probed, "probed-once")
    again = bitmap(probed.filter("__xd_maybe"), 1, bits, 2)
    return stage(probe(probed, 1, bits, again, small), "probed")


def _winners(maybe: DataFrame, id_col: str) -> DataFrame:
    """For each digest the row that stays and the group's size; one row a task and digest leaves the map side."""
    best = F.struct((-F.col(SIZE)).alias("size"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    return maybe.groupBy(KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("__xd_group")).select(KEY, "__xd_group", F.col("best.id").alias("__xd_keep"), (-F.col("best.size")).alias("__xd_keep_size"))


def _keys(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return stage(digests(docs.select(F.col(id_col).alias(ID), F.col(text).alias(TEXT)), TEXT).select(ID, KEY, SIZE), "digests")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = 1 << 27) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    The texts are read once; only ids, digests and sizes are staged, and only those of possible repeats shuffle.
    """
    probed = possible_repeats(_keys(docs, id_col, text), max_bits)
    maybe = probed.filter("__xd_maybe")
    # rows alike in id and text become one with a count: one of them stays
    alike = maybe.groupBy(KEY, SIZE, ID).agg(F.count(F.lit(1)).alias("__xd_alike"))
    won = stage(_winners(maybe, ID), "winners")
    wins = F.col(ID).eqNullSafe(F.col("__xd_keep")) & (F.col(SIZE) == F.col("__xd_keep_size"))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), "__xd_alike")).alias("__xd_nth")
    grouped = alike.join(won, KEY).select(ID, KEY, F.col("__xd_keep").alias("keep_id"), F.col("__xd_group").alias("group_size"), wins.alias("__xd_wins"), nth)
    named, digest = F.col(ID).alias(id_col), F.lower(F.hex(KEY)).alias("text_sha256")
    alone = probed.filter("NOT __xd_maybe").select(named, F.col(ID).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    return alone.unionByName(grouped.select(named, "keep_id", "group_size", (F.col("__xd_wins") & (F.col("__xd_nth") == 1)).alias("kept"), digest))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = 1 << 27, hot_groups: int = 10_000) -> DataFrame:
    """The rows of docs that stay, with docs' columns.

    The digests of groups of two rows or more make a filter of their own, and a row that misses it never shuffles. The winners of the hot_groups largest
    groups are broadcast (a row a group), so that their rows, be they a third of all, are judged where they are; the others meet their
    winners by digest.
    """
    maybe = possible_repeats(_keys(docs, id_col, text), max_bits).filter("__xd_maybe")
    won = stage(_winners(maybe, ID).filter("__xd_group > 1"), "winners")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__xd_doc")
    rows = digests(docs.select(whole, F.col(id_col).alias(ID), F.col(text).alias(TEXT)), TEXT).drop(TEXT)
    bits = _bits_for(won.count(), max_bits)
    for k in (0, 1):
        rows = probe(rows, k, bits, bitmap(won, k, bits, 1))
    # a row of a group stays if it is the winner; a row without a group that the filter holds for stays as well
    wins = F.col(ID).eqNullSafe(F.col("__xd_keep")) & (F.col(SIZE) == F.col("__xd_keep_size"))
    won = won.withColumnRenamed(KEY, "__xd_won")
    hot = stage(won.orderBy(F.desc("__xd_group"), "__xd_won").limit(hot_groups), "hot")
    near = rows.filter("__xd_maybe").join(F.broadcast(hot), F.col(KEY) == F.col("__xd_won"), "left")
    first = near.filter(F.col("__xd_won").isNotNull() & wins).select("__xd_doc", KEY, ID)
    far = near.filter("__xd_won IS NULL").select("__xd_doc", KEY, SIZE, ID).join(won, F.col(KEY) == F.col("__xd_won"), "left")
    stay = first.unionByName(far.filter(F.col("__xd_won").isNull() | wins).select("__xd_doc", KEY, ID)).dropDuplicates([KEY, ID])
    return rows.filter("NOT __xd_maybe").select("__xd_doc.*").unionByName(stay.select("__xd_doc.*"))


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", max_bits: int = 1 << 27) -> DataFrame:
    """The rows of docs whose id is not in the one column of gone: rows that miss its Bloom filter never shuffle."""
    gone = stage(gone.toDF(KEY).distinct(), "gone")
    bits = _bits_for(gone.count(), max_bits)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__xd_doc")
    rows = docs.select(whole, F.col(id_col).alias(KEY))
    for k in (0, 1):
        rows = probe(rows, k, bits, bitmap(gone, k, bits, 1))
    left = rows.filter("__xd_maybe").join(gone.withColumnRenamed(KEY, "__xd_gone"), F.col(KEY).eqNullSafe(F.col("__xd_gone")), "left_anti")
    return rows.filter("NOT __xd_maybe").unionByName(left).select("__xd_doc.*")


def op9_exact_dedup(spark, sf_dir):
    return duplicate_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents),
h AS (SELECT doc_id, n, sha256(t) AS text_sha256 FROM d),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
