"""Packs documents into sequences of a fixed length by the sum-of-squares rule.

N(g) is the number of open sequences with g free tokens. Each piece goes into the open sequence for which the sum of
N(g)**2 over all gaps becomes smallest (N(g) falls, N(g - length) rises); a new one is opened only where none has room,
which saves sequences against opening one whenever that keeps the sum lower. Large pieces come first.
A document longer than a sequence is cut: all pieces but the first are full and need no search.

Tokens never shuffle: a task that reads a text emits one small row a piece. Pieces are dealt to shards by a hash of what they are
and where they lie in the written table, so that a hot source, a group of copies or rows that are alike in everything spread evenly; the pieces of each shard's worst-filled sequences then meet in
fewer shards, round after round, until one shard takes the rest.

Defined cases: a null or empty text is one piece that holds the closing id alone; repeated rows are packed once each;
ties between pieces are broken by id and piece; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import tokens
from cadenza.llm._common import stage, table

SHARD_SEQUENCES = 1 << 20  # numbers that a shard has for its sequences

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all are full but the first."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """One row a piece, without its ids; ids_crc32 is over the ids as unsigned 32-bit little-endian numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*tokens.ids(body.as_py() or "", vocabulary), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), size)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the order given."""
    open_at: list[list[int]] = [[] for _ in range(size + 1)]  # sequences by free tokens
    count = np.zeros(size + 1, dtype=np.int64)  # N(g); a full sequence counts nothing
    where, offset, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    never = np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        # the change of the sum: 2 (N(g - n) - N(g) + 1), or 1 - 2 N(g) where the sequence becomes full
        change = 2 * (count[: size - n + 1] - count[n:] + 1)
        change[0] -= 1
        change[count[n:] == 0] = never
        k = int(change.argmin())
        if change[k] != never:
            gap = k + n
            at = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, at, made = size, made, made + 1
        where[i], offset[i], left = at, size - gap, gap - n
        if left:
            open_at[left].append(at)
            count[left] += 1
    return where, offset


def _place(rows: DataFrame, shards: int, size: int, round_no: int) -> DataFrame:
    """rows with sequence_id, offset and the sequence's fill; each shard's pieces are placed from the longest down."""

    def one(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = part["length"].to_numpy()
        where, offset = sum_of_squares(length, size)
        fill = np.bincount(where, length).astype(np.int64)[where]
        if len(where) and where.max() >= SHARD_SEQUENCES or fill.max(initial=0) > size:
            raise ValueError("a shard has more sequences than numbers, or a sequence more tokens than it holds")
        base = (round_no << 58) + part["shard"][0].as_py() * SHARD_SEQUENCES
        return part.drop_columns(["shard"]).append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    # rows is a written table, so a row's number is the same whenever a task runs again
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_no), F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    return rows.select("*", shard).groupBy("shard").applyInArrow(one, f"{PIECES}, sequence_id long, offset long, fill long")


def pack(cut: DataFrame, size: int = 2048, shard_rows: int = 4096, loose: float = 0.98) -> DataFrame:
    """Places the rows of pieces(): adds sequence_id and offset.

    A shard has about shard_rows pieces, whatever the input, so a task's memory is bounded. Sequences filled
    below ``loose``, or below what half of the pieces reach where that is less, are opened again and their pieces meet in a later
    round with fewer shards: at least half of the pieces are settled in each round, so that one shard takes the last ones.
    """
    rows, done, round_no = stage(cut, "pieces"), [], 0
    while True:
        shards = max(1, rows.count() // shard_rows)
        placed = stage(_place(rows, shards, size, round_no), "placed")
        if shards == 1:
            done.append(placed)
            break
        middle = placed.agg(F.percentile_approx("fill", 0.5)).first()[0]
        tight = F.col("fill") >= min(int(loose * size), middle)
        done.append(placed.filter(tight))
        rows, round_no = placed.filter(~tight).drop("sequence_id", "offset", "fill"), round_no + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("fill")


def op3_best_fit_packing(spark, sf_dir):
    return pack(pieces(table(spark, sf_dir, "documents")))
