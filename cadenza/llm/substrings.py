"""Exact removal of repeated byte strings by suffix arrays of small blocks.

A window is a byte string of ``length`` (200) within one document; each byte that a window covers goes if an equal window starts
anywhere else. All windows of all documents are judged; what brings equal windows together is local to their contents:

1. segments: a window's anchor is its leftmost smallest hash of 32 bytes. A run of windows with the same anchor is a segment,
   at most 169 windows; its key is the anchor's hash. Equal windows have equal keys.
2. counts, over the corpus, of equal segments by key: segments that occur twice are repeated as a whole; a key with one
   segment is done with. What is left are keys with different segments, around edits and the ends of passages. These are
   cut into pieces of at most 32 windows that share 169 bytes, a sharper key, and counted once more.
3. blocks: the different pieces of a key, each once, are joined by separators, and a suffix array (gsaca.py) of each block
   puts equal windows side by side: neighbours are compared byte by byte.
4. a key with more than ``block_segments`` different pieces (a large group of near copies) is cut again: each different piece into
   halves of 16 windows that share 185 bytes, which give sharper keys; equal halves are collapsed, and keys that are small
   enough become blocks. What is still large is halved again, down to one window at most, whose key has one piece only. Each
   round works on the different pieces of large keys alone, so no block outgrows a task, and nothing is dropped or capped.
5. the repeated ranges of a text are united, and the text is read again to take them out.

Shuffles carry keys and hashes, one row for about 85 bytes, and the bytes of undecided segments; texts are joined to their ranges
only where a Bloom filter says that they may have some. Filters hold ``filter_bits`` bits at most whatever the input; when they fill up more is
shuffled, and the result stays the same. Hashes of segments are 128 bits in all (key and contents), those of texts MD5.

Defined cases: a null text is empty; texts under 200 bytes lose nothing; repeated rows are other occurrences, so both lose what they share;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from cadenza.llm._common import partitions, stage, table
from cadenza.llm.gsaca import suffix_arrays

GRAM = 32
FINE = 32  # windows of a piece
CHUNK = 1 << 18  # bytes of text hashed at a time: about 60 times as much memory at the peak
A, B, C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each position."""
    h, s = (raw.astype(np.uint64) + np.uint64(1)) * C, 1
    while s < size:
        h = h[:-s] * A + h[s:] * B
        h ^= h >> np.uint64(29)
        s *= 2
    return h


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    span = 1
    while span < width:
        shift = min(span, width - span)
        h = np.minimum(h[:-shift], h[shift:])
        span += shift
    return h


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + size."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)


class Segments:
    """Runs of windows with the same anchor, of texts that lie side by side: start, n, anchor, doc and the anchor's hash."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, length: int = 200) -> None:
        self.length, self.raw, self.bounds, width = length, raw, bounds, length - GRAM + 1
        sizes = np.maximum(np.diff(bounds) - length + 1, 0)
        start = spread(bounds[:-1], sizes)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if len(start):
            h = gram_hashes(raw, GRAM)
            doc, least = np.repeat(np.arange(len(sizes)), sizes), least_of(h, width)[start]
            new = np.ones(len(start), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            s, n, d, value = start[at], np.diff(np.append(at, len(start))), doc[at], least[at]
            views = np.lib.stride_tricks.sliding_window_view(h, width)
            while len(s):  # the leftmost place of the least hash; where an equal one takes over, a segment ends
                anchor = s + np.argmax(views[s] == value[:, None], axis=1)
                take = np.minimum(n, anchor - s + 1)
                for column, part in zip(found, (s, take, anchor, d)):
                    column.append(part)
                more = n > take
                s, n, d, value = (s + take)[more], (n - take)[more], d[more], value[more]
            self.hash = h
        self.start, self.n, self.anchor, self.doc = map(np.concatenate, found)
        self.key = self.hash[self.anchor] if len(start) else np.zeros(0, np.uint64)

    def _named(self, key, start, n, doc) -> dict[str, np.ndarray]:
        """Segments with the hash of their bytes."""
        body = memoryview(np.ascontiguousarray(self.raw))
        reach = self.length - 1
        seg = [xxh3_64_intdigest(body[s:e]) for s, e in zip(start.tolist(), (start + n + reach).tolist())]
        return {"key": key, "seg": np.array(seg, dtype=np.uint64), "doc": doc, "start": start - self.bounds[doc], "n": n, "own": np.ones(len(key), bool)}

    def pieces(self, open_keys) -> tuple[np.ndarray, ...]:
        """(key, start, n, doc, segment, lead) of the segments of open keys, cut where a window's distance to its anchor is a multiple of FINE; the
        key is the hash of the bytes that all windows at these distances share, which start ``lead`` bytes after the piece."""
        keep = np.flatnonzero(open_keys(self.key))
        start, n, anchor, doc, key = self.start[keep], self.n[keep], self.anchor[keep], self.doc[keep], self.key[keep]
        low, high = (anchor - start - n + 1) // FINE, (anchor - start) // FINE
        count = high - low + 1
        piece = spread(low, count)
        start, n, anchor, doc, key, keep = (np.repeat(x, count) for x in (start, n, anchor, doc, key, keep))
        core = anchor - FINE * piece
        first = np.maximum(start, core - FINE + 1)
        n = np.minimum(start + n, core + 1) - first
        body, share = memoryview(np.ascontiguousarray(self.raw)), self.length - FINE + 1
        seeds = (key + piece.astype(np.uint64) * C).tolist()
        fine = np.array([xxh3_64_intdigest(body[c : c + share], seed) for c, seed in zip(core.tolist(), seeds)], dtype=np.uint64)
        return fine, first, n, doc, keep, core - first

    def level(self, level: int, tests: list) -> dict[str, np.ndarray]:
        """0: all segments; 1: pieces of keys that pass tests[0], own where tests[1] takes their segment for one that occurs once."""
        if not level:
            return self._named(self.key, self.start, self.n, self.doc)
        key, start, n, doc, segment, _ = self.pieces(tests[0])
        out = self._named(key, start, n, doc)
        asked = np.unique(segment)
        once = np.zeros(len(self.key), dtype=bool)
        once[asked] = tests[1](self._named(self.key[asked], self.start[asked], self.n[asked], self.doc[asked])["seg"])
        return out | {"own": once[segment]}


class Slice:
    """Some texts side by side, or a part of a long one, with the MD5 of each whole text."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, base: int, names: list[bytes]) -> None:
        self.raw, self.bounds, self.base, self.names = raw, bounds, base, names


def _slices(batch: pa.RecordBatch, length: int) -> Iterator[Slice]:
    """Slices of about CHUNK bytes of a batch's first column. A longer text comes in parts that overlap by length - 1 bytes: each
    window is in one of them, and segments cut at a part's end differ from others' only in extent."""
    column = batch.column(0).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = min(len(column), max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK)) - 1))
        raw, bounds = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        body = memoryview(raw)
        names = [hashlib.md5(body[s:e]).digest() if e - s >= length else b"" for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        if len(raw) <= 2 * CHUNK:
            yield Slice(raw, bounds, 0, names)
        else:  # one long text
            for base in range(0, len(raw) - length + 1, CHUNK):
                part = raw[base : base + CHUNK + length - 1]
                yield Slice(part, np.array([0, len(part)]), base, names)
        row = end


NAMES = ["key", "seg", "doc", "start", "n", "own"]
SEGMENTS = "key long, seg long, doc binary, start int, n int, own boolean"


def _filter(spark, bitmaps: bytes | None, bits: int):
    """A test of keys (unsigned 64-bit) against a broadcast bitmap."""
    shared = spark.sparkContext.broadcast(bitmaps)

    def test(key: np.ndarray) -> np.ndarray:
        if shared.value is None:
            return np.zeros(len(key), dtype=bool)
        slot = (key & np.uint64(bits - 1)).astype(np.int64)
        return (np.frombuffer(shared.value, dtype=np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    return test


def key_filter(keys: DataFrame, filter_bits: int):
    """A test for keys(key): may hold for others, holds for all of them. Its size depends on their number up to filter_bits."""
    n, bits = keys.count(), 1 << 15
    while bits < min(64 * n, filter_bits):
        bits *= 2
    return _bitmap(keys, bits)


def _bitmap(keys: DataFrame, bits: int):
    slot = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("map")).collect()
    whole = bytearray(bits // 8)
    for r in rows:
        whole[(r["at"] - 1) * 4096 : r["at"] * 4096] = r["map"]
    return _filter(keys.sparkSession, bytes(whole), bits)


def _columns(part: Slice, found: dict[str, np.ndarray]) -> list[pa.Array]:
    digest = pa.array([part.names[d] for d in found["doc"].tolist()], pa.binary())
    start = pa.array((found["start"] + part.base).astype(np.int32))
    return [pa.array(found["key"].view(np.int64)), pa.array(found["seg"].view(np.int64)), digest, start, pa.array(found["n"].astype(np.int32)), pa.array(found["own"])]


def segments(docs: DataFrame, level: int, tests: list, length: int, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, length):
                yield pa.RecordBatch.from_arrays(_columns(part, Segments(part.raw, part.bounds, length).level(level, tests)), NAMES)

    return docs.select(text).mapInArrow(run, SEGMENTS)


def undecided(docs: DataFrame, tests: list, length: int, text: str) -> DataFrame:
    """Pieces of keys that pass tests[0] whose own keys pass tests[1], with their bytes and the place of the shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, length):
                whole = Segments(part.raw, part.bounds, length)
                key, start, n, doc, _, lead = whole.pieces(tests[0])
                keep = tests[1](key)
                found = whole._named(key[keep], start[keep], n[keep], doc[keep])
                piece = [part.raw[s : s + k + length - 1].tobytes() for s, k in zip(start[keep].tolist(), n[keep].tolist())]
                yield pa.RecordBatch.from_arrays([*_columns(part, found), pa.array(lead[keep].astype(np.int32)), pa.array(piece, pa.binary())], [*NAMES, "lead", "piece"])

    return docs.select(text).mapInArrow(run, SEGMENTS + ", lead int, piece binary")


HALVES = "key long, seg long, doc binary, start int, n int, lead int, once boolean, piece binary"


def halved(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """The pieces (key, doc, start, lead, once, piece) of at most ``width`` windows, cut in two: the windows at a distance of half a width or more from
    the shared bytes, and the others. The new key is the hash of what all windows of a half share."""
    half = width // 2
    share = length - half + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, doc, start, lead, once, piece in zip(*(c.to_pylist() for c in batch.columns)):
                n, cut_at = len(piece) - length + 1, max(0, lead - half + 1)
                for side, first, end in ((1, 0, min(cut_at, n)), (0, cut_at, n)):
                    if first < end:
                        core = lead - half * side
                        named = xxh3_64_intdigest(piece[core : core + share], (key + side) & 0xFFFFFFFFFFFFFFFF)
                        body = piece[first : end + length - 1]
                        out.append((named, xxh3_64_intdigest(body), doc, start + first, end - first, core - first, once, body))
            columns = list(zip(*out)) or [()] * 8
            signed = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in columns[:2]]
            types = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([*signed, *(pa.array(c, t) for c, t in zip(columns[2:], types))], [c.split()[0] for c in HALVES.split(", ")])

    return pieces.select("key", "doc", "start", "lead", "once", "piece").mapInArrow(run, HALVES)


def _different(rows: DataFrame) -> DataFrame:
    """Each different piece of a key once, with once where this is its only row and no other had one before."""
    one = F.first(F.struct("doc", "start", "lead", "piece")).alias("one")
    return rows.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("times"), F.min("once").alias("once"), one).select("key", "seg", "one.*", ((F.col("times") == 1) & F.col("once")).alias("once"))


def _kinds(different: DataFrame) -> DataFrame:
    """(key, kinds) of the keys with two different pieces or more of which one occurs once: others are settled."""
    return different.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("once").alias("some")).filter("kinds > 1 AND some").select("key", "kinds")


def settle_open(rows: DataFrame, open_keys: DataFrame, length: int, block_segments: int) -> list[DataFrame]:
    """Ranges of repeated windows among the pieces of open keys, by blocks; pieces of larger keys are halved until they fit."""
    ranges, width = [], FINE
    different = stage(_different(rows), "different")
    while True:
        last = width == 1
        small = open_keys if last else open_keys.filter(F.col("kinds") <= block_segments)
        ranges.append(settle(different.join(small.select("key"), "key", "left_semi"), length))
        large = open_keys.filter(F.col("kinds") > block_segments)
        if last or large.isEmpty():
            return ranges
        halves = stage(halved(different.join(large.select("key"), "key", "left_semi"), width, length), "halves")
        width //= 2
        different = stage(_different(halves), "different")
        # halves that occur elsewhere too are repeated as a whole; the rest of the open keys goes on
        again = different.filter("NOT once").select("key", "seg")
        ranges.append(halves.filter("once").select("key", "seg", "doc", "start", "n").join(again, ["key", "seg"], "left_semi").select("doc", "start", "n"))
        open_keys = stage(_kinds(different), "open")


def repeated_in_blocks(pieces: list[bytes], block: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of the pieces, in order, equals another of the same block. block: non-decreasing, one a piece."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    raw = np.frombuffer(b"\0".join(pieces) + bytes(9), dtype=np.uint8)
    symbols = raw[: ends[-1]].astype(np.int32)
    last = np.append(block[1:] != block[:-1], True)
    first = np.append(0, np.flatnonzero(last)[:-1] + 1)
    rank = np.arange(len(pieces)) - np.repeat(first, np.diff(np.append(first, len(pieces))))
    symbols += len(pieces) + 1
    symbols[ends - 1] = np.where(last, 0, rank + 1)  # separators differ within a block; the closing one is the smallest
    bounds = np.append(0, ends[last])
    order = suffix_arrays(symbols, bounds)
    del symbols
    left = np.repeat((ends - 1).astype(order.dtype), sizes + 1)  # bytes up to the piece's end
    left -= np.arange(ends[-1], dtype=order.dtype)
    blocks = np.repeat(block.astype(order.dtype), sizes + 1)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((left[a] >= length) & (left[b] >= length) & (blocks[a] == blocks[b]))
    a, b = a[near], b[near]
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    for step in [*range(0, length - 7, 8), length - 8]:  # eight bytes at a time
        same = words[a + step] == words[b + step]
        a, b = a[same], b[same]
        if not len(a):
            break
    hit = np.zeros(int(ends[-1]), dtype=bool)
    hit[a] = True
    hit[b] = True
    return hit[left >= length]


def _runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


BLOCK_BYTES = 1 << 20  # of blocks of one size class sorted at a time: about 40 times as much memory at the peak


def settle(blocks: DataFrame, length: int) -> DataFrame:
    """Ranges (doc, start, n) of repeated windows in segments that occur once; blocks: key, seg, doc, start, once, piece."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        keys = [r[0] for r in rows]
        block = np.cumsum(np.append(0, [a != b for a, b in zip(keys[1:], keys)]))
        pieces = [r[4] for r in rows]
        hit = repeated_in_blocks(pieces, block, length)
        out: list[list] = [[], [], []]
        at = 0
        for (_, doc, start, once, piece) in rows:
            n = len(piece) - length + 1
            if once:
                for s, m in _runs_of(hit[at : at + n]):
                    out[0].append(doc)
                    out[1].append(start + s)
                    out[2].append(m)
            at += n
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["doc", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # blocks of about one size are sorted together: they take about as many steps
        waiting: dict[int, list[tuple]] = {}
        held: dict[int, int] = {}
        block: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if block and row[0] != block[0][0]:
                    if ready := put(block, waiting, held):
                        yield work(ready)
                    block = []
                block.append(row)
        if block and (ready := put(block, waiting, held)):
            yield work(ready)
        for rows in waiting.values():
            if rows:
                yield work(rows)

    def put(block: list[tuple], waiting: dict[int, list[tuple]], held: dict[int, int]) -> list[tuple]:
        size = sum(len(r[4]) for r in block)
        kind = size.bit_length()
        waiting.setdefault(kind, []).extend(block)
        held[kind] = held.get(kind, 0) + size
        if held[kind] < BLOCK_BYTES:
            return []
        held[kind] = 0
        return waiting.pop(kind)

    dealt = blocks.select("key", "doc", "start", "once", "piece").repartition(partitions(blocks.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc binary, start int, n int")


def _sifted(found: DataFrame, filter_bits: int) -> DataFrame:
    """found without most keys that occur once: a bitmap of the slots that two keys hit takes them out before segments meet."""
    rows, bits = found.count(), 1 << 15
    while bits < min(16 * rows, filter_bits):
        bits *= 2
    slot = F.col("key").bitwiseAND(F.lit(bits - 1)).alias("key")
    maybe = _bitmap(found.groupBy(slot).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(batch.column(0).to_numpy().view(np.uint64))))

    return stage(found.mapInArrow(run, SEGMENTS), "kept")


def _counted(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranges of own segments that occur more than once; open keys, with different segments of which one occurs once (key, kinds);
    and the hashes, as key, of these single segments."""
    counts = stage(found.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("times")), "counts")
    keys = counts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 AND least = 1").select("key", "kinds")
    keys, many = stage(keys, "open"), counts.filter("times > 1").select("key", "seg")
    single = counts.filter("times = 1").join(keys.select("key"), "key", "left_semi").select(F.col("seg").alias("key"))
    return found.filter("own").join(many, ["key", "seg"]).select("doc", "start", "n"), keys, single


def repeated_ranges(docs: DataFrame, length: int = 200, text: str = "text", block_segments: int = 128, filter_bits: int = 1 << 27) -> DataFrame:
    """(doc, start, n): runs of repeated windows, by the MD5 of the text; ranges may overlap."""
    whole, open_keys, single = _counted(_sifted(stage(segments(docs, 0, [], length, text), "segments"), filter_bits))
    ranges = [whole]
    if not open_keys.isEmpty():
        first = key_filter(open_keys.select("key"), filter_bits)
        # pieces of segments that are repeated as a whole are counted, but their ranges are known
        fine, open_keys, _ = _counted(stage(segments(docs, 1, [first, key_filter(single, filter_bits)], length, text), "pieces"))
        ranges.append(fine)
        if not open_keys.isEmpty():
            rows = undecided(docs, [first, key_filter(open_keys.select("key"), filter_bits)], length, text).withColumn("once", F.lit(True))
            ranges += settle_open(rows, open_keys, length, block_segments)
    out = ranges[0]
    for more in ranges[1:]:
        out = out.unionByName(more)
    return stage(out.distinct(), "ranges")


def cut(raw: bytes, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left, for ranges of repeated windows (their starts and numbers)."""
    if not len(starts):
        return 0, 0, raw
    by = np.argsort(starts, kind="stable")
    starts = starts[by].astype(np.int64)
    reach = np.maximum.accumulate(starts + counts[by] + length - 1)
    new = np.append(True, starts[1:] > reach[:-1])
    starts, ends = starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
    left = b"".join(raw[e:s] for e, s in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)]))
    return len(raw) - len(left), len(starts), left


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text", keep_text: bool = False, filter_bits: int = 1 << 27, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, with keep_text also the remaining bytes, in column kept."""
    ranges = repeated_ranges(docs, length, text, filter_bits=filter_bits, **settings)
    by_doc = stage(ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    key = F.xxhash64("doc")
    some = _bit_test(by_doc.select(key.alias("key")), filter_bits)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"), digest.alias("doc"))
    marked = some(rows.withColumn("key", key))
    joined = marked.filter("maybe").select("doc_id", "body", "doc").join(by_doc, "doc", "left").select("doc_id", "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, spans = [], batch.column(2)
            flat = spans.flatten()
            starts, counts = (flat.field(i).to_numpy() for i in (0, 1))
            ends = np.cumsum(np.array(pc.fill_null(pc.list_value_length(spans), 0)))
            for doc, body, low, high in zip(batch.column(0).to_pylist(), batch.column(1), [0, *ends.tolist()], ends.tolist()):
                raw = body.as_py().encode()
                removed, n, left = cut(raw, starts[low:high], counts[low:high], length)
                out.append((doc, len(raw), removed, n, hashlib.sha256(left).hexdigest(), *[left] * keep_text))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * keep_text)
            names = [c.split()[0] for c in RESULT.split(", ")] + ["kept"] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(types), types)], names)

    cleaned = joined.mapInArrow(run, RESULT + ", kept binary" * keep_text)
    zero = F.lit(0).cast("long")
    whole = marked.filter("NOT maybe").select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("body").cast("binary"), 256).alias("kept_sha256"), *[F.col("body").cast("binary").alias("kept")] * keep_text)
    return cleaned.unionByName(whole)


def _bit_test(keys: DataFrame, filter_bits: int):
    """Adds column maybe to rows(key) by a broadcast bitmap of bounded size, with DataFrame functions."""
    n, bits = keys.count(), 1 << 15
    while bits < min(16 * n, filter_bits):
        bits *= 2
    slot = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    maps = stage(keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("map")), "filter")

    def test(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"bucket": F.bitmap_bucket_number(slot), "bit": F.bitmap_bit_position(slot)}).join(F.broadcast(maps), "bucket", "left")
        byte = F.conv(F.hex(F.expr("substring(map, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
        return rows.withColumn("maybe", F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bit", "map")

    return test


def op7_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
