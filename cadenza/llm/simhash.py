"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint has the bits that more than half of its text's shingle hashes set. Two texts link at
``radius`` (4) or fewer differing bits; components of links are the groups.

Search, over distinct fingerprints only, so that exact copies cost one row:
1. bits that correlate are grouped: a greedy pass over the 64 x 64 correlation matrix of all fingerprints;
2. for each number of partitions m, thresholds t_1..t_m >= -1 with sum radius - m + 1 are allocated by dynamic
   programming on estimated costs: any pair within radius meets some partition's threshold. The pair counts come
   from exact histograms, over all fingerprints, of blocks of at most 11 bits, whose distance distributions are convolved;
3. a partition with threshold t emits one key for each choice of t masked bits; fingerprints that meet under a key are
   candidates and are verified on all 64 bits. A bucket yields a spanning forest of its links, never all its pairs.

Buckets above ``chunk`` fingerprints are split: the most frequent fingerprint, the hub, takes all within its radius, which
needs no comparison among them; the rest meet everything in tiles of two chunks, so a task holds 2 x chunk rows.
Histograms and the correlation matrix have a fixed size (6 x 2048 and 64 x 64) and go to the driver; nothing that grows does.

Defined cases: a null, empty or blank text has fingerprint 0 and links like any other; under four words the whole
sequence is the one shingle; repeated rows are returned once each; an empty table gives an empty result; a null id
takes part but cannot name a component unless all its members' ids are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm._common import partitions, stage, table
from cadenza.llm.components import components
from cadenza.llm.exact_dedup import without_ids

BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned; words are runs without ASCII white space of the text with A-Z lowered."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    stops = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts.tolist(), stops.tolist())], dtype="<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int(sum(1 << i for i in np.flatnonzero(ones.ravel() * 2 > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def with_prints(docs: DataFrame) -> DataFrame:
    """docs with column __sh_fp."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, "__sh_fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__sh_fp", T.LongType())]))


# --- plan -----------------------------------------------------------------------------------------------------------


def bit_moments(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many set both (a 64 x 64 matrix, whatever the input)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            raw = batch.column(0).to_numpy().view(np.uint64)
            bits = (raw[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float32)
            n, both = n + len(raw), both + bits.T @ bits
        yield pa.RecordBatch.from_pydict({"cell": np.arange(4097), "n": np.append(both.ravel(), n).astype(np.int64)})

    rows = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(4097)
    cells[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size (to one), each grown from the least settled bit by the highest mean |correlation|."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [min(left, key=lambda b: (abs(p[b] - 0.5), b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: related[b, group].sum())
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def block_histograms(distinct: DataFrame, blocks: list[list[int]]) -> list[np.ndarray]:
    """Exact counts of each block's values over all fingerprints; a block has at most 11 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(blocks), 2048), dtype=np.int64)
        for batch in batches:
            raw = batch.column(0).to_numpy().view(np.uint64)
            for i, bits in enumerate(blocks):
                value = np.zeros(len(raw), dtype=np.int64)
                for k, b in enumerate(bits):
                    value |= (raw >> np.uint64(b) & np.uint64(1)).astype(np.int64) << k
                count[i] += np.bincount(value, minlength=2048)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cell": at, "n": count.ravel()[at]})

    rows = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(len(blocks) * 2048)
    flat[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return [flat[i * 2048 : i * 2048 + (1 << len(b))] for i, b in enumerate(blocks)]


def distance_shares(histogram: np.ndarray) -> np.ndarray:
    """Share of ordered pairs at each distance within a block: XOR autocorrelation by a Walsh-Hadamard transform."""
    w, h = histogram.astype(np.float64).copy(), 1
    while h < len(w):
        w = w.reshape(-1, 2, h)
        w = np.stack([w[:, 0] + w[:, 1], w[:, 0] - w[:, 1]], axis=1).ravel()
        h *= 2
    w, h = w * w, 1
    while h < len(w):
        w = w.reshape(-1, 2, h)
        w = np.stack([w[:, 0] + w[:, 1], w[:, 0] - w[:, 1]], axis=1).ravel()
        h *= 2
    by_distance = np.bincount([bin(v).count("1") for v in range(len(w))], np.maximum(w / len(w), 0))
    return by_distance / max(by_distance.sum(), 1e-300)


def allocate(cost: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) with the given sum and the least cost; cost[i][t + 1] is partition i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, add in enumerate(row, start=-1):
                key = used + t
                if key not in new or c + add < new[key][0]:
                    new[key] = (c + add, [*chosen, t])
        best = new
    return best[total]


def plan(distinct: DataFrame, radius: int = 4, key_cost: float = 40.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use. key_cost: a shuffled key in compared pairs."""
    n, both = bit_moments(distinct)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, radius + 2):
        groups = group_bits(n, both, m)
        blocks, owner = [], []
        for i, g in enumerate(groups):
            pieces = -(-len(g) // 11)
            for piece in np.array_split(np.array(g), pieces):
                blocks.append(piece.tolist())
                owner.append(i)
        shares = [distance_shares(h) for h in block_histograms(distinct, blocks)]
        total = radius - m + 1
        cost = np.full((m, radius + 2), np.inf)
        for i, g in enumerate(groups):
            near = np.ones(1)
            for share, o in zip(shares, owner):
                if o == i:
                    near = np.convolve(near, share)
            near = np.append(np.cumsum(near), np.ones(radius + 1))
            cost[i, 0] = 0.0
            for t in range(radius + 1):
                keys = comb(len(g), t)
                # pairs within t meet under every key that masks their differing bits
                met = sum(np.diff(near, prepend=0)[d] * comb(len(g) - d, t - d) for d in range(t + 1))
                rows = max(n, 1)  # an empty table has a plan too
                cost[i, t + 1] = rows * keys * key_cost + rows * rows / 2 * met
        found, thresholds = allocate(cost, total)
        if best is None or found < best[0]:
            best = found, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]
    return best[1]


# --- probe and verify -----------------------------------------------------------------------------------------------


def masks(bits: list[int], threshold: int) -> list[int]:
    """One 64-bit mask a key: the partition's bits less each choice of ``threshold`` of them, as signed longs."""
    full = sum(1 << b for b in bits)
    return [int(np.uint64(full - sum(1 << b for b in out)).astype(np.int64)) for out in combinations(bits, threshold)]


def _keyed(distinct: DataFrame, partitions_: list[tuple[list[int], int]]) -> DataFrame:
    """fp, n and each of its keys: the number of a mask hashed with the masked value. Masks are one literal, so the plan stays small."""
    every = [m for bits, t in partitions_ for m in masks(bits, t)]
    rows = distinct.select("fp", "n", F.posexplode(F.array(*map(F.lit, every)) if every else F.lit([])).alias("i", "m"))
    return rows.select("fp", "n", F.xxhash64("i", F.col("fp").bitwiseAND(F.col("m"))).alias("key"))


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    seen, out = np.zeros(len(close), dtype=bool), []
    for root in np.flatnonzero(close.sum(1) > 1).tolist():
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(close[at] & ~seen).tolist()
            seen[new] = True
            out += [(at, b) for b in new]
            front += new
    return out


def link_run(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one bucket or tile: a spanning forest of the pairs within radius."""
    a = fps.view(np.uint64)
    close = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    if int(close.sum()) == len(a):
        return []
    return [(int(fps[i]), int(fps[j])) for i, j in _forest(close)]


def _linked(rows: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Edges (a, b) within each group of keys; rows arrive sorted, so one pass over Arrow batches holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept, pairs = None, [], []

        def close() -> None:
            group = np.concatenate(kept) if len(kept) > 1 else kept[0]
            if len(group) > 1:
                pairs.extend(link_run(np.unique(group), radius))

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys) + 1)]
            if not len(columns[-1]):
                continue
            change = np.zeros(len(columns[-1]) - 1, dtype=bool)
            for c in columns[:-1]:
                change |= c[1:] != c[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[-1])]
            for s, e in zip(edges, edges[1:]):
                key = tuple(c[s] for c in columns[:-1])
                if key != kept_key and kept:
                    close()
                    kept.clear()
                kept_key = key
                kept.append(columns[-1][s:e])
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in pairs], "b": [y for _, y in pairs]})
                pairs.clear()
        if kept:
            close()
        if pairs:
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in pairs], "b": [y for _, y in pairs]})

    dealt = rows.select(*keys, "fp").repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def _sharper(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """rows(key, ...) once for each of radius + 1 groups of all 64 bits, the key sharpened by the group's value: two fingerprints within the radius agree in
    one group at least. Groups differ by level: every so many bits, runs of bits, then runs of three."""
    n = radius + 1
    group = (lambda b: b % n, lambda b: min(b * n // 64, radius), lambda b: b // 3 % n)[level % 3]
    each = [int(np.uint64(sum(1 << b for b in range(64) if group(b) == j)).astype(np.int64)) for j in range(n)]
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, each))).alias("j", "m"))
    return rows.withColumn("key", F.xxhash64("key", F.lit(level), "j", F.col("fp").bitwiseAND(F.col("m")))).drop("j", "m")


def links(distinct: DataFrame, radius: int = 4, chunk: int = 1024, levels: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp, n) whose components are those of all pairs within radius.

    A bucket of up to ``chunk`` fingerprints is compared in one go. In a larger one, those within the radius of its hub (the most frequent fingerprint) are
    linked to that, and only pairs with one beyond are open: the bucket is dealt anew by sharper keys, in which such pairs still meet, up to
    ``levels`` times. What is larger even then is compared in tiles.
    """
    rows = _keyed(distinct, plan(distinct, radius)).withColumn("far", F.lit(True))
    edges: list[DataFrame] = []
    for level in range(levels + 1):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("n", "fp")).alias("hub"), F.max("far").alias("open")).filter("size > 1 AND open")
        sizes = stage(sizes.select("key", "size", F.col("hub.fp").alias("hub")), "buckets")
        met = rows.join(sizes, "key")
        edges.append(_linked(met.filter(F.col("size") <= chunk), radius, ["key"]))
        if sizes.filter(F.col("size") > chunk).isEmpty():
            break
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= radius
        hot = stage(met.filter(F.col("size") > chunk).select("key", "fp", "n", "hub", (~near).alias("far")), "hot")
        edges.append(hot.filter("NOT far AND fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")))
        if level == levels:
            edges.append(_tiled(hot, radius, chunk))
        else:
            rows = _sharper(hot.select("key", "fp", "n", "far"), radius, level)
    return reduce(DataFrame.unionByName, edges).distinct()


def _tiled(hot: DataFrame, radius: int, chunk: int) -> DataFrame:
    """Edges of the open pairs of large buckets: rows beyond the hub's radius meet all others; a tile is (far chunk, any chunk)."""
    counts = stage(hot.groupBy("key").agg(F.sum(F.col("far").cast("long")).alias("n_far"), F.count(F.lit(1)).alias("all")), "far").filter("n_far > 0")
    tiles = lambda c: F.ceil(F.col(c) / (chunk / 2)).cast("int")
    hot = hot.join(counts, "key").withColumn("chunks", tiles("n_far"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    hot = hot.withColumns({"c": F.when(F.col("far"), mine), "side": F.pmod(F.xxhash64("fp"), tiles("all")).cast("int")})
    every_far = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(x.alias("x"), F.col("side").alias("y")))
    every_side = F.transform(F.sequence(F.lit(0), tiles("all") - 1), lambda y: F.struct(F.col("c").alias("x"), y.alias("y")))
    tile = F.when(~F.col("far"), every_far).otherwise(F.array_union(every_far, every_side))
    tiled = hot.select("key", "fp", F.explode(tile).alias("t")).select("key", F.col("t.x").alias("x"), F.col("t.y").alias("y"), "fp")
    return _linked(tiled, radius, ["key", "x", "y"])


def members_of(marks: DataFrame, radius: int = 4) -> DataFrame:
    """component_id, the smallest id of its component, for each distinct fp."""
    distinct = stage(marks.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return stage(named.join(least, "root").select("fp", "root", "component_id"), "members")


def near_groups(marks: DataFrame, radius: int = 4) -> DataFrame:
    """component_id for each row of fingerprints()."""
    return marks.join(members_of(marks, radius).drop("root"), "fp")


def near_dedup(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of docs for each component stays: that with the smallest id, of equal ids one. Rows that stay don't shuffle."""
    marks = stage(fingerprints(docs), "prints")
    members = members_of(marks, radius)
    grouped = marks.join(members, "fp")
    again = stage(marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("__sh_id")), "again")
    gone = grouped.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    if again.isEmpty():
        return without_ids(docs, gone)
    # an id that several rows have names no row: these rows' own fingerprints decide
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__sh_doc")
    rows = docs.select(whole, F.col("doc_id").alias("__sh_doc_id"), "text").join(again, F.col("__sh_doc_id").eqNullSafe(F.col("__sh_id")), "left_semi")
    named = members.select(F.col("fp").alias("__sh_at"), F.col("root").alias("__sh_root"), F.col("component_id").alias("__sh_first"))
    chosen = with_prints(rows).join(named, F.col("__sh_fp") == F.col("__sh_at")).filter(F.col("__sh_doc_id").eqNullSafe(F.col("__sh_first"))).dropDuplicates(["__sh_root"])
    return without_ids(docs, gone.unionByName(again.toDF("doc_id"))).unionByName(chosen.select("__sh_doc.*"))


def op2_simhash_near_dedup(spark, sf_dir):
    marks = stage(fingerprints(table(spark, sf_dir, "documents")), "prints")
    return near_groups(marks).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
