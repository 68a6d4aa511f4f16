"""Near copies among embeddings: links at a cosine threshold, exact, by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the principal axes of all rows (second moments, one aggregate), largest first. In
that order most of a dot product lies in its leading dimensions, and what is missing is at most the product of the two vectors'
norms over the rest. Two tiles are compared a few dimensions at a time; pairs whose sum so far and bound together stay below
the threshold are given up, and only those left go on.

Vectors with the same components are one class with a count, found by a 128-bit hash and pre-aggregated, so copies cost one
vector. Classes are dealt to blocks along the first two axes by quantiles; blocks over twice their size, as where many vectors
share their leading components, are split by hash. Vectors that are linked lie within sqrt(2 - 2 threshold) of each other on
every axis, so only blocks whose boxes come that close meet: they are matched by cells of the first two axes, one task a pair
of blocks. A task returns, by class, the number of linked vectors on the other side, and one link of each class to the least one
that it reaches within the task: no list of pairs leaves a task. Components follow from these links.

Where a rotated cosine lies within 1e-9 of the threshold, the cosine of the vectors as they came decides.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths don't link; copies of a row link with each other; rows with a null id take part, don't name a component and are not kept;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._common import partitions, stage, table
from cadenza.llm.components import components

BLOCK_BYTES = 4 << 20  # of a block's vectors in double precision
TILE = 512
LEAD = 4  # axes that boxes of blocks hold
STEPS = (8, 16, 32, 64, 128, 256, 512)  # dimensions after which pairs are given up


def hashed(vectors: DataFrame, id_col: str, embedding: str) -> DataFrame:
    """id, key (of equal components), dims, embedding; key is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims = [], []
            for v in batch.column(1):
                x = None if v.as_py() is None else v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null is NaN here; -0 is 0
                good = x is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool((x != 0).any())
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
                dims.append(len(x) if good else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), batch.column(1)], ["vec_id", "key", "dims", "embedding"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, key binary, dims int, embedding array<double>")


def _unit(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    """Vectors of a column as rows of length one, zeros behind shorter ones."""
    values = batch.column(column)
    n = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(n), width))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes as columns, largest second moment first, over all classes; width squared numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch, 0, width)
                total, some = total + x.T @ x, True
        if some:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(i * width + j), pa.array(total[i, j])], ["at", "s"])

    moments = np.zeros((width, width))
    for r in classes.select("embedding").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toLocalIterator():
        moments[r["at"] // width, r["at"] % width] = moments[r["at"] % width, r["at"] // width] = r["s"]
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


def _leading(classes: DataFrame, axes: np.ndarray) -> DataFrame:
    """class, dims and the first coordinates x0, x1, ... in principal axes."""
    n = min(LEAD, axes.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch, 2, axes.shape[0]) @ axes[:, :n]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(n))], ["class", "dims", *(f"x{k}" for k in range(n))])

    return classes.select("class", "dims", "embedding").mapInArrow(run, ", ".join(["class long", "dims int", *(f"x{k} double" for k in range(n))]))


def _cut(rows: DataFrame, by: list[str], x: str, parts: int, name: str) -> DataFrame:
    """rows with the number of the quantile of column x, among ``parts`` by keys, that each falls in."""
    if parts < 2:
        return rows.withColumn(name, F.lit(0))
    cuts = rows.groupBy(*by).agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], max(10_000, 100 * parts)).alias("cuts"))
    return rows.join(F.broadcast(cuts), by).withColumn(name, F.size(F.filter("cuts", lambda c: c < F.col(x)))).drop("cuts")


def blocks(leading: DataFrame, count: int, block_rows: int) -> DataFrame:
    """leading rows with their block: (dims, slab along the first axis, part along the second, split)."""
    wanted = max(1, -(-count // block_rows))
    slabs = math.isqrt(wanted - 1) + 1
    rows = _cut(leading, ["dims"], "x0", slabs, "slab")
    # cuts by slab are a row a slab, the square root of the number of blocks
    rows = _cut(rows, ["dims", "slab"], "x1" if "x1" in leading.columns else "x0", -(-wanted // slabs), "part")
    sizes = rows.groupBy("dims", "slab", "part").agg(F.expr(f"1 + (count(1) - 1) div {2 * block_rows}").alias("pieces"))
    rows = rows.join(sizes, ["dims", "slab", "part"]).withColumn("split", F.pmod(F.xxhash64("class"), F.col("pieces")))
    return rows.withColumn("block", F.xxhash64("dims", "slab", "part", "split")).drop("slab", "part", "pieces", "split")


def block_pairs(dealt: DataFrame, radius: float) -> DataFrame:
    """(a, b), a <= b: blocks whose boxes are within ``radius`` of each other, matched by cells of the first two axes."""
    xs = [c for c in dealt.columns if c.startswith("x")]
    box = stage(dealt.groupBy("block", "dims").agg(*(f(c).alias(f"{n}_{c}") for c in xs for n, f in (("low", F.min), ("high", F.max)))), "boxes")
    cells = lambda c: F.explode(F.sequence(F.floor(F.col(f"low_{c}") / radius), F.floor((F.col(f"high_{c}") + radius) / radius)))
    keys = xs[:2]

    def in_cells(name: str) -> DataFrame:
        out = box.withColumn(name, F.struct("*"))
        for c in keys:
            out = out.withColumn(f"cell_{c}", cells(c))
        return out.select(name, "dims", *(f"cell_{c}" for c in keys))

    one, two = in_cells("p"), in_cells("q")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"p.low_{c}") - F.col(f"q.high_{c}"), F.col(f"q.low_{c}") - F.col(f"p.high_{c}"))
    near = sum((gap(c) * gap(c) for c in xs), F.lit(0.0)) <= radius * radius * (1 + 1e-9)
    return one.join(two, ["dims", *(f"cell_{c}" for c in keys)]).filter(F.col("p.block") <= F.col("q.block")).filter(near).select(F.col("p.block").alias("a"), F.col("q.block").alias("b")).distinct()


class Comparison:
    """Vectors of one or two blocks: unit rows in principal axes, in order of the leading one, with the norms of what follows each step."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray, threshold: float):
        self.raw, self.threshold = raw, threshold
        self.x = raw @ axes
        self.steps = [k for k in STEPS if k < self.x.shape[1]] + [self.x.shape[1]]
        squares = np.cumsum((self.x * self.x)[:, ::-1], axis=1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, k]) if k < self.x.shape[1] else np.zeros(len(self.x)) for k in self.steps]

    def linked(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in p, in q) of the pairs of two tiles that reach the threshold."""
        low, i, j, dots, slack = 0, None, None, None, 1e-9
        for high, rest in zip(self.steps, self.rest):
            if i is None:
                a, b = self.x[p, low:high], self.x[q, low:high]
                dots = a @ b.T if dots is None else dots + a @ b.T
                open_ = dots + np.outer(rest[p], rest[q]) >= self.threshold - slack
                n = int(open_.sum())
                if not n:
                    return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                if n * 8 < open_.size or high == self.steps[-1]:
                    i, j = np.nonzero(open_)
                    dots = dots[i, j]
            else:
                dots = dots + np.einsum("ij,ij->i", self.x[p[i], low:high], self.x[q[j], low:high])
                keep = dots + rest[p[i]] * rest[q[j]] >= self.threshold - slack
                i, j, dots = i[keep], j[keep], dots[keep]
            low = high
        close = np.abs(dots - self.threshold) <= slack
        good = dots >= self.threshold
        for k in np.flatnonzero(close):
            u, v = self.raw[p[i[k]]], self.raw[q[j[k]]]
            good[k] = float(u @ v) / math.sqrt(float(u @ u) * float(v @ v)) >= self.threshold
        return i[good], j[good]


class Reached:
    """The least row that each row reaches by the links seen so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            # each root hangs on the least one that it is linked with, roots of roots follow
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _compare(axes: np.ndarray, threshold: float):
    width = axes.shape[0]

    def one(part: pa.Table) -> pa.Table:
        batch = part.combine_chunks().to_batches()[0]
        a, b = part["a"][0].as_py(), part["b"][0].as_py()
        block = part["block"].to_numpy()
        both = Comparison(_unit(batch, batch.schema.get_field_index("embedding"), width), axes, threshold)
        classes, copies = part["class"].to_numpy(), part["copies"].to_numpy()
        by_axis = np.argsort(both.x[:, 0], kind="stable")
        sides = [by_axis[block[by_axis] == k] for k in ((a,) if a == b else (a, b))]
        tiles = [[side[k : k + TILE] for k in range(0, len(side), TILE)] for side in sides]
        links, reached, radius = np.zeros(len(classes), dtype=np.int64), Reached(len(classes)), math.sqrt(2 - 2 * threshold) + 1e-9
        for k, p in enumerate(tiles[0]):
            for q in tiles[0][k:] if a == b else tiles[1]:
                if both.x[q[0], 0] - both.x[p[-1], 0] > radius or both.x[p[0], 0] - both.x[q[-1], 0] > radius:
                    continue
                i, j = both.linked(p, q)
                if p is q:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    np.add.at(links, p[i], copies[q[j]])
                    np.add.at(links, q[j], copies[p[i]])
                    reached.add(p[i], q[j])
        some = np.flatnonzero(links)
        return pa.table({"class": classes[some], "links": links[some], "root": classes[reached.root[some]]})

    return one


def near_copies(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", embedding: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """One row a vector: vec_id, n_links (other rows at the threshold or above), component_id (least id that links lead to) and kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    rows = stage(hashed(vectors, id_col, embedding), "vectors")
    equal = rows.filter("key IS NOT NULL").groupBy("key", "dims").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = stage(equal.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    count, width = classes.agg(F.count(F.lit(1)), F.max("dims")).first()
    ids = rows.select("vec_id", "key")
    if not count:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    axes = principal_axes(classes, width)
    dealt = stage(blocks(_leading(classes, axes), count, block_rows or max(1, BLOCK_BYTES // (8 * width))), "vector-blocks")
    pairs = stage(block_pairs(dealt, math.sqrt(2 - 2 * threshold) + 1e-9), "block-pairs")
    ends = pairs.select("a", "b", F.col("a").alias("block")).unionByName(pairs.filter("a <> b").select("a", "b", F.col("b").alias("block")))
    sent = dealt.select("class", "block").join(classes.select("class", "copies", "embedding"), "class").join(ends, "block")
    found = sent.repartition(max(partitions(sent.sparkSession), 1), "a", "b").groupBy("a", "b").applyInArrow(_compare(axes, threshold), "class long, links long, root long")
    found = stage(found, "vector-links")
    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    tree = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    member = classes.select("class", "key", "copies", "least").join(linked, "class", "left").join(tree.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    member = stage(member, "vector-members")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(named, "root").select("key", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = ids.filter("key IS NOT NULL").join(member, "key").select("vec_id", "n_links", "component_id")
    out = out.unionByName(ids.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_near_dedup(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "embeddings"))
