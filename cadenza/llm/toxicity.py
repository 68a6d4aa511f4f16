"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams of 2 to 8 characters (lower case, a space at each end) in 2**20
hashed buckets. Each is scaled by its log-count ratio between labelled toxic and clean documents; logistic regression on the
scaled features is trained in one task, on at most ``per_class`` (2000) toxic and twice as many clean labelled documents, chosen by a hash of
the id: one row an id, whole texts, of which the ``most_chars`` (32 million characters in all; texts of over a million are not learned
from) bound what the task holds, whatever the corpus. Scoring reads whole texts, a piece of a long one at a time, in one narrow pass with a 4 MB table.

Defined cases: null text counts as empty; an empty text gets the score of no features; null labels are not
learned from; an id with several labels counts as toxic if one says so; of rows with one id the text of least hash is learned from; without both classes every document gets the
toxic share of the labels (0 without labels); repeated rows are scored once each; extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm._common import table

ORDERS = (2, 3, 4, 5, 6, 7, 8)
BITS = 20
PIECE = 1 << 15  # characters of a text whose n-grams are held at once
ROWS = 256  # rows of a batch that are passed on at once


def grams(text: str | None, orders: tuple[int, ...] = ORDERS, padded: bool = False) -> np.ndarray:
    """Bucket of each character n-gram of a text, repeats included; spaces are put around it unless it has them."""
    raw = np.frombuffer((text if padded else f" {text or ''} ").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    code, out = np.zeros(len(raw) + 1, dtype=np.uint64), []
    for n in range(1, max(orders) + 1):
        if len(raw) < n:
            break
        code = (code[:-1] + raw[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        if n in orders:
            out.append((code * np.uint64(0xD1B54A32D192ED03) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


@dataclass
class Model:
    weights: np.ndarray  # float32 by bucket: log-count ratio times learned weight
    bias: float

    def score(self, text: str | None) -> float:
        body = f" {text or ''} "
        found = [s[self.weights[s] != 0] for s in (grams(body[k : k + PIECE + max(ORDERS) - 1], padded=True) for k in range(0, len(body), PIECE))]
        used = np.unique(np.concatenate(found))
        return float(1 / (1 + np.exp(-np.clip(float(self.weights[used].sum(dtype=np.float64)) + self.bias, -500, 500))))

    def logit(self, seen: np.ndarray) -> float:
        """Of a document's distinct buckets."""
        return float(self.weights[seen].sum(dtype=np.float64)) + self.bias


def fit(texts: list[str | None], toxic: np.ndarray, features: int = 5000, **settings) -> Model:
    """The model, its bias moved to where the two halves' models, each asked about the other half, err least.

    Texts are read twice: once for document counts by class and half, once for the presence of the chosen features, so that
    only those are held.
    """
    y, half = np.asarray(toxic, dtype=np.float64), np.arange(len(toxic)) % 2
    whole = [y > -1, half == 0, half == 1]
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << BITS, np.float32), 500.0 if len(y) and y.sum() else -500.0)
    counts = np.zeros((2, 2, 1 << BITS), dtype=np.int32)  # half, class
    for text, k, label in zip(texts, half, y):
        counts[k, int(label), np.unique(grams(text))] += 1
    splits = [m for m in whole if 0 < y[m].sum() < m.sum()]
    splits = whole if len(splits) == 3 else whole[:1]
    chosen = []
    for m, df in zip(splits, (counts.sum(0), counts[0], counts[1])):
        ratio = np.log((df[1] + 1) / (y[m].sum() + 2)) - np.log((df[0] + 1) / (m.sum() - y[m].sum() + 2))
        total = df.sum(0)
        worth = np.where(total >= min(5, max(2, y[m].sum() / 10)), np.abs(ratio) * np.sqrt(total), 0)
        keep = np.argsort(-worth, kind="stable")[:features]
        chosen.append((keep, ratio[keep]))
    del counts
    used = np.zeros(1 << BITS, dtype=bool)
    for keep, _ in chosen:
        used[keep] = True
    sets = []
    for text in texts:
        g = grams(text)
        sets.append(np.unique(g[used[g]]))
    (keep, ratio), others = chosen[0], chosen[1:]
    model = _fit(sets, y, keep, ratio, **settings)
    if not others:
        return model
    z = np.empty(len(y))
    for m, (keep, ratio) in zip(splits[1:], others):
        other = _fit([s for s, own in zip(sets, m) if own], y[m], keep, ratio, **settings)
        z[~m] = [other.logit(s) for s, own in zip(sets, m) if not own]
    order = np.argsort(z, kind="stable")
    ranked = y[order]
    errors = np.append(0, np.cumsum(ranked)) + np.append(np.cumsum((1 - ranked)[::-1])[::-1], 0)  # if the first k are called clean
    best = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[z[order[0]] - 1], z[order], [z[order[-1]] + 1]])
    cut = float(np.mean((edges[best] + edges[best + 1]) / 2))
    return Model(model.weights, model.bias - cut)


def _fit(sets: list[np.ndarray], y: np.ndarray, keep: np.ndarray, ratio: np.ndarray, scale: float = 0.05, steps: int = 300, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """Logistic regression on the presence of the buckets in keep, each scaled by its log-count ratio."""
    column = np.full(1 << BITS, -1, dtype=np.int64)
    column[keep] = np.arange(len(keep))
    rows, cols = [], []
    for i, s in enumerate(sets):
        c = column[s]
        cols.append(c[c >= 0])
        rows.append(np.full(len(cols[-1]), i))
    row, col, r = np.concatenate(rows), np.concatenate(cols), ratio * scale
    value, balance = r[col], np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, first, second = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for step in range(1, steps + 1):  # Adam on the full batch, classes weighted alike
        z = np.bincount(row, value * w[col], minlength=len(y)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * balance
        grad = np.append(np.bincount(col, value * g[row], minlength=len(keep)) + decay * w[:-1], g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[keep] = r * w[:-1]
    return Model(weights, float(w[-1]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_chars: int = 32_000_000) -> Model:
    """Fits in one task, which holds the bounded sample; the driver gets the weights only."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__tx_label")).filter(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.filter("__tx_label = 1").orderBy(*order).limit(per_class).unionByName(known.filter("__tx_label = 0").orderBy(*order).limit(2 * per_class))
    # one row an id, decided by partial aggregates, before anything meets in one task
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= 1_000_000).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "__tx_label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("doc_id", "least.text", "__tx_label")
    # a window over three times per_class rows at most
    upto = F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__tx_upto", upto).filter(F.col("__tx_upto") <= most_chars).drop("__tx_upto")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            whole = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            made = fit(whole["text"].to_pylist(), whole["__tx_label"].to_numpy())
            at = np.flatnonzero(made.weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(made.weights[at].astype(np.float64), made.bias))], ["bucket", "weight"])

    weights = np.zeros(1 << BITS, np.float32)
    found = rows.repartition(1).mapInArrow(run, "bucket long, weight double").toArrow()
    bucket, weight = found["bucket"].to_numpy(), found["weight"].to_numpy()
    weights[bucket[bucket >= 0]] = weight[bucket >= 0]
    return Model(weights, float(weight[bucket < 0][0]) if len(bucket) else -500.0)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = np.array([shared.value.score(x.as_py()) for x in batch.column(2)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of docs whose score is lower, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            yield batch.filter(pa.array([shared.value.score(x.as_py()) < below for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
