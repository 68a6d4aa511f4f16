"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

A source with token share p gets the weight p**a / sum(p**a). The exponent a >= 0 is bisected until the weights' entropy meets
``target_entropy`` (a share of its maximum): a below 1 levels sources, above 1 it sharpens them. Where some source would then
repeat more often than ``repeats`` within the budget, a is bisected between there and 1, until the limit holds. Without a target the mix
is as level as the limit allows. Entropy falls and repeats grow away from 1 with a, so both have one solution; where no exponent
meets the target (sources that are all alike, one source), the shares stay as they are.

A source's quota is weight x budget tokens. Each pass over a source is a permutation of its blocks: documents are
dealt into blocks by a keyed hash, blocks are ordered by a keyed hash of their number and the pass, and documents within a block
likewise. All documents come in every whole pass; the last pass ends with the document that reaches the quota, in the middle
of a block, so a quota is met to one document.

Prefix sums over a source are never taken over all its rows: totals are summed by super-block, then by block in the one
super-block where the quota ends, then by document in that block; each window holds about ``block_rows`` rows a source. The
plan is one row a source with the three keys at which its last pass ends, so a row decides for itself, without a shuffle.
Up to ``max_sources`` sources, their token counts are bisected on the driver and the plan is broadcast; beyond, each trial exponent
is one aggregate over the sources, and the plan joins by shuffle: the same result at any number of sources.

Defined cases: a null text has no tokens and stays with every pass; a null source is a source of its own; rows alike
in id, source and text share a place: the last pass takes all of them or none; sources without tokens get their documents
once; a text may be of any length; an empty table gives an empty result; extra columns are carried inside one struct, so that no
name can clash with a working column's.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm._common import stage, table

SEED = 20


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space: the default measure of tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weights_at(shares: list[float], a: float) -> list[float]:
    top = max(shares)
    raised = [(s / top) ** a for s in shares]
    return [r / sum(raised) for r in raised]


def entropy(weights: list[float]) -> float:
    """As a share of the most that so many sources can have."""
    if len(weights) < 2:
        return 1.0
    return -sum(w * math.log(w) for w in weights if w > 0) / math.log(len(weights))


#: Trial exponent -> (sum of r**a, sum of r**a * ln r) over the sources with tokens, r their tokens over the most that one has.
Sums = Callable[[float], tuple[float, float]]


def local_sums(tokens: list[int]) -> Sums:
    logs = [math.log(t / max(tokens)) for t in tokens]
    return lambda a: (math.fsum(math.exp(a * x) for x in logs), math.fsum(x * math.exp(a * x) for x in logs))


def shuffled_sums(totals: DataFrame, most: int) -> Sums:
    def at(a: float) -> tuple[float, float]:
        x = F.log(F.col("t") / F.lit(most))
        return tuple(totals.agg(F.sum(F.exp(x * a)), F.sum(x * F.exp(x * a))).first())

    return at


def bisect_exponent(sums: Sums, n: int, least: int, most: int, budget: int, target_entropy: float | None, repeats: float | None, rounds: int = 50) -> float:
    """The exponent that meets the targets, for n sources with least to most tokens."""

    def spread(a: float) -> float:
        z, s = sums(a)
        return (math.log(z) - a * s / z) / math.log(n) if n > 1 else 1.0

    def most_repeats(a: float) -> float:
        """Below 1 the smallest source repeats most, above 1 the largest."""
        z, _ = sums(a)
        return budget / z * max((least / most) ** a / least, 1 / most)

    def met() -> float:
        if target_entropy is None or target_entropy >= 1:
            return 0.0
        low, high = 0.0, 1.0
        while spread(high) > target_entropy:
            low, high = high, high * 2
            if high > 1 << 30:
                return 1.0
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (middle, high) if spread(middle) > target_entropy else (low, middle)
        return high

    away, near = met(), 1.0
    if repeats is None or most_repeats(away) <= repeats:
        return away
    for _ in range(rounds):
        middle = (away + near) / 2
        away, near = (middle, near) if most_repeats(middle) > repeats else (away, middle)
    return near


def source_rates(totals: DataFrame, budget: int | None, target_entropy: float | None, repeats: float | None, on_driver: bool) -> DataFrame:
    """(s, __mx_docs, __mx_last: whole passes, __mx_rest: tokens of the last pass) of totals(__mx_source, t, d)."""
    some = totals.filter("t > 0")
    n, whole, least, most = some.agg(F.count(F.lit(1)), F.sum("t"), F.min("t"), F.max("t")).first()
    quota = F.lit(None).cast("long")
    if n:
        budget = whole if budget is None else budget
        sums = local_sums([r[0] for r in some.select("t").collect()]) if on_driver else shuffled_sums(some, most)
        a = bisect_exponent(sums, n, least, most, budget, target_entropy, repeats)
        quota = F.when(F.col("t") > 0, F.round(F.exp(F.log(F.col("t") / F.lit(most)) * a) / sums(a)[0] * budget).cast("long"))
    passes, rest = F.coalesce(F.floor(quota / F.col("t")), F.lit(1)), F.coalesce(quota % F.col("t"), F.lit(0))
    return totals.select(F.col("__mx_source").alias("s"), F.col("d").alias("__mx_docs"), passes.cast("long").alias("__mx_last"), rest.cast("long").alias("__mx_rest"))


def _key(*columns: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *columns)


def _dealt(rows: DataFrame, block_rows: int) -> DataFrame:
    """rows(__mx_row, __mx_docs): adds the block and super-block that a row's hash deals it to, in proportion to its source's rows."""
    n = F.col("__mx_docs")
    spread = lambda k, size: F.pmod(F.xxhash64(F.lit(k), "__mx_row"), F.greatest(F.lit(1), F.ceil(n / size)).cast("long"))
    supers = F.greatest(F.lit(1), F.ceil(n / (block_rows * block_rows))).cast("long")
    rows = rows.withColumn("__mx_block", spread(1, block_rows))
    return rows.withColumn("__mx_super", F.pmod("__mx_block", supers))


def _ordered(rows: DataFrame, turn: str) -> DataFrame:
    """Adds the three keys that order super-blocks, blocks and documents in the pass numbered by column ``turn``."""
    return rows.withColumns({"__mx_k1": _key(F.lit("super"), F.col("__mx_super"), F.col(turn)), "__mx_k2": _key(F.lit("block"), F.col("__mx_block"), F.col(turn)), "__mx_k3": _key(F.lit("row"), F.col("__mx_row"), F.col(turn))})


def _edge(rows: DataFrame, key: str, out: str) -> DataFrame:
    """For each source: the first ``key`` at which the tokens so far reach the rest, with the rest that remains there."""
    sums = rows.groupBy("__mx_source", key, "__mx_rest").agg(F.sum("__mx_tokens").alias("t"))
    w = Window.partitionBy("__mx_source").orderBy(key)
    so_far = sums.withColumn("upto", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reached = so_far.filter(F.col("upto") >= F.col("__mx_rest"))
    first = reached.groupBy("__mx_source").agg(F.min(F.struct(F.col(key).alias("k"), (F.col("__mx_rest") - F.col("upto") + F.col("t")).alias("rest"))).alias("e"))
    return stage(first.select(F.col("__mx_source").alias("__mx_s"), F.col("e.k").alias(out), F.col("e.rest").alias("__mx_left")), "edge")


def _within(rows: DataFrame, edge: DataFrame, key: str, out: str) -> DataFrame:
    """The rows at their source's edge, with the rest that remains for them."""
    same = F.col("__mx_source").eqNullSafe(F.col("__mx_s")) & (F.col(key) == F.col(out))
    return rows.join(edge, same).drop("__mx_s", "__mx_rest").withColumnRenamed("__mx_left", "__mx_rest")


def last_pass(rows: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(__mx_s, e1, e2, e3) by source: a document is in the last pass if its keys are up to these, in that order.

    rows(__mx_source, __mx_tokens, __mx_rest, keys) are those of sources with a rest. The window over super-blocks, that over the
    blocks of one super-block and that over the documents of one block each hold about block_rows rows a source.
    """
    e1 = _edge(rows, "__mx_k1", "e1")
    inside = _within(rows, near(e1), "__mx_k1", "e1")
    e2 = _edge(inside, "__mx_k2", "e2")
    e3 = _edge(_within(inside, near(e2), "__mx_k2", "e2"), "__mx_k3", "e3")
    keep = lambda e: e.drop("__mx_left").withColumnRenamed("__mx_s", "s")
    on = lambda a, b: a.join(keep(b).withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    return stage(on(on(keep(e1), e2), e3), "edges")


def plan_mix(counted: DataFrame, budget: int | None, target_entropy: float | None, repeats: float | None, block_rows: int, max_sources: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(s, __mx_docs, __mx_last, __mx_rest, e1, e2, e3) by source, from counted(__mx_row, __mx_source, __mx_tokens); and what marks tables of a row a
    source for joining: a broadcast where max_sources bounds them."""
    totals = stage(counted.groupBy("__mx_source").agg(F.sum("__mx_tokens").alias("t"), F.count(F.lit(1)).alias("d")), "totals")
    few = totals.limit(max_sources + 1).count() <= max_sources
    near = F.broadcast if few else lambda df: df
    rates = source_rates(totals, budget, target_entropy, repeats, few)
    rows = counted.join(near(rates), F.col("__mx_source").eqNullSafe(F.col("s"))).drop("s").filter("__mx_rest > 0")
    edges = last_pass(_ordered(_dealt(rows, block_rows), "__mx_last"), near).withColumnRenamed("s", "s2")
    return rates.join(near(edges), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"), near


def realise(rows: DataFrame, planned: tuple[DataFrame, Callable[[DataFrame], DataFrame]], block_rows: int) -> DataFrame:
    """rows(__mx_row, __mx_source, ...) once for each pass that takes them, with __mx_pass, __mx_block and the ordering keys.

    Narrow up to max_sources: the plan is one row a source, and a row's own hash says where it stands.
    """
    plan, near = planned
    plan = plan.withColumnsRenamed({c: f"__mx_{c}" for c in ("s", "e1", "e2", "e3")})
    rows = _dealt(rows.join(near(plan), F.col("__mx_source").eqNullSafe(F.col("__mx_s"))).drop("__mx_s"), block_rows)
    rows = _ordered(rows, "__mx_last")
    k1, k2, k3, e1, e2, e3 = map(F.col, ("__mx_k1", "__mx_k2", "__mx_k3", "__mx_e1", "__mx_e2", "__mx_e3"))
    upto = (k1 < e1) | (k1 == e1) & ((k2 < e2) | (k2 == e2) & (k3 <= e3))
    passes = F.col("__mx_last") + (F.coalesce(upto, F.lit(False)) & (F.col("__mx_rest") > 0)).cast("long")
    taken = rows.withColumn("__mx_passes", passes).filter("__mx_passes > 0")
    return _ordered(taken.withColumn("__mx_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mx_passes") - 1))), "__mx_pass")


def _counted(docs: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    row = F.xxhash64(F.col(id_col), F.col(source), F.col(text))
    return docs.select(F.col(id_col).alias("__mx_id"), row.alias("__mx_row"), F.col(source).alias("__mx_source"), word_count(F.col(text)).alias("__mx_tokens"))


DEFAULTS = {"budget": None, "target_entropy": 0.95, "repeats": 4.0, "block_rows": 1000, "max_sources": 100_000}


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **settings) -> DataFrame:
    """docs' rows as often as the mix takes them, with docs' columns. Texts are read twice and never shuffle.

    settings: budget in tokens (default: all there are), target_entropy, repeats, block_rows, max_sources.
    """
    chosen = DEFAULTS | settings
    counted = stage(_counted(docs, id_col, source, text).select("__mx_row", "__mx_source", "__mx_tokens"), "counted")
    plan = plan_mix(counted, **chosen)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__mx_doc")
    rows = docs.select(whole, F.xxhash64(F.col(id_col), F.col(source), F.col(text)).alias("__mx_row"), F.col(source).alias("__mx_source"))
    return realise(rows, plan, chosen["block_rows"]).select("__mx_doc.*")


def mix_order(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **settings) -> DataFrame:
    """The mix without texts: id, source, tokens, pass, block and order keys; sorted by pass and keys, a source's rows are its permutations."""
    chosen = DEFAULTS | settings
    counted = stage(_counted(docs, id_col, source, text), "counted")
    out = realise(counted, plan_mix(counted, **chosen), chosen["block_rows"])
    named = {"__mx_source": "source", "__mx_tokens": "n_tokens", "__mx_pass": "pass", "__mx_block": "block", "__mx_k1": "super_key", "__mx_k2": "block_key", "__mx_k3": "row_key"}
    return out.select(F.col("__mx_id").alias(id_col), *(F.col(k).alias(v) for k, v in named.items()))


def op10_temperature_mixing(spark, sf_dir):
    return mix_order(table(spark, sf_dir, "documents"))
