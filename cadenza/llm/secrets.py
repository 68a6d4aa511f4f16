"""Secret scan with corpus-wide ownership frequency.

Every whole text is searched for three base kinds and for opaque tokens (20 or more characters of a key's alphabet that
mix letters and digits). The value of each find is hashed; over the whole corpus each hash is counted by distinct
owners and repositories. A value that ``min_owners`` owners or ``min_repos`` repositories or more hold is a widely copied example (one
owner's fixture in many repositories too); one below both with enough entropy looks live and belongs to its owner. Base spans are always kept; an opaque token becomes a span only
where it looks live and no base span covers it.

Counts are aggregated by (hash, owner, repository) before they meet by hash, so a value in a third of all rows is one
row a task and owner. Spans are joined to the counts by hash under AQE's skew split, and gathered by document only.

Defined cases: null text counts as empty; a null owner or repository is one owner or repository of its own; repeated rows
are scanned and returned once each; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm._common import stage, table

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: One class repeated: a run is maximal, so a least length in the pattern equals dropping short runs afterwards.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
COUNTS = ("n_copied", "n_live", "most_owners", "most_repos")
SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary()), ("entropy", pa.float64())])
SCANNED = "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:long,end:long,hash:binary,entropy:double>>"


def entropy(value: str) -> float:
    """Shannon bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of base spans and opaque tokens, by start, then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted(out)
    starts, reach = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
    for m in OPAQUE.finditer(text):
        value, before = m[0], bisect_left(starts, m.end())  # base spans that start before this one ends
        if re.search("[0-9]", value) and re.search("[A-Za-z]", value) and not (before and reach[before - 1] > m.start()):
            out.append((m.start(), 3, m.end(), value))
    return sorted(out)


def scan(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(3):
                found = find(body.as_py() or "")
                base = [x for x in found if x[1] < 3]
                kinds = Counter(x[1] for x in base)
                listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
                spans = [{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).digest()[:16], "entropy": entropy(v)} for s, k, e, v in found]
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(listed.encode()).hexdigest(), spans))
            made = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(made, types))], ["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return docs.select(F.col(id_col).cast("long"), owner.cast("string"), repo.cast("string"), text).mapInArrow(run, SCANNED)


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repos: distinct holders of each value over the whole corpus."""
    by_owner = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def secrets(scanned: DataFrame, min_owners: int = 3, min_repos: int = 5, min_entropy: float = 3.0) -> DataFrame:
    """One row a document: base digest, all spans, how many of them are widely copied or live-looking, and the most owners and repositories that hold
    one of its values."""
    rows = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")
    kept = ["row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    spans = rows.select(*kept, "owner", "repo", F.explode("found").alias("f")).select(*kept, "owner", "repo", "f.*")
    counts = stage(ownership(spans), "owners")
    copied = (F.col("owners") >= min_owners) | (F.col("repos") >= min_repos)
    live = ~copied & (F.col("entropy") >= min_entropy)
    shown = spans.join(counts, "hash").filter((F.col("kind") < 3) | live)
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    name = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", name[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    gathered = shown.groupBy("row").agg(text.alias("spans"), F.sum(copied.cast("long")).alias("n_copied"), F.sum(live.cast("long")).alias("n_live"), F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"))
    some = F.size("found") > 0
    nothing = [F.lit("").alias("spans"), *(F.lit(0).cast("long").alias(c) for c in COUNTS)]
    with_spans = rows.filter(some).select(*kept).join(gathered, "row", "left").fillna({"spans": ""} | dict.fromkeys(COUNTS, 0))
    return with_spans.unionByName(rows.filter(~some).select(*kept, *nothing)).drop("row")


def op1_secret_ownership(spark, sf_dir):
    """A document's source stands for the owner, its source and language for the repository."""
    return secrets(scan(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang")))
