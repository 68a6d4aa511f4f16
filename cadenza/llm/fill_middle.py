"""Fill-in-the-middle transformation by a table-driven automaton over UTF-8 bytes.

One automaton does three things at once: it follows the continuation bytes of a character, tells where units (code points)
end, and recognises sentinels. Its state is the pair of a node in the trie of sentinels and the number of continuation
bytes that are still due; each transition carries what it emits: the end of a unit, a whole sentinel.

Texts are dealt to lanes of ``LANE`` bytes, which step through the table together, one byte of every lane at a time. A lane
starts a few bytes early: any four bytes of UTF-8 hold the start of a character and a sentinel's progress depends on no more
bytes than it has, so after these the state is the one that a scan from the text's start would have. The first scan counts
the units of each lane; the second runs the lanes that hold a cut again, up to the cut. Memory is that of one slice of lanes
beside the batch, whatever the length of a text.

Defined cases: a null or empty text is plain and stays empty; a text that holds a sentinel is plain; rows with a null id draw
their numbers from the seed alone; repeated rows are transformed once each, alike; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm._common import table

#: Marks of prefix, suffix and middle, and the byte that stands for what lies outside a text.
SENTINELS = ("<P>", "<S>", "<M>")
OUTSIDE = 0xFF
UNIT, HIT = 1, 2  # what a transition emits
LANE, LANES = 512, 16_384

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Automaton:
    """next state and emissions by (state, byte): ``table[state << 8 | byte]`` is ``next << 8 | emitted``."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        words = [s.encode() for s in sentinels]
        if not all(words):
            raise ValueError("a sentinel has a byte at least")
        nodes = sorted({w[:k] for w in words for k in range(len(w) + 1)}, key=lambda x: (len(x), x))
        number = {x: i for i, x in enumerate(nodes)}
        self.warm = max(4, *map(len, words))
        self.table = np.empty((len(nodes), 4, 256), dtype=np.int32)
        for node in nodes:
            for due in range(4):
                for byte in range(256):
                    seen = b"" if byte == OUTSIDE else node + bytes([byte])
                    hit = any(seen.endswith(w) for w in words)
                    while seen not in number:
                        seen = seen[1:]
                    # a lead byte says how many are due; a continuation byte takes one off
                    after = max(0, due - 1) if 0x80 <= byte < 0xC0 else 0 if byte < 0x80 or byte == OUTSIDE else 1 + (byte >= 0xE0) + (byte >= 0xF0)
                    emitted = UNIT * (byte != OUTSIDE and not after) | HIT * hit
                    self.table[number[node], due, byte] = (number[seen] * 4 + after) << 8 | emitted
        self.table = self.table.reshape(-1)

    def _columns(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bytes of each lane as a column, the warm-up first; OUTSIDE where a lane leaves its text."""
        at = start[None, :] + np.arange(-self.warm, LANE, dtype=np.int64)[:, None]
        inside = (at >= low) & (at < high)
        return np.where(inside, data[np.clip(at, 0, len(data) - 1)], OUTSIDE)

    def count(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units that end in each lane, and whether a sentinel does."""
        units, hit = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=bool)
        for a in range(0, len(start), LANES):
            cut = slice(a, a + LANES)
            code = np.zeros(len(start[cut]), dtype=np.int32)
            ends, seen = np.zeros(len(code), dtype=np.int32), np.zeros(len(code), dtype=np.int32)
            for k, column in enumerate(self._columns(data, start[cut], low[cut], high[cut])):
                code = self.table[(code & ~0xFF) | column]
                if k >= self.warm:
                    ends += code & UNIT
                    seen |= code
            units[cut], hit[cut] = ends, seen & HIT != 0
        return units, hit

    def locate(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Byte in each lane behind which ``wanted`` (1 or more) units of it have ended."""
        found = np.zeros(len(start), dtype=np.int64)
        for a in range(0, len(start), LANES):
            cut = slice(a, a + LANES)
            code = np.zeros(len(start[cut]), dtype=np.int32)
            ends, before = np.zeros(len(code), dtype=np.int32), np.zeros(len(code), dtype=np.int32)
            for k, column in enumerate(self._columns(data, start[cut], low[cut], high[cut])):
                code = self.table[(code & ~0xFF) | column]
                if k >= self.warm:
                    ends += code & UNIT
                    before += ends < wanted[cut]
            found[cut] = before + 1
        return start + found


class Scan:
    """The texts ``data[edges[i]:edges[i + 1]]``, scanned once: units of each and whether it holds a sentinel."""

    def __init__(self, automaton: Automaton, data: np.ndarray, edges: np.ndarray):
        self.automaton, self.data, self.edges = automaton, data, edges.astype(np.int64)
        size = np.diff(self.edges)
        self.lanes = -(-size // LANE)
        self.first = np.concatenate([[0], np.cumsum(self.lanes)])  # each text's first lane
        self.text = np.repeat(np.arange(len(size)), self.lanes)
        self.start = self.edges[self.text] + (np.arange(len(self.text)) - self.first[self.text]) * LANE
        ended, hit = automaton.count(data, self.start, self.edges[self.text], self.edges[self.text + 1])
        self.upto = np.concatenate([[0], np.cumsum(ended)])  # units before each lane, over all texts
        self.units = self.upto[self.first[1:]] - self.upto[self.first[:-1]]
        marked = np.concatenate([[0], np.cumsum(hit)])
        self.marked = marked[self.first[1:]] > marked[self.first[:-1]]

    def cut(self, texts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Bytes of data where the first ``units`` units of each of the texts end."""
        out, some = self.edges[texts].copy(), units > 0
        goal = self.upto[self.first[texts[some]]] + units[some]
        lane = np.searchsorted(self.upto, goal, side="left") - 1
        of = self.text[lane] if len(lane) else lane
        out[some] = self.automaton.locate(self.data, self.start[lane], self.edges[of], self.edges[of + 1], goal - self.upto[lane])
        return out


def draws(id_col: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """n numbers of 32 bits from the hex digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(n)]


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each text.

    Two of the text's n + 1 places are drawn from its id; between them lies the middle. Form psm is prefix, suffix, middle, each behind its
    sentinel; spm puts the suffix first; plain texts stay as they are.
    """
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sentinels)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).cast(pa.large_binary())
            edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.full(1, OUTSIDE, dtype=np.uint8)
            scan = Scan(automaton, data, edges)
            h = [batch.column(2 + k).to_numpy() for k in range(4)]
            places = [x % (scan.units + 1) for x in h[:2]]
            low, high = np.minimum(*places), np.maximum(*places)
            plain = (scan.units == 0) | scan.marked | (h[2] % 100 >= percent)
            which = np.flatnonzero(~plain)
            one, two = scan.cut(which, low[which]), scan.cut(which, high[which])
            form, output, view = np.where(plain, "plain", np.where(h[3] % 100 < spm_percent, "spm", "psm")).tolist(), [], memoryview(data)
            ends = dict(zip(which.tolist(), zip(one.tolist(), two.tolist())))
            for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if i not in ends:
                    output.append(bytes(view[a:b]))
                    continue
                x, y = ends[i]
                first = (s, view[y:b], p, view[a:x]) if form[i] == "spm" else (p, view[a:x], s, view[y:b])
                output.append(b"".join((*first, m, view[x:y])))
            columns = [batch.column(0), pa.array(scan.units), pa.array(form, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *draws(F.col(id_col), seed))
    return rows.mapInArrow(run, OUT)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. A sentinel stands once in an output that is not plain, as its text holds none."""
    p, s, m = sentinels
    behind = lambda x, mark: F.substring_index(x, mark, -1)
    before = lambda x, mark: F.substring_index(x, mark, 1)
    middle, rest = behind(output, m), before(output, m)
    psm = F.concat(behind(before(rest, s), p), middle, behind(rest, s))
    spm = F.concat(behind(rest, p), middle, behind(before(rest, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark, sf_dir):
    out = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
g AS (SELECT *, substr(t, 1, p) AS a, substr(t, p + 1, q - p) AS b, substr(t, q + 1) AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM g"""
