"""Alignment of two tokenizers' tokens over the same bytes.

Each side's tokens are spread over the bytes that they cover: the owner array of a side repeats each token's index over its bytes.
Where the pair of owners changes, an overlap of two tokens ends; where both owners change at once, both tokenizations have a
boundary: a cut. Cuts divide the tokens of both sides into groups, and the overlap that ends at a cut links the two tokens that
end there.

Single spaces between two visible characters below U+0530 are boundaries of both tokenizations, whatever stands around them: the
first tokenizer's pattern starts a match there, and the second has no piece with a space behind another character. So a text is
the sum of its parts between them, and a task aligns each different part once among the last ``REMEMBERED`` ones, many new
parts in one call.

How often an identifier pair is linked is counted over all rows. The two tokens of a link end at the same byte, so one's bytes
are a suffix of the other's: a token has as many partners as suffixes at most. That bounds the table of counts by the vocabularies
alone (``pair_bound``), whatever the corpus, and it is broadcast.

Defined cases: null and empty texts, and texts whose bytes a side does not give back, have no tokens: zeros and empty groups;
repeated rows are aligned and counted once each; ids may be null or repeat, rows stay apart; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import tokens
from cadenza.llm._common import stage, table

#: Where both tokenizations have a boundary: fixed by the two vocabularies.
BETWEEN = re.compile("(?<=[!-~¡-ԯ]) (?=[!-~¡-ԯ])")
WINDOW = 1 << 20  # bytes whose owners are held at once
REMEMBERED, SHORT = 200_000, 64  # parts remembered, and their most characters
JOINED = 200_000  # characters of texts or parts that are aligned in one go

ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, overlaps array<struct<a:int,b:int>>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


def byte_letters() -> dict[str, int]:
    """The byte of each letter in which byte-level vocabularies are written: visible Latin-1 characters stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both sides: A is byte-level BPE (a JSON file), B sentence pieces (a model file) that put a space before the text."""

    def __init__(self, a: str | None = None, b: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.path = a or tokens.vocabulary("byte_bpe_50k.json")
        letters = byte_letters()
        vocabulary = Tokenizer.from_file(self.path).get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b or tokens.vocabulary("piece_bpe_32k.model"))
        name = self.pieces.id_to_piece
        self.b_bytes = [bytes([int(name(i)[3:-1], 16)]) if self.pieces.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.pieces.get_piece_size())]
        self.a_length = np.fromiter(map(len, self.a_bytes), dtype=np.int64)
        self.b_length = np.fromiter(map(len, self.b_bytes), dtype=np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of both sides for each text, and whether both give the bytes of space + text."""
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1)):
            a = tokens.encode(" " + text, self.path)
            raw = (" " + text).encode()
            yield a, b, b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])


@lru_cache(maxsize=2)
def tokenizers(a: str | None = None, b: str | None = None) -> Tokenizers:
    return Tokenizers(a, b)


def pair_bound(a_bytes: list[bytes], b_bytes: list[bytes]) -> int:
    """How many pairs of the two vocabularies can end together, at most: those of which one's bytes end the other's."""
    from collections import Counter

    in_a, in_b = Counter(filter(None, a_bytes)), Counter(filter(None, b_bytes))
    ends = lambda one, other, first: sum(n * other[x[k:]] for x, n in one.items() for k in range(first, len(x)))
    return ends(in_a, in_b, 0) + ends(in_b, in_a, 1)


def _owners(ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """Index of the token that covers each byte of [low, high)."""
    first, last = np.searchsorted(ends, (low, high - 1), side="right")
    edges = np.clip(np.concatenate([[low], ends[first : last + 1]]), low, high)
    return np.repeat(np.arange(first, last + 1), np.diff(edges))


def overlaps(a_length: np.ndarray, b_length: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token indices (a, b) of each overlap in order, and whether both tokens end with it. Both sides have as many bytes."""
    a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
    total = int(a_end[-1]) if len(a_end) else 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, total, window):
        a, b = (_owners(e, low, min(low + window, total)) for e in (a_end, b_end))
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        if found and found[-1][0][-1] == a[0] and found[-1][1][-1] == b[0]:
            new[0] = False  # the overlap goes on from the window before
        if new.any():
            found.append((a[new], b[new]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return a, b, np.concatenate([(a[1:] != a[:-1]) & (b[1:] != b[:-1]), [True]])


def _aligned(pair: Tokenizers, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return overlaps(pair.a_length[a], pair.b_length[b])


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, ids of both sides, the number of tokens of each side up to each cut, and the overlaps as positions of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(a, b)
        for batch in batches:
            for i, doc in enumerate(batch.column(0)):
                body = batch.column(1)[i].as_py()
                ids = next(pair.encode([body])) if body else ([], [], False)
                one, two = (np.array(x if ids[2] else [], dtype=np.int64) for x in ids[:2])
                x, y, cut = _aligned(pair, one, two)
                lists = [one, two, x[cut] + 1, y[cut] + 1]
                each = pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], ["a", "b"])
                columns = [pa.array([doc.as_py()], pa.int64()), *(pa.array([v.astype(np.int32)], pa.list_(pa.int32())) for v in lists), pa.ListArray.from_arrays([0, len(each)], each)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts", "overlaps"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, ALIGNED)


def _edged(part: str) -> bool:
    """Whether a part can stand between others, spaces between them."""
    return all("!" <= c <= "~" or "¡" <= c <= "ԯ" for c in (part[0], part[-1]))


class Parts:
    """What the last parts of texts come to: numbers of tokens and groups, the groups as text, and the linked id pairs."""

    def __init__(self, pair: Tokenizers, remembered: int = REMEMBERED):
        self.pair, self.remembered, self.known = pair, remembered, {}

    def _learn(self, parts: list[str]) -> None:
        """New parts are joined and aligned in one go: the spaces that join them are boundaries of both sides."""
        alone, joined, n = [p for p in parts if not _edged(p)], [[]], 0
        for part in sorted((p for p in parts if _edged(p)), key=lambda p: not p.isascii()):
            if n > JOINED or joined[-1] and part.isascii() != joined[-1][0].isascii():
                joined, n = [*joined, []], 0
            joined[-1].append(part)
            n += len(part)
        for group in (*filter(None, joined), *([p] for p in alone)):
            self._learn_joined(group)

    def _learn_joined(self, parts: list[str]) -> None:
        a, b, same = next(self.pair.encode([" ".join(parts)]))
        if not same:
            if len(parts) == 1:
                self.known[parts[0]] = None
            else:
                for part in parts:
                    self._learn_joined([part])
            return
        one, two = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        x, y, cut = _aligned(self.pair, one, two)
        x, y = x[cut], y[cut]
        links = (one[x] * len(self.pair.b_bytes) + two[y]).tolist()
        ids_a, ids_b, groups, i, j = list(map(str, a)), list(map(str, b)), [], 0, 0
        for k, m in zip((x + 1).tolist(), (y + 1).tolist()):
            groups.append(f"{ids_a[i]}|{ids_b[j]}" if k == i + 1 and m == j + 1 else ",".join(ids_a[i:k]) + "|" + ",".join(ids_b[j:m]))
            i, j = k, m
        # a part and the space before it end with a cut
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        last_a = np.searchsorted(np.cumsum(self.pair.a_length[one]), ends)
        last = np.searchsorted(x, last_a)
        low = g = h = 0
        for part, up, at_a, at_b in zip(parts, (last + 1).tolist(), (last_a + 1).tolist(), (y[last] + 1).tolist()):
            self.known[part] = (at_a - g, at_b - h, up - low, ";".join(groups[low:up]).encode(), tuple(links[low:up]))
            low, g, h = up, at_a, at_b

    def of(self, texts: list[str]) -> list[list[tuple] | None]:
        """For each text one tuple a part, or None where a side does not give its bytes back."""
        if len(self.known) > self.remembered:
            self.known.clear()
        known, split = self.known, [BETWEEN.split(t) for t in texts]
        missing = list(dict.fromkeys(p for parts in split for p in parts if p not in known))
        self._learn(missing)
        out = [[known[p] for p in parts] for parts in split]
        for part in missing:
            if len(part) > SHORT:
                del known[part]
        return [None if None in parts else parts for parts in out]


def _slices(texts: list[str], most: int = JOINED) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that have about ``most`` characters, one text at least."""
    low = n = 0
    for i, text in enumerate(texts):
        n += len(text)
        if n >= most:
            yield low, i + 1
            low, n = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, numbers of tokens, groups and links, the SHA-256 of the groups, and each link as ``a id * size of B + b id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(tokenizers(a, b))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for low, high in _slices(texts):
                rows, links = [], []
                some = [t for t in texts[low:high] if t]
                found = iter(parts.of(some))
                for doc, text in zip(batch.column(0)[low:high].to_pylist(), texts[low:high]):
                    own = next(found) if text else None
                    if own is None:
                        rows.append((doc, 0, 0, 0, 0, ""))
                        links.append(())
                        continue
                    n_a, n_b, n_groups, groups, linked = zip(*own)
                    links.append(list(chain.from_iterable(linked)))
                    rows.append((doc, sum(n_a), sum(n_b), sum(n_groups), len(links[-1]), hashlib.sha256(b";".join(groups)).hexdigest()))
                edges = np.cumsum([0, *map(len, links)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(links), dtype=np.int64, count=edges[-1])
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 5, pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, DIGEST)


def pair_counts(digests: DataFrame, b_size: int) -> DataFrame:
    """(link, count, best): how often each id pair is linked in all rows, and whether its B id has no more frequent partner."""
    counts = digests.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("count"))
    counts = stage(counts, "pair-counts")
    most = counts.groupBy((F.col("link") % b_size).alias("b_id")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.col("link") % b_size == F.col("b_id")).select("link", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def link_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """The rows of digest() without their links, with n_best (links whose pair is its B id's most frequent one) and count_sum (of the links' counts)."""
    digests = stage(digest(docs, id_col, text, a, b).withColumn("row", F.monotonically_increasing_id()), "alignments")
    counts = pair_counts(digests, tokenizers(a, b).pieces.get_piece_size())
    # bounded by pair_bound() of the vocabularies, so broadcast at any size of the corpus
    scored = digests.select("row", F.explode("links").alias("link")).join(F.broadcast(counts), "link")
    scored = scored.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return digests.drop("links").join(scored, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_token_alignment(spark, sf_dir):
    return link_scores(table(spark, sf_dir, "documents"))
