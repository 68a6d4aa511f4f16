"""Byte-level BPE ids of a public vocabulary, exact to the `tokenizers` library's."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Below this code point both libraries split text by the same tables; anything above goes to `tokenizers` itself.
PLAIN_BELOW = "԰"
#: Longer texts without a break could take quadratic time in the fast path.
PLAIN_CHARS = 1_000_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _slow(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@lru_cache(maxsize=2)
def _plain(path: str):
    """The file's tokenizer as it is, and what its added tokens look like in a text; None where that depends on a normalizer."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    added = made.get_added_tokens_decoder().values()
    return made, None if any(t.normalized for t in added) else tuple(t.content for t in added)


@lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary as ranks, or None where only the JSON file exists."""
    import os

    import public_tokenizers
    import tiktoken

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    with open(ranks, "rb") as f:
        pairs = dict((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f))
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})


def encode(text: str, path: str | None = None) -> list[int]:
    path = path or vocabulary()
    if text and len(text) < PLAIN_CHARS and max(text) < PLAIN_BELOW and (fast := _fast(path)) is not None:
        return fast.encode_ordinary(text)
    return _slow(path).encode(text, add_special_tokens=False).ids


def ids(text: str, path: str | None = None) -> list[int]:
    """The file's own ids: an added token in the text, as <|endoftext|>, is one id, where encode() takes it as plain characters."""
    path = path or vocabulary()
    plain, added = _plain(path)
    if added is None or any(content in text for content in added):
        return plain.encode(text, add_special_tokens=False).ids
    return encode(text, path)
