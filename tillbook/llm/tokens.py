"""Token ids of whole texts, as Arrow batches inside tasks."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

# The string that the vocabulary file reserves; its id follows the ordinary ranks.
SPECIAL = "<|endoftext|>"
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 2


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file on this machine; only ever asked for inside a task."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by a file of byte-pair ranks; the reserved string is one id, as in the same vocabulary's JSON file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)}
    )
    return lambda text: encoding.encode(text, allowed_special="all") if SPECIAL in text else encoding.encode_ordinary(text)


def token_arrays(texts: Iterator[str | None], path: str | None = None, end: int | None = END) -> Iterator[np.ndarray]:
    """Unsigned 32-bit ids of each text (null: empty), with ``end`` appended unless it is None."""
    encode = encoder(path or vocabulary_path())
    tail = [] if end is None else [end]
    for text in texts:
        yield np.array(encode(text or "") + tail, "<u4")
