"""Byte-level BPE: token ids of texts and of single pre-tokens.

The vocabulary file is in the format of the `tokenizers` library; merges are done by `tiktoken`, whose ids
are the same (tests/llm/test_text_operators.py) at several times the speed.
"""

from __future__ import annotations

import functools
import json

import numpy as np

#: The pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Vocabulary files write a byte as itself if it is printable, else as the next free character from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def load(path: str):
    """The encoder of a vocabulary file; one per Python worker."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    byte_of = _byte_of_char()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids(encoder, text: str) -> np.ndarray:
    """Token ids of a whole text; a special token's string is that token, as in the `tokenizers` library."""
    return np.asarray(encoder.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
