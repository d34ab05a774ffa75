"""Byte-level BPE ids from a public tokenizer file."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
import tiktoken

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str = VOCABULARY) -> Callable[[str], list[int]]:
    """Ids of a text by the byte-level BPE of a ``tokenizers`` JSON file, special tokens recognised, none added.

    The file lists tokens in order of their merges, so ids serve as merge ranks; the
    ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    # Byte-level files write printable bytes as themselves and the rest as characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable}
    of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {
        bytes(map(of.__getitem__, token)): i for token, i in content["model"]["vocab"].items() if token not in special
    }
    coder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = tuple(special)

    def encode(text: str) -> list[int]:
        if any(m in text for m in marks):
            return coder.encode(text, allowed_special="all")
        return coder.encode_ordinary(text)

    return encode
