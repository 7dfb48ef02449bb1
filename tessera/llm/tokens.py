"""Tokenizer files and the encoders that executors load once for each worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256


def path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str, folder: str | None = None, special_as_text: bool = False):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path(name, folder))
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = special_as_text
    return found


class ByteBpe:
    """Ids of ``byte_bpe_50k``: its ranks where they suffice, the tokenizer file itself otherwise.

    Both give the same ids.  Texts that spell the special token go to the
    tokenizer file, which decides what they mean; so do texts on which the
    faster encoder gives up.
    """

    def __init__(self, folder: str | None = None, special_as_text: bool = False):
        import public_tokenizers
        import tiktoken

        with open(path("byte_bpe_50k.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special_as_text = special_as_text
        self.folder = folder

    def encode(self, text: str) -> np.ndarray:
        if self.special_as_text or END_OF_TEXT not in text:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as error:  # the encoder's panics are no Exceptions
                if type(error).__name__ != "PanicException" and not isinstance(error, (ValueError, RuntimeError)):
                    raise
        ids = library("byte_bpe_50k.json", self.folder, self.special_as_text).encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(folder: str | None = None, special_as_text: bool = False) -> ByteBpe:
    return ByteBpe(folder, special_as_text)
