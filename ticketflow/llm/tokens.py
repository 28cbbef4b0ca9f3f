"""Token ids of whole texts by a byte-level BPE file, and how documents become pieces of bounded length."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np

CAPACITY, END = 1024, 2


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on this machine; tasks call it, since each machine has its own."""
    import public_tokenizers
    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of a `tokenizers` file with byte-level pre-tokens, as little-endian unsigned 32-bit bytes.

    Whole texts are encoded with the same vocabulary in the form of ranks, which takes a fraction of the time and gives the same
    ids (tested); where there is no such file, and for texts that its pattern can't take apart, with the `tokenizers` file itself.
    """

    def __init__(self, path: str):
        self.path, self._whole, self._by_rank = path, None, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._by_rank = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def whole(self, text: str) -> bytes:
        """By the `tokenizers` file."""
        if self._whole is None:
            from tokenizers import Tokenizer
            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = True
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, text: str) -> bytes:
        if self._by_rank is None:
            return self.whole(text)
        try:
            return self._by_rank.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # a run of very many blanks
            return self.whole(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; special strings are ordinary text."""
        return [self.one(t) if t else b"" for t in texts]


@cache
def worker_encoder(file: str) -> ByteBpe:
    """One encoder for all tasks of a worker."""
    return ByteBpe(vocabulary(file))


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: all but the first are full."""
    head = n % capacity or capacity
    return [(0, min(n, head)), *[(s, capacity) for s in range(head, n, capacity)]] if n else []
