"""Token ids of a public byte-level vocabulary."""

from __future__ import annotations

import base64
from array import array

import numpy as np

END = 0
SPECIAL = "<|endoftext|>"


def tokenizer_paths() -> dict[str, str]:
    import public_tokenizers

    return {name: public_tokenizers.path(f"byte_bpe_50k.{name}") for name in ("json", "tiktoken")}


class Tokens:
    """Ids of texts, without special tokens added.

    The ranks of the vocabulary give the ids of a whole text in one call, which
    takes less time than to cut it into words and to look up those met before.
    A text that holds the special token's string goes through the tokenizer file.
    """

    def __init__(self, paths: dict[str, str]):
        import public_tokenizers
        import tiktoken

        with open(paths["tiktoken"], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.whole = paths["json"], None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            found = self.whole.encode(text, add_special_tokens=False).ids
        else:
            found = self.coder.encode_ordinary(text)
        return np.frombuffer(array("H", found), dtype=np.uint16)
