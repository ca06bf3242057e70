"""Byte-level BPE ids of whole texts.

The vocabulary is a ``tokenizers`` file with byte-level pre-tokens. Its entries
are the merge ranks of the same vocabulary, so ``tiktoken`` gives the ids that
``tokenizers`` gives (the tests hold both against each other), several times as
fast. A text with a very long run of white space, on which its pattern would
backtrack, goes to ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Pre-token pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_BLANK = re.compile(r"\s{500}")
_encoders: dict[str, Encoder] = {}


def byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in character of a byte-level vocabulary means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        special = {x["content"] for x in described.get("added_tokens", [])}
        byte = byte_of_char()
        ranks = {bytes(byte[c] for c in word): i for word, i in described["model"]["vocab"].items() if word not in special}
        self._fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._path, self._added, self._libraries = path, sorted(x["content"] for x in described.get("added_tokens", [])), {}

    def library(self, control: bool) -> object:
        if control not in self._libraries:
            from tokenizers import Tokenizer

            self._libraries[control] = Tokenizer.from_file(self._path)
            self._libraries[control].encode_special_tokens = not control
        return self._libraries[control]

    def encode(self, text: str | None, control: bool = False) -> np.ndarray:
        """Ids of one text as unsigned 32-bit integers; none for null or empty.

        With ``control`` an added token of the file that stands in the text gets its
        own id, as ``tokenizers`` has it by default; without, it is ordinary text.
        """
        if not text:
            return np.zeros(0, np.uint32)
        if _LONG_BLANK.search(text) or (control and any(x in text for x in self._added)):
            return np.array(self.library(control).encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast(text), np.uint32)


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
