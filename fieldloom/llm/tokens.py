"""Token ids of a byte-level BPE file, as the library for it gives them.

Files of the common kind (byte-level split, no normaliser, plain special strings) are
read into rank tables for a faster encoder of the same algorithm. Its split pattern is
used for texts of ASCII and Latin letters, where both agree on the class of every
character; other texts, and other kinds of files, go through the library itself.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np

#: Control characters that engines class differently are left out.
LATIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-ɏ]*")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids`` of whole texts; special strings in them count as special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(Path(path).read_text())
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        usual = (
            split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
            and spec.get("normalizer") is None
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and not any(t[f] for t in spec.get("added_tokens", []) for f in flags)
        )
        if not usual:
            return None
        import public_tokenizers
        import tiktoken

        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in w): i for w, i in model["vocab"].items() if w not in self.special}
        return tiktoken.Encoding(
            "read", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special
        )

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.fast and (text.isascii() or LATIN.fullmatch(text)):
                out.append(np.array(self.fast.encode(text, allowed_special="all", disallowed_special=()), np.uint32))
            else:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
        return out

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Where pieces of the split begin: (code point, tokens before it), and the token count.

        No token crosses such a place, and what follows it depends on the text from
        there on alone.
        """
        found = self.library.encode(text, add_special_tokens=False)
        words = found.word_ids
        starts = [i for i, w in enumerate(words) if i == 0 or w is None or w != words[i - 1]]
        offsets = found.offsets
        return np.array([offsets[i][0] for i in starts], np.int64), np.array(starts, np.int64), len(words)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
