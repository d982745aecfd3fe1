"""Byte-level BPE encoding of whole texts, with a bounded cache of frequent words."""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np

#: Texts with other white space than single blanks and line ends between words, or a special token's string.
_ODD = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]\Z|<\|endoftext\|>")
EOT = "<|endoftext|>"


class _Cache(dict):
    """word -> its ids as little-endian 32-bit bytes; stops growing at `most` words."""

    def __init__(self, encode, before: str, most: int):
        super().__init__()
        self.encode, self.before, self.most = encode, before, most

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(self.before + word), np.uint32).tobytes()
        if len(self) < self.most:
            self[word] = ids
        return ids


class ByteBpe:
    """The ids `tokenizers` gives with add_special_tokens=False for the same vocabulary.

    A token never spans the edge between a word and the white space after it, so a text whose words
    stand apart by single blanks and line ends is encoded word by word; any other text goes whole."""

    def __init__(self, ranks_path: str, pattern: str, most_words: int = 200_000):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={EOT: len(ranks)})
        plain = self.bpe.encode_ordinary
        self.first, self.later = _Cache(plain, "", most_words), _Cache(plain, " ", most_words)
        self.line_end = np.array(plain("\n"), np.uint32).tobytes()
        self.sizes = np.zeros(len(ranks) + 1, np.int64)  # bytes of each token
        for raw, i in ranks.items():
            self.sizes[i] = len(raw)
        self.sizes[len(ranks)] = len(EOT)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            text = text.encode("utf-8", "replace").decode() if not text.isascii() else text
            return np.array(self.bpe.encode(text, allowed_special={EOT}), np.uint32).tobytes()
        first, later = self.first, self.later.__getitem__
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(b"".join(chain((first[words[0]],), map(later, words[1:]))))
        return self.line_end.join(lines)


_LOADED: dict[tuple, ByteBpe] = {}


def byte_bpe(path: str | None = None) -> ByteBpe:
    """One encoder for each worker process and vocabulary file."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path, public_tokenizers.PATTERN)
    return _LOADED[path]
