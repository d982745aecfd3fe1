"""SentencePiece encoding and decoding over a trie of distinct words (operator 7).

The distinct marked words of a batch are sorted, which lays them out as a trie, and traversed
depth-first: the forward state of a prefix is kept on a stack and reused by every word that shares it.
The public model is of the merge kind, whose segmentation is not the one of largest summed score, so
the forward state is not a best sum but the last piece of the prefix's own encoding: piece t can end a
prefix exactly if the prefix before it encodes to pieces ending in p and the pair (p, t) is left alone
by the merges. That choice is unique, and following it back gives the library's ids.

Decoding maps pieces to text, byte pieces to bytes, and drops the mark put before the text.

Defined cases: null or empty text: no pieces; any text round-trips by byte pieces but for a literal U+2581, which reads back as a blank; a null doc_id passes through; rows that
repeat a doc_id are encoded one by one; empty table: empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import ints

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


@dataclass(frozen=True)
class PieceConfig:
    model: str | None = None  # path; None: the public piece_bpe_32k
    most_words: int = 200_000  # words whose ids a worker keeps


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -sp.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        of_byte = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([of_byte[i]]) if i in of_byte else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.alone: dict[tuple[str, str], bool] = {}
        self.steps: dict[str, tuple[str, tuple[tuple[str, int], ...]]] = {}
        self.packed: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The merges themselves, on a short string: the best-ranked neighbouring pair first, leftmost on a tie."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(np.inf, 0))
            if best[0] == np.inf:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def apart(self, p: str, t: str) -> bool:
        key = (p, t)
        got = self.alone.get(key)
        if got is None:
            got = self.merge(p + t) == ([p, t] if p else [t])
            if len(self.alone) < 300_000:
                self.alone[key] = got
        return got

    def _step(self, read: str) -> tuple[str, tuple[tuple[str, int], ...]]:
        """The longest end of `read` that starts a piece, and the pieces that `read` ends with, longest first."""
        rest = read
        while rest and rest not in self.starts:
            rest = rest[1:]
        ends = tuple((rest[i:], len(rest) - i) for i in range(len(rest)) if rest[i:] in self.ids)
        if not ends or ends[-1][1] > 1:
            ends += ((read[-1], 1),)
        if len(self.steps) < 300_000:
            self.steps[read] = rest, ends
        return rest, ends

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """ids (little-endian, 32 bits) of each distinct word, by depth-first traversal of their trie."""
        out, last, states, before = {}, [""], [""], ""
        steps, alone, packed = self.steps.get, self.alone.get, self.packed
        for word in sorted(words):
            depth = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                depth += 1
            del last[depth + 1 :], states[depth + 1 :]
            state = states[-1]
            for d in range(depth + 1, len(word) + 1):
                read = state + word[d - 1]
                state, ends = steps(read) or self._step(read)
                for piece, n in ends:
                    p = last[d - n]
                    left = alone((p, piece))
                    if self.apart(p, piece) if left is None else left:
                        break
                else:
                    piece = word[d - 1]
                last.append(piece)
                states.append(state)
            parts, d = [], len(word)
            while d:
                piece = last[d]
                parts.append(packed.get(piece) or self._pack(piece))
                d -= len(piece)
            parts.reverse()
            out[word] = b"".join(parts)
            before = word
        return out

    def _pack(self, piece: str) -> bytes:
        i = self.ids.get(piece)
        ids = [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        got = np.array(ids, "<u4").tobytes()
        if len(self.packed) < 300_000:
            self.packed[piece] = got
        return got

    def encode_batch(self, texts: list[str], most: int) -> list[bytes]:
        """Packed ids of each text; words are kept for later batches until there are `most` of them."""
        known = self.known
        split = [_WORDS(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = self.encode_words([w for w in set(chain.from_iterable(split)) if w not in known])
        known.update(islice(fresh.items(), max(0, most - len(known))))
        return [b"".join([known.get(w) or fresh[w] for w in s]) for s in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "surrogatepass")[1:]


_MODELS: dict[str, PieceModel] = {}


def model(path: str | None) -> PieceModel:
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def op7(docs: DataFrame, cfg: PieceConfig = PieceConfig()) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), round_trip (decoding gives the text)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(cfg.model)
        for pdf in it:
            rows = []
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a : a + 1000]
                texts = list(part["text"])
                for i, t, ids in zip(part["doc_id"], texts, m.encode_batch(texts, cfg.most_words), strict=True):
                    rows.append((i, len(ids) // 4, zlib.crc32(ids), m.decode(ids) == t))
            out = pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "round_trip"])
            yield out.assign(doc_id=ints([r[0] for r in rows]))

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
