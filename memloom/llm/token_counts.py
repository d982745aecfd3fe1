"""Token counts by offset-mapped attribution (operator 10).

Each document is encoded once as a whole. Token character spans follow from the token sizes; sections
are spans too, and the two are interval-joined by a sorted search. A token that crosses a boundary goes
to the section holding its first byte (`rule="start"`), its last byte (`"end"`), or its larger part,
the earlier one on a tie (`"larger"`).

Sections are the lines of a text, each with its line end (`sections`), or the fields of a record, joined and encoded as
one text (`fields`). Defined cases: null or empty text: one
empty section, no tokens; rows that repeat a doc_id are counted one by one; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.tokens import byte_bpe


@dataclass(frozen=True)
class AttributionConfig:
    rule: str = "start"
    vocabulary: str | None = None


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary). ends: byte end of each token; bounds:
    byte starts of the sections, the first 0."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    a = np.searchsorted(bounds, starts, side="right") - 1
    b = np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right") - 1
    if rule == "start":
        return a, a != b
    if rule == "end":
        return b, a != b
    place, cross = a.copy(), a != b
    for i in np.flatnonzero(cross):
        edge = np.concatenate([[starts[i]], bounds[a[i] + 1 : b[i] + 1], [ends[i]]])
        place[i] = a[i] + int(np.diff(edge).argmax())
    return place, cross


def _lines(raw: np.ndarray) -> np.ndarray:
    """Byte starts of the lines of a text."""
    return np.concatenate([[0], np.flatnonzero(raw[:-1] == 10) + 1]).astype(np.int64)


def _counted(ids: pd.Series, texts: pd.Series, starts: list[np.ndarray] | None, cfg: AttributionConfig) -> Iterator[pd.DataFrame]:
    """One row for each section of each text, some ten thousand at a time. starts: byte starts of the sections, or lines."""
    bpe, out, held = byte_bpe(cfg.vocabulary), [], 0
    for k, (i, text) in enumerate(zip(ids, texts, strict=True)):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        ends = np.cumsum(bpe.sizes[np.frombuffer(bpe.encode(text), np.uint32)])
        bounds = _lines(raw) if starts is None else starts[k]
        place, cross = attribute(ends, bounds, cfg.rule)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        edge = chars[np.append(bounds, len(raw))]
        m = len(bounds)
        out.append(
            pd.DataFrame(
                {"doc_id": i, "section": np.arange(m), "start": edge[:-1], "end": edge[1:], "n_tokens": np.bincount(place, minlength=m),
                 "n_crossing": np.bincount(place[cross], minlength=m), "doc_tokens": len(ends)}
            )
        )
        held += m
        if held > 20000:
            yield pd.concat(out, ignore_index=True).astype({"doc_id": "Int64"})
            out, held = [], 0
    if out:
        yield pd.concat(out, ignore_index=True).astype({"doc_id": "Int64"})


_SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def sections(docs: DataFrame, cfg: AttributionConfig = AttributionConfig()) -> DataFrame:
    """doc_id, section (from 0), start, end (code points), n_tokens, n_crossing, doc_tokens, by lines."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield from _counted(pdf["doc_id"], pdf["text"], None, cfg)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, _SCHEMA)


def fields(docs: DataFrame, names: list[str], between: str = "\n", cfg: AttributionConfig = AttributionConfig()) -> DataFrame:
    """doc_id, field, and the columns of `sections`: the fields of a record are joined by `between`, encoded once as one
    text, and its tokens are attributed to the fields; a separator belongs to the field before it. Null fields are empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = len(between.encode())
        for pdf in it:
            sizes = np.array([[len(p.encode("utf-8", "replace")) + gap for p in row] for row in pdf["parts"]], np.int64).reshape(len(pdf), len(names))
            starts = np.cumsum(sizes, axis=1) - sizes
            yield from _counted(pdf["doc_id"], pd.Series([between.join(row) for row in pdf["parts"]]), list(starts), cfg)

    got = docs.select(F.col("doc_id").cast("long"), F.array(*parts).alias("parts")).mapInPandas(run, _SCHEMA)
    return got.select("doc_id", F.get(F.array(*[F.lit(c) for c in names]), F.col("section").cast("int")).alias("field"), *got.columns[1:])


def op10(docs: DataFrame, cfg: AttributionConfig = AttributionConfig()) -> DataFrame:
    return sections(docs, cfg)
