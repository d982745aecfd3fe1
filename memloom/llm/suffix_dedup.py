"""Removal of repeated 400-byte strings by column-wise multi-document BWT construction (operator 4).

Strings that repeat anywhere in the corpus are found in three steps.

1. Anchors. Each 400-byte window names the position of the least hash among its 64-byte grams, which
   depends on the window's bytes alone: equal windows name equal grams at equal offsets. A run of
   windows with one anchor is a *context*: the bytes from the first start to the last start + 400.
   Anchors are counted over the corpus; only those that occur twice or more go on.
2. Contexts that are equal as a whole (counted with map-side combine) repeat in full. The distinct
   contexts of an anchor are aligned on it and become the documents of a column-wise construction:
   each round inserts one symbol per document, right to left, keeping the sorted order of all current
   suffixes (the BWT of the column is the next symbol in that order) and, beside it, their common
   prefixes. A stable pass over the column's symbols gives the next order; the common prefix of new
   neighbours is one more than the least prefix between their old places. A start repeats where the
   prefix shared with a neighbour reaches 400. Columns are the sequential files; a bucket's columns
   are of bounded size and are read once, in order.
3. Repeated starts become byte spans of every occurrence, merged per document.

Anchors with more than `most_contexts` distinct contexts (a passage in very many documents) are decided
by counting a 128-bit hash of each of their windows instead, which needs no bucket to hold them.

Defined cases: null text: empty, nothing removed; texts shorter than 400 bytes: untouched; rows that
repeat a doc_id are documents of their own (equal rows remove each other's bytes); a null doc_id takes
part; text that is not valid UTF-8 cannot occur in a string column; empty table: empty result. Where
`remove_repeats` cuts inside a character, that character's leftover bytes go too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import discard, give_back, ints, prefix_hash, row_key, small_batches, span_hash, stage, whole_row, with_text


@dataclass(frozen=True)
class RepeatConfig:
    length: int = 400  # bytes of a string that may not repeat
    gram: int = 64  # bytes of an anchor
    bucket: int = 4000  # distinct contexts of one construction, about
    most_contexts: int = 20000  # of one anchor; beyond it, windows are counted


_IDX = np.uint64((1 << 22) - 1)
PIECE = 1 << 21


def anchors(texts: list[bytes], cfg: RepeatConfig) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, anchor position, first start, last start), in byte offsets of the text."""
    W, k = cfg.length, cfg.gram
    w = W - k + 1
    lens = np.array([len(t) for t in texts], np.int64)
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens, out=base[1:])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < W:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    pre = prefix_hash(buf)
    at = np.arange(len(buf) - k + 1)
    h = span_hash(pre, at, at + k)
    v = (h & ~_IDX) | at.astype(np.uint64)
    pad = -len(v) % w
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.concatenate([np.arange(a, b - W + 1) for a, b in zip(base[:-1], base[1:], strict=True)])
    least = np.minimum(back[starts], fore[starts + w - 1])
    pos = (least & _IDX).astype(np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos)) - 1
    p, lo, hi = pos[first], starts[first], starts[last]
    doc = np.searchsorted(base, lo, side="right") - 1
    return doc, h[p].view(np.int64), p - base[doc], lo - base[doc], hi - base[doc]


def pieces(raw: bytes, cfg: RepeatConfig) -> list[tuple[int, bytes]]:
    """A long text in parts that hold each window exactly once."""
    if len(raw) <= PIECE:
        return [(0, raw)]
    return [(a, raw[a : a + PIECE + cfg.length - 1]) for a in range(0, len(raw) - cfg.length + 1, PIECE)]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its join key (id0, th) and text; equal rows share a key and are equal in all results."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.coalesce("text", F.lit("")).alias("text"))


def occurrences(docs: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """Every context of every text: ah (anchor hash), ch (hash of the context and its alignment),
    id0, th, pos, lo, hi."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            keys = list(zip(pdf["id0"], pdf["th"], strict=True))
            for ids, raws in small_batches(keys, list(pdf["text"])):
                parts = [(i, a, part) for i, raw in zip(ids, raws, strict=True) if len(raw) >= cfg.length for a, part in pieces(raw, cfg)]
                for group in [parts] if len(parts) <= 1 or sum(len(x[2]) for x in parts) <= PIECE else [[x] for x in parts]:
                    doc, ah, pos, lo, hi = anchors([x[2] for x in group], cfg)
                    if not len(doc):
                        continue
                    ch = [
                        hashlib.blake2b(group[d][2][a : b + cfg.length], digest_size=16, salt=(p - a).to_bytes(4, "little")).digest()
                        for d, p, a, b in zip(doc.tolist(), pos.tolist(), lo.tolist(), hi.tolist(), strict=True)
                    ]
                    off = np.array([x[1] for x in group])[doc]
                    yield pd.DataFrame(
                        {"ah": ah, "ch": ch, "id0": np.array([x[0][0] for x in group])[doc], "th": np.array([x[0][1] for x in group])[doc], "pos": pos + off, "lo": lo + off, "hi": hi + off}
                    )
        give_back()

    return docs.where(F.octet_length("text") >= cfg.length).mapInPandas(run, "ah long, ch binary, id0 long, th long, pos long, lo long, hi long")


def column_repeats(mat: np.ndarray, length: int, starts: int) -> np.ndarray:
    """flags[i, c]: the string of `length` symbols at column c of row i is another row's at column c too.

    One symbol of each row is inserted per round, from the last column to the first. `order` holds the
    rows by their suffix at the current column, `div` the column where each differs from the one before."""
    m, n = mat.shape
    cols = np.ascontiguousarray(mat.T)
    order, div = np.arange(m), np.full(m, n, np.int32)
    flags = np.zeros((starts, m), bool)
    for c in range(n - 1, -1, -1):
        bwt = cols[c][order]
        to = np.argsort(bwt, kind="stable")
        sym = bwt[to]
        new = np.full(m, c, np.int32)
        same = np.flatnonzero(sym[1:] == sym[:-1]) + 1
        a, b = to[same - 1] + 1, to[same]
        gap = b - a + 1
        low = div[b]
        wide = np.flatnonzero(gap > 1)
        if len(wide):  # least divergence between the old places, by doubling
            level, step, table = np.log2(gap[wide]).astype(np.int64), 1, div
            for lv in range(int(level.max()) + 1):
                if lv:
                    table = np.minimum(table[:-step], table[step:])
                    step *= 2
                now = wide[level == lv]
                if len(now):
                    low[now] = np.minimum(table[a[now]], table[b[now] - step + 1])
        new[same] = low
        order, div = order[to], new
        if c < starts:
            near = div - c >= length
            hit = near.copy()
            hit[:-1] |= near[1:]
            flags[c][order] = hit
    return flags.T


def runs(flags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first, last) of each run of set flags."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return zip(r.tolist(), a.tolist(), (b - 1).tolist(), strict=True)


def repeated_spans(keys: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """id0, th, spans (array of start, end) of the texts that lose bytes: the byte ranges to remove, unmerged. A staged
    table, so that the shuffled texts of the search are gone before the spans meet the rows."""
    W, span = cfg.length, cfg.length - cfg.gram  # an anchor lies at most `span` bytes after a start
    found = stage(occurrences(keys, cfg), "anchors")
    often = (
        found.groupBy("ah").agg(F.count("*").alias("n"), F.min("ch").alias("least"), F.max("ch").alias("most"))
        .where("n > 1").select("ah", (F.col("least") == F.col("most")).alias("uniform"))
    )
    often = stage(often, "often")  # a table of its own, so that the rows of a hot anchor can be split in the join
    occ = stage(found.join(often, "ah"), "repeated")
    discard(found, often)
    whole = occ.where("uniform").select("id0", "th", F.col("lo").alias("a"), (F.col("hi") + W).alias("b"))
    mixed = occ.where("not uniform")
    ctx = mixed.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("id0", "th", "pos", "lo", "hi")).alias("rep"))
    size = ctx.groupBy("ah").agg(F.count("*").alias("d"))
    ctx = stage(ctx.join(size, "ah").select("ah", "ch", "n", "d", "rep.*"), "contexts")
    total = ctx.where(F.col("d") <= cfg.most_contexts).count()
    buckets = max(1, -(-total // cfg.bucket))
    need = ctx.groupBy("id0", "th").agg(F.collect_list(F.struct("ah", "ch", "n", "d", "pos", "lo", "hi")).alias("need"))

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for text, need in zip(pdf["text"], pdf["need"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(x["ah"], x["ch"], x["n"], x["d"], x["lo"] - x["pos"] + span, raw[x["lo"] : x["hi"] + W]) for x in need]
            yield pd.DataFrame(rows, columns=["ah", "ch", "n", "d", "col", "bytes"])

    # rows with one key are equal: any of them gives the bytes
    texts = keys.select("id0", "th", "text").join(need, ["id0", "th"]).mapInPandas(cut, "ah long, ch binary, n long, d long, col long, bytes binary")

    def construct(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["ah", "ch"], ignore_index=True)
        mat = np.full((len(pdf), W + span), 255, np.uint8)  # 255 is in no UTF-8 text
        valid = np.zeros((len(pdf), span + 1), bool)
        for i, (col, raw) in enumerate(zip(pdf["col"], pdf["bytes"], strict=True)):
            mat[i, col : col + len(raw)] = np.frombuffer(raw, np.uint8)
            valid[i, col : col + len(raw) - W + 1] = True
        flags = (column_repeats(mat, W, span + 1) | (pdf["n"].to_numpy() > 1)[:, None]) & valid
        out = [(pdf["ah"][i], pdf["ch"][i], a, b) for i, a, b in runs(flags)]
        give_back()
        return pd.DataFrame(out, columns=["ah", "ch", "s", "e"])

    def windows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for ah, ch, n, col, raw in zip(pdf["ah"], pdf["ch"], pdf["n"], pdf["col"], pdf["bytes"], strict=True):
                count = len(raw) - W + 1
                yield pd.DataFrame(
                    {"ah": ah, "ch": [ch] * count, "n": n, "s": np.arange(col, col + count), "t": [hashlib.blake2b(raw[j : j + W], digest_size=16).digest() for j in range(count)]}
                )

    few = texts.where(F.col("d") <= cfg.most_contexts).withColumn("bucket", F.pmod("ah", F.lit(buckets)))
    rest: list[DataFrame] = []
    starts = few.groupBy("bucket").applyInPandas(construct, "ah long, ch binary, s long, e long")
    if not ctx.where(F.col("d") > cfg.most_contexts).isEmpty():
        rest = [stage(texts.where(F.col("d") > cfg.most_contexts).mapInPandas(windows, "ah long, ch binary, n long, s long, t binary"), "windows")]
        win = rest[0].dropDuplicates(["ah", "ch", "s"])
        more = win.groupBy("t").agg(F.sum("n").alias("n")).where("n > 1").select("t")
        starts = starts.union(win.join(more, "t").select("ah", "ch", "s", F.col("s").alias("e")))
    at = F.col("pos") - span
    part = mixed.join(starts, ["ah", "ch"]).select("id0", "th", (at + F.col("s")).alias("a"), (at + F.col("e") + W).alias("b"))
    spans = whole.union(part).groupBy("id0", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = stage(spans, "spans")
    discard(occ, ctx, *rest)
    return spans


def merged(spans: list | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans) if spans is not None else []:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def op4(docs: DataFrame, cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    keys = keyed(docs)
    rows = keys.join(repeated_spans(keys, cfg), ["id0", "th"], "left")

    def digest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
                raw, cut = text.encode("utf-8", "surrogatepass"), merged(spans)
                left = kept(raw, cut)
                out.append((len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest()))
            res = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            res.insert(0, "doc_id", ints(pdf["doc_id"]))
            yield res

    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # 64-bit ids beside nulls keep their digits
    return rows.select("doc_id", "text", "spans").mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """docs with the repeated strings cut out of text, and n_chars (where there is one) counted anew.
    A document with nothing left goes."""
    spans = repeated_spans(keyed(docs), cfg)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([kept(t.encode("utf-8", "surrogatepass"), merged(s)).decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)])

    rows = docs.select(whole_row(docs).alias("row"), *row_key()).join(spans, ["id0", "th"], "left")
    hit = F.col("spans").isNotNull()
    text = F.when(hit, cut(F.coalesce("row.text", F.lit("")), F.coalesce("spans", F.array())))
    rows = rows.withColumn("new", text).where(~hit | (F.length(F.trim("new")) > 0))
    return with_text(rows, docs, "row", hit, F.col("new"))
