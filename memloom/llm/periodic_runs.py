"""Periodic runs of words by an enhanced suffix array (operator 13).

A text of n words gets a suffix array, its inverse (ISA) and the common prefixes of neighbours (LCP). A square whose next
word breaks its period (a branching tandem) of period p stands at i exactly if the suffixes i and i + p lie in the LCP interval of depth
p but in different children of it. So of each interval only the suffixes of the smaller children are looked at, and for
each the test is whether ISA[i + p] or ISA[i - p] lies inside the interval's bounds: no tree is built. Such a square ends its run;
it is rotated to the left as long as the words agree, which gives the run's start. Squares whose root is itself a power
of a shorter root end where that root's run ends, and merge into it.

Texts are handled in batches: a symbol is a pair of text and word, so that one array holds all texts of a batch and no
match crosses them. Nothing is shuffled.

Defined cases: null and empty text, and text of blanks: no words, no runs, collapsed text empty; a null doc_id passes
through; rows that repeat a doc_id are documents of their own; empty table: empty result; other columns are not read.
A text is held whole by its task (about 100 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import free_name, give_back, row_key, small_batches, whole_row, with_text


@dataclass(frozen=True)
class RunConfig:
    min_length: int = 6  # words of a run
    min_exponent: int = 4  # periods of a run, at least 2


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_order(sym: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks): ranks[t][i] names the group of suffixes that share their first 2^t symbols with suffix i.

    Only groups of several suffixes are sorted again in a round. Beyond the end there is a symbol larger than all."""
    n = len(sym)
    sa = np.argsort(sym, kind="stable")
    s = sym[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = s[1:] != s[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[n] = n
    ranks, k = [rank], 1
    while True:
        lone = fresh.copy()
        lone[:-1] &= fresh[1:]
        slots = np.flatnonzero(~lone)
        if not len(slots):
            return sa, ranks
        at = sa[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + k, n)]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[slots] = at
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        fresh[slots] = first
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(first, slots, 0))
        ranks.append(rank)
        k *= 2


def common_prefixes(sa: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """lcp[j]: symbols that suffixes sa[j - 1] and sa[j] share; lcp[0] is -1."""
    n = len(sa)
    a, b, lcp = sa[:-1], sa[1:], np.zeros(n - 1, np.int64)
    alive, pairs = [], np.arange(n - 1)
    for rank in ranks:
        pairs = pairs[rank[a[pairs]] == rank[b[pairs]]]
        alive.append(pairs)
    for t in range(len(ranks) - 1, -1, -1):
        p = alive[t]
        same = ranks[t][np.minimum(a[p] + lcp[p], n)] == ranks[t][np.minimum(b[p] + lcp[p], n)]
        lcp[p[same]] += 1 << t
    return np.concatenate([[-1], lcp])


def _last_below(v: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each place the last place before it with a value below (or at most) its own; v[0] is below all."""
    to = np.arange(-1, len(v) - 1)
    to[0] = 0
    left = np.arange(1, len(v))
    while len(left):
        over = v[to[left]] > v[left] if or_equal else v[to[left]] >= v[left]
        left = left[over]
        to[left] = to[to[left]]
    return to


def branching_tandems(sym: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that the next symbol breaks and that have `exponent` periods up to their end, sorted by period."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(sym)
    if n < exponent:
        return none
    sa, ranks = suffix_order(sym)
    isa = np.full(n, 0, np.int64)
    isa[sa] = np.arange(n)
    lcp = common_prefixes(sa, ranks)
    before = _last_below(lcp, True)
    cuts = np.flatnonzero((lcp > 0))
    if not len(cuts):
        return none
    lo = _last_below(lcp, False)
    back = np.concatenate([[-1], lcp[:0:-1]])  # lcp from the right
    hi = n - 1 - _last_below(back, False)[::-1]  # next place with a smaller value is hi + 1 of the place
    hi = np.concatenate([[n - 1], hi[:-1]])
    # one interval has the cuts of equal value in a row: the first of them names it
    head = np.where(lcp[before] == lcp, before, np.arange(n))
    while (head[head] != head).any():
        head = head[head]
    cuts = cuts[hi[cuts] - lo[cuts] + 1 >= exponent]
    if not len(cuts):
        return none
    order = np.lexsort((cuts, head[cuts]))
    cuts = cuts[order]
    own = head[cuts]
    opens = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    count = np.diff(np.append(opens, len(cuts)))
    L, R, depth = lo[cuts[opens]], hi[cuts[opens]], lcp[cuts[opens]]
    # children: from each bound to the next
    which = np.repeat(np.arange(len(opens)), count + 1)
    begin = np.insert(cuts, opens, L)
    end = np.append(begin[1:] - 1, 0)
    last = np.cumsum(count + 1) - 1
    end[last] = R
    size = end - begin + 1
    top = np.maximum.reduceat(size, last - count)
    largest = np.flatnonzero(size == top[which])
    largest = largest[np.concatenate([[True], which[largest][1:] != which[largest][:-1]])]
    small = np.ones(len(size), bool)
    small[largest] = False
    begin, size, which = begin[small], size[small], which[small]
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    i, which = sa[at], np.repeat(which, size)
    p, low, high = depth[which], L[which], R[which]
    padded = np.append(sym, -1)

    def inside(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = isa[np.clip(place, 0, n - 1)]
        return (place >= 0) & (place < n) & (x >= low) & (x <= high)

    ahead = inside(i + p, low, high) & (padded[np.minimum(i + 2 * p, n)] != padded[np.minimum(i + p, n)])
    behind = inside(i - p, low, high) & (padded[np.minimum(i + p, n)] != padded[i])
    start = np.concatenate([i[ahead], (i - p)[behind]])
    p, low, high = (np.concatenate([x[ahead], x[behind]]) for x in (p, low, high))
    for k in range(1, exponent - 1):  # the periods before the square
        ok = inside(start - k * p, low, high)
        start, p, low, high = start[ok], p[ok], low[ok], high[ok]
    both = np.unique(np.stack([p, start]), axis=1)
    return both[1], both[0]


def rotated(sym: np.ndarray, i: int, p: int) -> int:
    """The least start to which the square of period p at i can be rotated."""
    step = 64
    while i > 0:
        lo = max(0, i - step)
        diff = np.flatnonzero(sym[lo:i] != sym[lo + p : i + p])
        if len(diff):
            return lo + int(diff[-1]) + 1
        i, step = lo, step * 2
    return 0


def runs_of(sym: np.ndarray, cfg: RunConfig) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in an array of symbols."""
    out, ending = [], {}
    starts, periods = branching_tandems(sym, max(2, cfg.min_exponent))
    for i, p in zip(starts.tolist(), periods.tolist(), strict=True):
        end = i + 2 * p
        shorter = ending.setdefault(end, [])
        if any(p % q == 0 and s <= i for q, s in shorter):  # its root is a power of a shorter one
            continue
        s = rotated(sym, i, p)
        shorter.append((p, s))
        if end - s >= max(cfg.min_length, cfg.min_exponent * p):
            out.append((s, end, p))
    return out


def search(texts: list[bytes], cfg: RunConfig) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """For each text: number of words, its runs (start, length, period) by start and period, and the kept words."""
    words = [t.split() for t in texts]  # bytes split at blanks and \\x09-\\x0D alone
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=first[1:])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if first[-1]:
        flat = np.empty(int(first[-1]), object)
        flat[:] = [w for ws in words for w in ws]
        code = pd.factorize(flat)[0].astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        _, sym = np.unique(doc * (code.max() + 1) + code, return_inverse=True)
        for s, e, p in runs_of(sym, cfg):
            d = doc[s]
            found[d].append((int(s - first[d]), e - s, p))
    for ws, rs in zip(words, found, strict=True):
        rs.sort(key=lambda r: (r[0], r[2]))
        if rs:
            gone = np.zeros(len(ws) + 1, np.int64)
            for s, length, p in rs:
                gone[s + p] += 1
                gone[s + length] -= 1
            yield len(ws), rs, b" ".join(w for w, g in zip(ws, np.cumsum(gone).tolist(), strict=False) if not g)
        else:
            yield len(ws), rs, b" ".join(ws)


def periodic_runs(docs: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the words that no run contains after its first period,
    joined by one blank) of every document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some, raws in small_batches(ids, texts, 1 << 19):
                n, rs, left = zip(*search(raws, cfg), strict=True)
                cols = [pa.array(some, pa.int64()), pa.array(n, pa.int64())]
                cols += [pa.array([[{"start": s, "length": m, "period": p} for s, m, p in r] for r in rs], _RUNS)]
                cols += [pa.array([x.decode("utf-8", "surrogatepass") for x in left], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])
        give_back()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def collapse(docs: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """docs with the later periods of every run cut out of text, and n_chars (where there is one) counted anew; texts
    without a run stay as they are, blanks included."""

    @F.pandas_udf("string")
    def cut(text: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for i, raws in small_batches(list(range(len(text))), list(text), 1 << 19):
            out += [left.decode("utf-8", "surrogatepass") if rs else None for _, rs, left in search(raws, cfg)]
        return pd.Series(out, dtype=object)

    new = free_name(docs.columns, "_new")
    rows = docs.select(whole_row(docs).alias("row"), *row_key()[1:]).withColumn(new, cut(F.coalesce("row.text", F.lit(""))))
    return with_text(rows, docs, "row", F.col(new).isNotNull(), F.col(new))


def looped(doc_id: Column, text: Column) -> Column:
    """The text, and for ids whose crc32 is divisible by ten its words with a period from word a on (the contract's edit)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    times = F.ceil((n - a) / p)
    loop = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times.cast("int")))
    text_of = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(loop, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), text_of).otherwise(text)


def op13(docs: DataFrame) -> DataFrame:
    """Per document its number of runs, the longest, and digests of all runs and of the collapsed text. Ids: null takes no edit."""
    edited = docs.select("doc_id", looped(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text"))
    found = periodic_runs(edited)
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), (-best["k"]).alias("length"), best["period"].alias("period"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).withColumn("exponent_milli", F.expr("(1000L * length) div period")).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
