"""Phrase collocations by counting quotient filters (operator 12).

1. Words are counted once, exactly, by language and text. A word's id is a hash of language and word, cut to the fewest bits
   at which the words of this corpus stay apart: ids that several words share are looked for in the counts, and where
   one of them could matter (its words together reach `least`) all words are hashed anew with another seed. So equal ids
   mean equal words of one language, without a dictionary on the workers.
2. Phrases are counted by length, 2 words to `longest`. A phrase of n words is packed as n ids and permuted by an invertible
   map of its n * bits bits. The upper bits of the result are its quotient, the rest its remainder, both kept in full: a counting
   quotient filter (`CountingFilter`) holds, in sorted order, a bit for each quotient that occurs, a bit for each end
   of a quotient's run, the remainders, and one byte of count (eight more from 255 on). Each task fills filters from its texts
   and hands them out cut by ranges of the quotient; the filters of a range are merged in order, and what reaches `least` is unpacked.
3. A phrase is only counted where both phrases of one word less inside it reach `least`, as it can't reach it otherwise. Tasks
   ask a bitmap of fixed size for that; a wrong yes costs an entry, never a wrong count.
4. Cuts, scores and the test against longer phrases are joins of the counted phrases. If a phrase lies in a longer one that is
   frequent enough, it also lies in such a one of one word more, so those are all that is asked.

Defined cases: null text: no words; null language: `und` (together with a language that has that name); repeated rows count
each; a null doc_id counts, as ids are not read; very long texts are taken whole; empty table: empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import discard, give_back, mix64, powers, small_batches, span_hash, stage


@dataclass(frozen=True)
class CollocationConfig:
    least: int = 100  # occurrences of a phrase
    longest: int = 5  # words of a phrase
    inside: int = 100  # percent of a phrase's occurrences that lie in a longer phrase which replaces it
    top: int = 2000  # phrases of a language
    sieve_bits: int = 26  # of the address in the bitmap of frequent shorter phrases: 8 MB
    entries: int = 1 << 20  # of a task's filters before they are handed out


U = np.uint64
BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 blank, 2 end of a piece
_KIND[[32, 9]] = 1
_KIND[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TO_BLANK = bytes(32 if k else i for i, k in enumerate(_KIND))
_C = mix64(np.arange(11, 43, dtype=U)) | U(1)


# ---- ids -----------------------------------------------------------------------------------------
def byte_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of buf[start:end] for many spans; every seed gives another function."""
    keys = mix64(np.arange(1, 257, dtype=U) + U(seed * 1000))
    pre = np.zeros(len(buf) + 1, U)
    np.cumsum(keys[buf] * powers(len(buf)), out=pre[1:])
    return span_hash(pre, start, end)


def language_hash(langs: list[str], seed: int) -> np.ndarray:
    raws = [x.encode("utf-8", "surrogatepass") for x in langs]
    ends = np.cumsum([len(r) for r in raws], dtype=np.int64)
    return mix64(byte_hash(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, seed) + U(17))


class Pieces:
    """Words of a batch of texts: id, and the number of the piece each stands in."""

    def __init__(self, texts: list[bytes], langs: list[str], seed: int, bits: int):
        buf = _LOWER[np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)]
        kind = _KIND[buf]
        word = kind == 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # the first and last bytes are breaks
        start, end = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == 2)[start]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(bounds, start - 1, side="right")
        names, which = np.unique(np.array(langs, object), return_inverse=True)
        lang = language_hash(list(names), seed)[which]
        self.ids = mix64(byte_hash(buf, start, end, seed) ^ lang[text]) >> U(64 - bits)


# ---- packed phrases and filters --------------------------------------------------------------------
def permute(x: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    """The invertible map on rows of n ids of `bits` bits: two Feistel rounds mix all other ids into the first and the second."""
    x, mask = x.copy(), U((1 << bits) - 1 if bits < 64 else 0xFFFFFFFFFFFFFFFF)
    n = x.shape[1]
    for i in (1, 0) if back else (0, 1):
        f = np.full(len(x), i + 1, U)
        for j in range(n):
            if j != i:
                f += x[:, j] * _C[j + n * i]
        f = mix64(f)
        x[:, i] = (x[:, i] - f if back else x[:, i] + f) & mask
    return x


def top64(x: np.ndarray, bits: int) -> np.ndarray:
    """The upper 64 bits of permuted rows, filled up with zeros."""
    out = x[:, 0] << U(64 - bits)
    if bits < 64:
        out |= x[:, 1] << U(64 - 2 * bits) if 2 * bits <= 64 else x[:, 1] >> U(2 * bits - 64)
    return out


def counted(x: np.ndarray, counts: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct permuted rows in order, with the sums of their counts."""
    key = top64(x, bits)
    order = np.argsort(key)
    x, key = x[order], key[order]
    c = np.ones(len(x), np.int64) if counts is None else counts[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(axis=1)
    if (new[1:] & (key[1:] == key[:-1])).any():  # different phrases that agree in 64 bits: order by all bits
        order = np.lexsort(x.T[::-1])
        x, c = x[order], c[order]
        new[1:] = (x[1:] != x[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return x[first], np.add.reduceat(c, first)


@dataclass
class CountingFilter:
    """Permuted phrases of one range (equal upper `ahead` bits, their value is `part`) and their counts, in order."""

    part: int
    ahead: int
    bits: int
    rows: np.ndarray
    counts: np.ndarray

    def dump(self) -> bytes:
        """quotient-occurs bits, end-of-run bits, remainders, counts: nothing is lost."""
        m, n = self.rows.shape
        q = max(0, min(m.bit_length() - 1, self.bits - self.ahead))
        low = self.bits - self.ahead - q
        head = self.rows[:, 0] & U((1 << (self.bits - self.ahead)) - 1)
        quotient = (head >> U(low)).astype(np.int64)
        occurs, ends = np.zeros(1 << q, bool), np.ones(m, bool)
        occurs[quotient] = True
        ends[:-1] = quotient[1:] != quotient[:-1]
        out = [np.array([m, n, q], np.int64).tobytes(), np.packbits(occurs).tobytes(), np.packbits(ends).tobytes()]
        for j in range(n):
            col = np.ascontiguousarray(head & U((1 << low) - 1) if j == 0 else self.rows[:, j]).view(np.uint8).reshape(m, 8)
            out.append(col[:, : -(-(low if j == 0 else self.bits) // 8)].tobytes())
        large = self.counts >= 255
        out += [np.where(large, 255, self.counts).astype(np.uint8).tobytes(), self.counts[large].astype(np.int64).tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, raw: bytes, part: int, ahead: int, bits: int) -> CountingFilter:
        buf = np.frombuffer(raw, np.uint8)
        m, n, q = (int(v) for v in buf[:24].view(np.int64))
        at, low = 24, bits - ahead - q

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return buf[at - size : at]

        occurs = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)))[: 1 << q])
        ends = np.flatnonzero(np.unpackbits(take(-(-m // 8)))[:m])
        rows = np.empty((m, n), U)
        for j in range(n):
            width = -(-(low if j == 0 else bits) // 8)
            col = np.zeros((m, 8), np.uint8)
            col[:, :width] = take(m * width).reshape(m, width)
            rows[:, j] = col.view(U)[:, 0]
        rows[:, 0] |= np.repeat(occurs, np.diff(ends, prepend=-1)).astype(U) << U(low)
        if ahead:
            rows[:, 0] |= U(part << (bits - ahead))
        counts = take(m).astype(np.int64)
        counts[counts == 255] = np.frombuffer(take(len(buf) - at).tobytes(), np.int64)
        return cls(part, ahead, bits, rows, counts)


def split(rows: np.ndarray, counts: np.ndarray, ahead: int, bits: int) -> Iterator[CountingFilter]:
    """Sorted rows as filters, one for each range of the upper bits."""
    part = (rows[:, 0] >> U(bits - ahead)).astype(np.int64) if ahead else np.zeros(len(rows), np.int64)
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(rows)).tolist(), strict=False):
        yield CountingFilter(int(part[a]), ahead, bits, rows[a:b], counts[a:b])


class Tally:
    """Rows and counts that are merged whenever `most` of them have come together."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most, self.parts, self.size = bits, most, [], 0

    def add(self, rows: np.ndarray, counts: np.ndarray | None = None) -> None:
        if len(rows):
            self.parts.append((rows, np.ones(len(rows), np.int64) if counts is None else counts))
            self.size += len(rows)
            if self.size > 2 * self.most:
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            got = counted(np.concatenate([r for r, _ in self.parts]), np.concatenate([c for _, c in self.parts]), self.bits)
            self.parts, self.size = [got], len(got[0])
        return self.parts[0] if self.parts else (np.zeros((0, 2), U), np.zeros(0, np.int64))


# ---- passes over the texts -------------------------------------------------------------------------
def texts_of(pdf: pd.DataFrame) -> Iterator[tuple[list[str], list[bytes]]]:
    return small_batches(list(pdf["lang"]), list(pdf["text"]), 1 << 20)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of all words."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = pd.DataFrame([(g, w.decode("utf-8", "surrogatepass"), n) for (g, w), n in seen.items()], columns=["lang", "word", "n"])
            seen.clear()
            return rows

        for pdf in it:
            for langs, raws in texts_of(pdf):
                for lang in dict.fromkeys(langs):
                    words = Counter(w for g, raw in zip(langs, raws, strict=True) if g == lang for w in raw.lower().translate(_TO_BLANK).split(b" ") if w)
                    for w, n in words.items():
                        seen[lang, w] += n
                if len(seen) > 200_000:
                    yield out()
        yield out()
        give_back()

    return docs.mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_ids(words: DataFrame, seed: int, bits: int) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            raws = [w.encode("utf-8", "surrogatepass") for w in pdf["word"]]
            ids = Pieces(raws, list(pdf["lang"]), seed, bits).ids if raws else np.zeros(0, U)
            yield pdf.assign(id=ids.view(np.int64))

    return words.mapInPandas(run, "lang string, word string, n long, id long")


def apart(ids: DataFrame, least: int) -> bool:
    """Whether no id of several words could reach `least`."""
    word = F.struct("lang", "word")
    shared = ids.groupBy("id").agg(F.sum("n").alias("n"), F.min(word).alias("a"), F.max(word).alias("b")).where((F.col("n") >= least) & (F.col("a") != F.col("b")))
    return shared.isEmpty()


def sieve(slots: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the slots, at most 2^bits / 64 rows on the driver."""
    got = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["at"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return out


def asked(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the slots are set."""
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def slot_of(rows: np.ndarray, bits: int, sieve_bits: int) -> np.ndarray:
    """The place in the bitmap: of a single id by a hash, of a permuted phrase by its upper bits."""
    key = mix64(rows[:, 0]) if rows.shape[1] == 1 else top64(rows, bits)
    return (key >> U(64 - sieve_bits)).astype(np.int64)


def phrase_counts(docs: DataFrame, n: int, bitmap: np.ndarray, seed: int, bits: int, cfg: CollocationConfig) -> DataFrame:
    """ids, f, slot of the phrases of n words that occur `least` times or more."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ahead = min(16, max(2, (4 * parts).bit_length()))
    shared = spark.sparkContext.broadcast(bitmap)

    def grams(p: Pieces) -> np.ndarray:
        at = np.flatnonzero(p.piece[: len(p.piece) - n + 1] == p.piece[n - 1 :]) if len(p.piece) >= n else np.zeros(0, np.int64)
        if n == 2:
            ok = asked(shared.value, slot_of(p.ids[:, None], bits, cfg.sieve_bits))
        else:
            ok = np.zeros(len(p.ids), bool)  # phrases of n - 1 words, by their start
            both = np.unique(np.concatenate([at, at + 1]))
            rows = permute(np.stack([p.ids[both + j] for j in range(n - 1)], axis=1), bits)
            ok[both] = asked(shared.value, slot_of(rows, bits, cfg.sieve_bits))
        at = at[ok[at] & ok[at + 1]]
        return permute(np.stack([p.ids[at + j] for j in range(n)], axis=1), bits)

    def fill(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally(bits, cfg.entries)

        def out() -> Iterator[pd.DataFrame]:
            found = list(split(*tally.merge(), ahead, bits))
            tally.parts, tally.size = [], 0
            if found:
                yield pd.DataFrame({"part": [f.part for f in found], "filter": [f.dump() for f in found]})

        for pdf in it:
            for langs, raws in texts_of(pdf):
                tally.add(grams(Pieces(raws, langs, seed, bits)))
                if tally.size > cfg.entries:
                    tally.merge()
                    if tally.size > cfg.entries:
                        yield from out()
        yield from out()
        give_back()

    def merge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, now = Tally(bits, cfg.entries), -1

        def out() -> Iterator[pd.DataFrame]:
            rows, counts = tally.merge()
            tally.parts, tally.size = [], 0
            keep = counts >= cfg.least
            rows = rows[keep]
            if len(rows):
                yield pd.DataFrame({"ids": list(permute(rows, bits, back=True).view(np.int64)), "f": counts[keep], "slot": slot_of(rows, bits, cfg.sieve_bits)})

        for pdf in it:
            for part, raw in zip(pdf["part"].tolist(), pdf["filter"], strict=True):
                if part != now:
                    yield from out()
                    now = part
                got = CountingFilter.load(raw, part, ahead, bits)
                tally.add(got.rows, got.counts)
        yield from out()
        give_back()

    filters = docs.mapInPandas(fill, "part long, filter binary").repartition(parts, "part").sortWithinPartitions("part")
    got = stage(filters.mapInPandas(merge, "ids array<long>, f long, slot long"), f"phrases{n}")
    shared.unpersist()
    return got


def first_of(rows: DataFrame, by: str, order: list, most: int, rank: str) -> DataFrame:
    """The first `most` rows of each group with their rank; groups are cut into slices first, so that a large one is not one task's."""
    slices = rows.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = slices.withColumn(rank, F.row_number().over(Window.partitionBy(by, "_slice").orderBy(*order))).where(F.col(rank) <= most).drop("_slice", rank)
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= most)


def collocations(docs: DataFrame, cfg: CollocationConfig = CollocationConfig()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut of the best phrases of each language. docs: text, lang."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = stage(word_counts(docs), "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    distinct, frequent = words.agg(F.count("*"), F.count(F.when(F.col("n") >= cfg.least, 1))).first()
    bits = min(64, max(32, -(-(math.ceil(math.log2(distinct * frequent + 2)) + 12) // 8) * 8))
    seed = 0
    while not apart(ids := with_ids(words, seed, bits), cfg.least):
        seed, bits = seed + 1, min(64, bits + 8)
    known = stage(ids.where(F.col("n") >= cfg.least), "ids")

    def slots(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"slot": slot_of(pdf["id"].to_numpy(np.int64).view(U)[:, None], bits, cfg.sieve_bits)})

    levels = [known.select(F.array("id").alias("ids"), F.col("n").alias("f"))]
    staged, last = [words, known], known.select("id").mapInPandas(slots, "slot long")
    for n in range(2, cfg.longest + 1):
        got = phrase_counts(docs, n, sieve(last, cfg.sieve_bits), seed, bits, cfg)
        staged.append(got)
        if got.isEmpty():
            break
        levels.append(got.select("ids", "f"))
        last = got.select("slot")
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)

    size = F.size("ids")
    longer = counts.where(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f")
    longer = longer.groupBy("ids").agg(F.max("f").alias("most"))
    found = counts.where(size > 1).withColumnRenamed("f", "a").join(longer, "ids", "left").where(F.col("most").isNull() | (100 * F.col("most") < cfg.inside * F.col("a"))).drop("most")

    lang = known.select(F.col("id").alias("_first"), "lang").join(total, "lang")
    cuts = found.withColumn("_first", F.element_at("ids", 1)).join(lang, "_first").drop("_first")
    cuts = cuts.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumn("_l", F.slice("ids", F.lit(1), F.col("cut"))).withColumn("_r", F.slice("ids", F.col("cut") + 1, size - F.col("cut")))
    cuts = cuts.join(counts.select(F.col("ids").alias("_l"), F.col("f").alias("l")), "_l").join(counts.select(F.col("ids").alias("_r"), F.col("f").alias("r")), "_r")
    wide = {c: f"CAST({c} AS DECIMAL(18, 0))" for c in "anlr"}
    score = F.expr(f"(1000 * ({wide['a']} * {wide['n']})) div ({wide['l']} * {wide['r']})")  # products of up to 38 digits
    least = cuts.withColumn("score", score).groupBy("ids", "a", "n", "lang").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    scored = stage(least.select("ids", "lang", "a", "n", "s.*"), "scored")

    each = scored.select("ids", F.posexplode("ids").alias("pos", "id")).join(known.select("id", "word"), "id")
    text = each.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = scored.join(text, "ids")
    best = first_of(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], cfg.top, "rank")
    out = stage(best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut")), "collocations")
    discard(*staged, scored)
    return out


def op12(docs: DataFrame) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations(docs)


#: The same in SQL.
SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
 total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
 sized AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM words),
 grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM sized WHERE len(w) >= k),
 f AS (SELECT lang, g, k, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, g, k HAVING count(*) >= 100),
 part AS (SELECT lang, f, string_split(g, ' ') AS w FROM f WHERE k > 2),
 longer AS (SELECT lang, g, max(f) AS most FROM (SELECT lang, f, array_to_string(w[1 : len(w) - 1], ' ') AS g FROM part UNION ALL SELECT lang, f, array_to_string(w[2 : len(w)], ' ') FROM part) y GROUP BY lang, g),
 found AS (SELECT f.lang, f.g, f.k, f.f AS a, string_split(f.g, ' ') AS w FROM f LEFT JOIN longer ON longer.lang = f.lang AND longer.g = f.g WHERE f.k > 1 AND (most IS NULL OR 100 * most < 100 * f.f)),
 cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM found),
 scored AS (SELECT c.lang, c.g, c.a, c.cut, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score FROM cuts c JOIN total t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.w[1 : c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.w[c.cut + 1 : c.k], ' ')),
 best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS nth FROM scored),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best WHERE nth = 1)
 SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, CAST(cut AS BIGINT) AS cut FROM ranked WHERE rank <= 2000"""
