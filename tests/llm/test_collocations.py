"""Collocations against plain counting, and the filters' round trip."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from memloom.llm import collocations
from memloom.llm.collocations import CollocationConfig, CountingFilter, Pieces, Tally, counted, permute, split

ROWS = "doc_id long, text string, lang string, ids string"


def plain(docs, least, longest, inside, top):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {g: n for g, n in f.items() if n >= least}
    out = []
    for (lang, g), a in often.items():
        if len(g) < 2:
            continue
        if any(n * 100 >= inside * a and lang == x and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) for (x, h), n in often.items()):
            continue
        n = total[lang]
        score, cut = min((1000 * a * n // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, f[lang, g[:cut]], f[lang, g[cut:]], n, score, cut))
    rows = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        rows += [(lang, i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(rows)


@pytest.mark.parametrize("cfg", [CollocationConfig(least=5), CollocationConfig(least=3, longest=3, inside=60, top=7, sieve_bits=8, entries=50)])
def test_against_counting(spark, cfg):
    rng = random.Random(cfg.least)
    words = ["a", "B", "b", "é", "É", "it's", "x y", "p q r s t u", "long-word", "ß", "中", "A"]
    docs = []
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "\x1c"]) for _ in range(rng.randrange(0, 60)))
        docs.append((text, rng.choice(["en", "de", None, "und", ""])))
    docs += [(None, "en"), ("", "xx"), (" .,", None)] + [docs[0]] * 5
    rows = spark.createDataFrame([(None if i % 5 == 0 else i, t, g, "x") for i, (t, g) in enumerate(docs)], ROWS)
    got = sorted(map(tuple, collocations.collocations(rows, cfg).collect()))
    assert got == plain(docs, cfg.least, cfg.longest, cfg.inside, cfg.top) and got


def test_empty_and_rare(spark):
    for data in ([], [(1, "a b c", "en", "x")], [(1, None, None, None)]):
        assert collocations.collocations(spark.createDataFrame(data, ROWS)).collect() == []


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 10**12
    rows = spark.range(1).select(F.lit(big).alias("a"), F.lit(30 * big).alias("n"), F.lit(7 * big).alias("l"), F.lit(3 * big).alias("r"))
    wide = {c: f"CAST({c} AS DECIMAL(18, 0))" for c in "anlr"}
    got = rows.select(F.expr(f"(1000 * ({wide['a']} * {wide['n']})) div ({wide['l']} * {wide['r']})")).first()[0]
    assert got == 1000 * big * 30 * big // (21 * big * big)


@pytest.mark.parametrize("bits", [32, 40, 64])
@pytest.mark.parametrize("n", [2, 5])
def test_filter_round_trip(bits, n):
    rng = np.random.default_rng(bits + n)
    ids = rng.integers(0, 1 << 62, (3000, n)).astype(np.uint64) * np.uint64(5) >> np.uint64(64 - bits)
    ids = ids[rng.integers(0, 3000, 20_000)]
    want = Counter(map(tuple, ids.tolist()))
    packed = permute(ids, bits)
    assert (permute(packed, bits, back=True) == ids).all()
    halves = [counted(part, None, bits) for part in (packed[:9000], packed[9000:])]
    filters = [[CountingFilter.load(f.dump(), f.part, 3, bits) for f in split(*h, 3, bits)] for h in halves]
    got: Counter = Counter()
    for part in range(8):
        tally = Tally(bits, 100)
        for fs in filters:
            for f in fs:
                if f.part == part:
                    tally.add(f.rows, f.counts * 300)
        rows, counts = tally.merge()
        assert ((rows[:, 0] >> np.uint64(bits - 3)) == part).all() and (np.diff(collocations.top64(rows, bits).astype(object)) > 0).all()
        got.update(dict(zip(map(tuple, permute(rows, bits, back=True).tolist()), (counts // 300).tolist(), strict=True)))
    assert got == want


def test_ids_differ_by_language_and_seed():
    a = Pieces([b"Word x", b"word"], ["en", "de"], 0, 64)
    assert a.ids[0] != a.ids[2] and len(set(a.piece[[0, 2]].tolist())) == 2
    assert Pieces([b"word"], ["de"], 0, 64).ids[0] == a.ids[2] != Pieces([b"word"], ["de"], 1, 64).ids[0]


def test_shared_ids_are_noticed(spark):
    data = [("en", "a", 60, 1), ("en", "b", 50, 1), ("en", "c", 500, 2)]
    ids = spark.createDataFrame(data, "lang string, word string, n long, id long")
    assert not collocations.apart(ids, 100) and collocations.apart(ids, 111)
