"""Periodic runs against a quadratic search."""

import hashlib
import random
import re
import zlib

import pytest

from memloom.llm import periodic_runs
from memloom.llm.periodic_runs import RunConfig

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=6, exponent=4):
    out = []
    for p in range(1, len(w) // exponent + 1):
        s = 0
        while s + p < len(w):
            e = s + p
            while e < len(w) and w[e] == w[e - p]:
                e += 1
            if e - s >= max(least, exponent * p) and not any(p % q == 0 and a <= s and a + m >= e for a, m, q in out):
                out.append((s, e - s, p))
            s = max(s + 1, e - p + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    rs = plain_runs(w)
    best = min(rs, key=lambda r: (-r[1], r[0], r[2])) if rs else (None, None, None)
    gone = {i for s, m, p in rs for i in range(s + p, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in rs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(rs), best[0], best[1], best[2], best[1] * 1000 // best[2] if rs else None, sha(lines), sha(kept))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
@pytest.mark.parametrize("cfg", [RunConfig(), RunConfig(2, 2), RunConfig(7, 3)])
def test_random_words(letters, cfg):
    rng = random.Random(letters)
    texts = []
    for _ in range(150):
        w = [rng.choice("abcdefgh"[:letters]) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.6:
            root = [rng.choice("abcdefgh"[:letters]) for _ in range(rng.randrange(1, 6))]
            w += (root * 9)[: rng.randrange(1, 9 * len(root))] + w[:3]
        texts.append(" ".join(w))
    for t, (n, rs, left) in zip(texts, periodic_runs.search([t.encode() for t in texts], cfg), strict=True):
        want = plain_runs(t.split(), cfg.min_length, cfg.min_exponent)
        assert n == len(t.split()) and rs == want
        gone = {i for s, m, p in want for i in range(s + p, s + m)}
        assert left.decode().split() == [w for i, w in enumerate(t.split()) if i not in gone]


def test_equal_words_take_linear_time():
    (n, rs, left), = periodic_runs.search([b"a " * 60_000], RunConfig())
    assert (n, rs, left) == (60_000, [(0, 60_000, 1)], b"a")


def test_query(spark):
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 90)))) for i in range(400)]
    data += [(10_000, None), (10_001, ""), (10_002, " \n\t"), (None, "x " * 8), (7, "é　é é  é é" + "\n é" * 9), (7, "twice"), (7, "twice"), (-3, "b a " * 30), (1 << 60, "q " * 7)]
    rows = spark.createDataFrame([(i, t, "n") for i, t in data], "doc_id long, text string, runs string")
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    got = sorted((tuple(r) for r in periodic_runs.op13(rows).collect()), key=key)
    assert got == sorted((plain(*d) for d in data), key=key)
    assert periodic_runs.op13(rows.where("doc_id = 123456")).collect() == []


def test_collapse_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "a  b " * 6, 30, "x"), (2, "  as it\nis ", 11, "y"), (3, None, None, "z")], "doc_id long, text string, n_chars int, _new string")
    out = periodic_runs.collapse(rows)
    assert out.columns == rows.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a b", 3, "x"), (2, "  as it\nis ", 11, "y"), (3, None, None, "z")]
