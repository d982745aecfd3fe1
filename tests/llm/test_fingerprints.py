"""Fingerprints against a plain version, and what they must tell apart."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from memloom.llm import fingerprints
from memloom.llm.fingerprints import DigestConfig, digests, entropy_bins, likeness, read, written

CFG = DigestConfig()


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 10))) for _ in range(900)]


def plain_features(raw, rank, cfg):
    """Positions (start, end) of features, by the definition."""
    w, k = cfg.window, cfg.around
    if len(raw) < w:
        return [(0, len(raw))] if raw else []
    n = len(raw) - w + 1
    r = [int(rank[b]) for b in plain_bins(raw, w)]
    named = Counter()
    for s in range(n):
        at = min(range(s, min(n, s + k)), key=lambda i: (r[i], i))
        if r[at] < fingerprints._NEVER:
            named[at] += 1
    got = sorted(i for i, c in named.items() if c >= cfg.named) or [min(range(n), key=lambda i: (r[i], i))]
    return [(i, i + w) for i in got]


def plain_bins(raw, w):
    out = []
    for i in range(len(raw) - w + 1):
        h = -sum(c / w * math.log2(c / w) for c in Counter(raw[i : i + w]).values())
        out.append(min(1000, int(h * 1000 / math.log2(w) + 1e-4)))
    return out


def test_entropies(words):
    rng = random.Random(1)
    raw = (prose(rng, 60, words) + " " * 50 + "ab" * 40).encode()
    assert entropy_bins(np.frombuffer(raw, np.uint8), 24).tolist() == plain_bins(raw, 24)


@pytest.mark.parametrize("block", [64, 97, 1 << 20])
def test_features_by_definition(words, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = random.Random(2)
    rank = np.random.default_rng(5).permutation(1001)
    rank[: CFG.weak] = fingerprints._NEVER
    texts = [prose(rng, rng.randrange(0, 60), words).encode() for _ in range(30)] + [b"", b"x", b"a" * 90, b"-" * 24, b"abc " * 30]
    text, h = fingerprints.features(texts, rank, CFG)
    for i, raw in enumerate(texts):
        spans = plain_features(raw, rank, CFG)
        seen = list(dict.fromkeys(raw[a:b] for a, b in spans))
        alone = [int(fingerprints.hashes_at(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in seen]
        assert h[text == i].tolist() == alone
    for raw, f in zip(texts, digests(texts, rank, CFG), strict=True):
        assert len(f) == -(-(text == texts.index(raw)).sum() // CFG.per_filter)


def test_likeness(words):
    rng = random.Random(7)
    rank = np.arange(1001)
    a, b = (prose(rng, 3000, words) for _ in range(2))
    near = a.replace(words[5], "other")
    fa, fb, fn, fh, short = digests([x.encode() for x in (a, b, near, a[: len(a) // 2] + b[: len(b) // 2], a[:900])], rank, CFG)
    assert likeness(fa, fa) == 1.0 and likeness(fa, fb) < 0.05 and likeness(fa, fn) > 0.7 and 0.35 < likeness(fa, fh) < 0.65
    assert likeness(fa, fn) == likeness(fn, fa) and likeness(short, fa) < 0.3
    none = read("")
    assert likeness(none, none) == 1.0 and likeness(none, fa) == likeness(fa, none) == 0.0
    assert (read(written(fa)) == fa).all()


def test_query(spark, words):
    rng = random.Random(11)
    data = [(i * 3, prose(rng, rng.randrange(0, 120), words)) for i in range(150)]
    data += [(450, data[3][1]), (451, data[3][1]), (-5, ""), (None, "no id at all " * 9), (None, None), (7, "same id " * 20), (7, "another text " * 20), (7, "another text " * 20), (1 << 60, "é" * 7)]
    docs = spark.createDataFrame([(i, t, "t", 0, 1) for i, t in data], "doc_id long, text string, lang string, part int, tail int")
    rank = fingerprints.fit_rarity(docs)
    count = Counter(b for _, t in data for b in plain_bins((t or "").encode(), CFG.window))
    assert [b for b in np.argsort(rank).tolist() if b >= CFG.weak] == sorted(range(CFG.weak, 1001), key=lambda b: (count[b], b))
    got = fingerprints.op11(docs).collect()
    hashes = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    rows = sorted([(i is not None, i or 0, hashes[t or ""], t or "") for i, t in data], reverse=True)
    want = []
    for k, (given, i, _, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][3]
        mixed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        ft, fm, fa = digests([x.encode() for x in (t, mixed, after)], rank, CFG)
        want.append((i if given else None, len(t), hashlib.sha256(mixed.encode()).hexdigest(), written(ft), written(fm), likeness(ft, fm), likeness(ft, fa)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    by_id = {r.doc_id: r for r in got}
    assert by_id[450].fingerprint == by_id[451].fingerprint == by_id[9].fingerprint and by_id[451].near_next == 1.0
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert all(plain[i] == by_id[i].fingerprint for i in range(0, 450, 3))


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprints.op11(spark.createDataFrame([], schema)).collect() == []
    one = fingerprints.op11(spark.createDataFrame([(5, "only one text, and it follows itself")], schema)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]


def test_likeness_column(spark, words):
    text = prose(random.Random(1), 200, words)
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    f = fingerprints.fingerprints(docs)
    pair = f.alias("a").join(f.alias("b")).selectExpr("a.doc_id AS i", "b.doc_id AS j", "a.fingerprint AS x", "b.fingerprint AS y")
    got = {(r.i, r.j): r.s for r in pair.select("i", "j", fingerprints.likeness_of("x", "y").alias("s")).collect()}
    assert got[1, 2] == 1.0 and got[1, 3] == 0.0 and got[3, 3] == 1.0
