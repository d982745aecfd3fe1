"""The training-data operators against brute force on small fixtures, with the defined odd cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from memloom.llm import ann, jaccard_join, lang_id, packing, piece_codec, quality_classifier, quality_rules, secret_scan, suffix_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, out = text(120), []
    for i in range(n):
        kind = i % 6
        t = text(rng.choice([1, 3, 5, 60, 300]))
        if kind == 1 and out:
            t = rng.choice(out)[1] or ""
        if kind == 2 and out:
            w = (rng.choice(out)[1] or "").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if kind == 3:
            t = t + "\n" + shared + "\n" + text(30)
        if kind == 4:
            t = "é" * rng.randint(0, 700) + " password=abc123def456 " + text(5)
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "x" * 5000), (n + 4, "x" * 4000 + " " + text(20)), (n + 5, text(40)), (n + 5, text(40))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i % 9 == 0 else ("aa" if i % 2 else "bb"), None if i % 7 == 0 else f"s{i % 4}", len(t or ""), "e") for i, t in corpus()], DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(60)] + [(3, None, None)], "doc_id long, quality int, toxic int")


def test_suffix_dedup_brute(docs):
    data = [(i, (t or "").encode()) for i, t in corpus()]
    seen = collections.Counter(t[s : s + 400] for _, t in data for s in range(len(t) - 399))
    want = []
    for i, t in data:
        cut = bytearray(len(t))
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                cut[s : s + 400] = b"\1" * 400
        left = bytes(b for b, c in zip(t, cut, strict=True) if not c)
        want.append((i, len(t), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(left).hexdigest()))
    for cfg in (suffix_dedup.RepeatConfig(), suffix_dedup.RepeatConfig(most_contexts=1, bucket=3)):
        assert sorted(tuple(r) for r in suffix_dedup.op4(docs, cfg).collect()) == sorted(want)


def test_jaccard_brute(docs):
    sets = []
    for i, t in corpus():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[max(top(x), top(y))] = min(top(x), top(y))
    want = sorted((i, len(s), sets[top(k)][0]) for k, (i, s) in enumerate(sets))
    for cfg in (jaccard_join.JaccardConfig(), jaccard_join.JaccardConfig(leaf=2, star_rounds=0)):
        assert sorted(tuple(r) for r in jaccard_join.op9(docs, cfg).collect()) == want


def test_keep_one_rows(spark):
    """One row of each component, by row and not by doc_id: shared ids, null ids, texts without words."""
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    a, b, c, d, e = (text() for _ in range(5))
    data = [(5, a), (5, b), (6, a), (1, c), (2, c + " tail"), (2, d), (None, d), (None, e), (None, e), (None, None), (None, ""), (3, None), (3, None)]
    out = jaccard_join.keep_one(spark.createDataFrame(data, "doc_id long, text string").repartition(5))
    want = [(5, a), (5, b), (1, c), (2, d), (None, e), (None, None), (None, ""), (3, None), (3, None)]
    assert collections.Counter(tuple(r) for r in out.collect()) == collections.Counter(want)


def test_jaccard_null_ids(spark):
    """A null-id text bridges two documents that do not link directly; near copies among null ids link."""
    w = [f"w{k}" for k in range(130)]
    far = [f"v{k}" for k in range(100)]
    data = [(1, w[:110]), (None, w[8:118]), (2, w[16:126]), (None, far), (None, [*far, "end"]), (3, [f"u{k}" for k in range(60)])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in data], "doc_id long, text string").repartition(3)
    for cfg in (jaccard_join.JaccardConfig(), jaccard_join.JaccardConfig(leaf=2, star_rounds=0)):
        got = collections.Counter((r.doc_id, r.component_id) for r in jaccard_join.op9(docs, cfg).collect())
        assert got == collections.Counter([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (3, 3)])
        kept = collections.Counter(r.doc_id for r in jaccard_join.keep_one(docs, cfg).collect())
        assert kept == collections.Counter([1, None, 3])


def test_secrets_brute(docs):
    rx = [re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    want = []
    for i, t in corpus():
        spans = sorted((m.start(), k, m.end()) for k, r in enumerate(rx) for m in r.finditer(t or "") if len(m[2] if k == 0 else m[0]) >= (12, 18, 16)[k])
        want.append((i, *(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()))
    got = secret_scan.op6(docs)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()) == sorted(want)
    assert secret_scan.redact(docs).where("text like '%abc123def456%'").count() == 0
    assert secret_scan.redact(docs).columns == docs.columns


def test_rules_brute(docs, labels):
    got = sorted(tuple(r)[:7] for r in quality_rules.op2(docs, labels).collect())
    want = []
    for i, t in corpus():
        w = WORD.findall(t or "")
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = collections.Counter(g)
        rep = len({p for k, x in enumerate(g) if c[x] > 1 for p in (k, k + 1, k + 2)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert got == sorted(want)


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in corpus()]
    rows = packing.op3(docs).collect()
    total, crcs = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        total[r.doc_id] += r.length
        crcs[r.doc_id].add((r.start, r.length, r.ids_crc32))
    for i, x in ids:
        assert total[i] == sum(len(y) for j, y in ids if j == i)
        assert all(any(zlib.crc32(y[a : a + n].tobytes()) == c for j, y in ids if j == i) for a, n, c in crcs[i])
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[7]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0])]
    got = ann.op5(spark.createDataFrame(data, "vec_id long, embedding array<double>"), ann.AnnConfig(list_size=30, part=20)).collect()
    by = collections.defaultdict(dict)
    for r in got:
        by[r.query_id][r.rank] = (r.vec_id, r.score)
    hit = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:20]
        hit += len({v for v, _ in by[q].values()} & set(best))
        assert sorted(by[q]) == list(range(1, 21))
        assert all(abs(sc - s[v]) < 1e-9 for v, sc in by[q].values())
    assert hit / (30 * 20) >= 0.9
    assert [by[100][k][0] for k in (1, 2, 3)] == [7, 101, 102]


def test_ann_dense_clusters(spark):
    """Many lists, and groups of near copies smaller than k: each query still gets k rows, and the right ones."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(250, 16)), 8, axis=0) + 1e-4 * rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = collections.defaultdict(set)
    for r in ann.op5(spark.createDataFrame(data, "vec_id long, embedding array<double>"), ann.AnnConfig(list_size=8, floor=300)).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 2000, 20):
        s = x @ x[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
        assert len(got[q]) == 20
    assert hit / (100 * 20) >= 0.95


def test_pieces_equal_library(docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = piece_codec.op7(docs).collect()
    assert all(r.round_trip for r in rows)
    want = collections.Counter((i, zlib.crc32(np.array(sp.encode(t or ""), "<u4").tobytes())) for i, t in corpus())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in rows) == want


def test_token_attribution(docs):
    for rule in ("start", "end", "larger"):
        rows = token_counts.op10(docs, token_counts.AttributionConfig(rule=rule)).collect()
        total = collections.Counter()
        for r in rows:
            total[r.doc_id, r.doc_tokens] += r.n_tokens
        assert all(n % k[1] == 0 for k, n in total.items() if k[1])
    place, cross = token_counts.attribute(np.array([2, 5, 6]), np.array([0, 3]), "start")
    assert place.tolist() == [0, 0, 1] and cross.tolist() == [False, True, False]


def test_models(docs, labels):
    got = {(r.doc_id, r.lang_pred, r.score) for r in lang_id.op1(docs).collect()}
    assert (60, "und", 0.0) in got and (62, "und", 0.0) in got and all(0 <= s <= 1 for _, _, s in got)
    q = quality_classifier.op8(docs, labels).collect()
    assert len(q) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in q)


def test_empty_tables(spark, empty, labels):
    assert lang_id.op1(empty).count() == 0 and quality_rules.op2(empty, labels).count() == 0 and packing.op3(empty).count() == 0
    assert suffix_dedup.op4(empty).count() == 0 and secret_scan.op6(empty).count() == 0 and piece_codec.op7(empty).count() == 0
    assert quality_classifier.op8(empty, labels).count() == 0 and jaccard_join.op9(empty).count() == 0 and token_counts.op10(empty).count() == 0
    assert ann.op5(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages(docs, labels, tmp_path):
    import corpus_pipeline

    docs.drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(docs.sparkSession, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
