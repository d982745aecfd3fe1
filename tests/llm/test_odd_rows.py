"""Null ids, clashing names, empty tables and long texts without blanks, for every query and stage; the queries that SQL can express."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from memloom.llm import ann, collocations, fingerprints, jaccard_join, lang_id, packing, periodic_runs, piece_codec, quality_classifier, quality_rules, queries, secret_scan, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def calls(labels):
    """Each query as a function of documents."""
    return {
        "op1": lang_id.op1, "op2": lambda d: quality_rules.op2(d, labels), "op3": packing.op3, "op4": suffix_dedup.op4, "op6": secret_scan.op6, "op7": piece_codec.op7,
        "op8": lambda d: quality_classifier.op8(d, labels), "op9": jaccard_join.op9, "op10": token_counts.op10, "op11": fingerprints.op11, "op13": periodic_runs.op13,
    }


NAMES = sorted(calls(None))
WORDS = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS).cache()


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids and texts, repeated ids and rows."""
    rows = [(i, f"{WORDS} {i} é", "aa" if i % 2 else "bb", "s") for i in range(40)] + [(None, WORDS, "aa", None), (None, None, None, None), (None, WORDS, "aa", None), (3, "", None, "s"), (3, WORDS, "bb", "s"), (3, WORDS, "bb", "s"), (-1, " \n", "aa", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


@pytest.mark.parametrize("name", NAMES)
def test_null_ids_and_repeated_rows(docs, labels, name):
    got = calls(labels)[name](docs).select("doc_id").collect()
    ids = [r.doc_id for r in got]
    if name not in ("op3", "op10"):  # rows are pieces, or sections
        assert len(ids) == docs.count() and ids.count(None) == 3 and ids.count(3) == 4
    assert None in ids and -1 in ids


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(docs, labels, name):
    """Other columns, whatever their names, change nothing."""
    plain = calls(labels)[name](docs)
    clash = ("h", "th", "id0", "key", "part", "tail", "node", "n", "score", "words", "runs", "x", "row", "_h", "spans", "found", "n_words", "length", "ids", "keys")
    more = docs.selectExpr("*", *[f"doc_id AS `{c}`" for c in clash])
    as_rows = lambda d: sorted(map(repr, d.collect()))
    assert as_rows(calls(labels)[name](more)) == as_rows(plain)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, name):
    assert calls(labels)[name](docs.where("doc_id = 99")).collect() == []


def test_empty_stages(spark, docs, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    none = docs.where("doc_id = 99")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, none, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).collect() == []


def test_long_texts_without_blanks(spark, labels):
    """One word of a quarter of a million letters, and a text of one period."""
    one, two = "abcdefghij" * 25_000, "x" * 60_000
    docs = spark.createDataFrame([(1, one, "aa", "s"), (2, two, "aa", "s"), (3, "é" * 40_000, "bb", "s")], "doc_id long, text string, lang string, source string")
    got = {n: {r.doc_id: r for r in f(docs).collect()} for n, f in calls(labels).items() if n not in ("op3", "op7", "op10")}
    assert [got["op4"][i].n_removed for i in (1, 2, 3)] == [250_000, 60_000, 80_000]
    assert [got["op9"][i].n_shingles for i in (1, 2, 3)] == [1, 1, 1] and [got["op13"][i].n_runs for i in (1, 2, 3)] == [0, 0, 0]
    assert [got["op2"][i].n_words for i in (1, 2, 3)] == [1, 1, 1] and [got["op11"][i].n_chars for i in (1, 2, 3)] == [250_000, 60_000, 40_000]
    assert len(got["op1"]) == len(got["op6"]) == len(got["op8"]) == 3
    assert sum(r.length for r in packing.op3(docs).collect()) == sum(r.doc_tokens for r in token_counts.op10(docs).select("doc_id", "doc_tokens").distinct().collect()) + 3
    assert collocations.op12(docs).collect() == []


def test_vectors_without_id(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(None, [1.0, 1.0]), (100, None), (120, [0.0, 0.0])]
    got = ann.op5(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and None not in {r.vec_id for r in got} and len(got) == 60


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_matches_sql(spark, key):
    con = duckdb.connect()
    path = f"{SF}/documents.parquet"
    con.execute(f"create view documents as select * from '{path}{'/*.parquet' if Path(path).is_dir() else ''}'")
    want = con.execute(queries.ORACLE[key])
    cols = [c[0] for c in want.description]
    df = queries.QUERIES[key](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.fetchall())
