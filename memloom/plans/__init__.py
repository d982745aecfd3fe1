"""Registered queries of the memory engine and the SQL they are held against."""

from memloom.plans import composites, dataframes, feeds, graph, memory_state, questions, reports, retrieval, scores, services, streams, text_rules  # noqa: F401  (they register their queries)
from memloom.plans.catalog import CATALOG
from memloom.sources.adapters import DUCK, SPARK, oracle, run


def _query(key: str):
    def query(spark, sf_dir):
        return run(spark, sf_dir, CATALOG[key](SPARK))

    query.__name__ = key
    return query


QUERIES: dict = {k: _query(k) for k in CATALOG} | dataframes.QUERIES | retrieval.QUERIES | graph.QUERIES | streams.QUERIES | composites.QUERIES | feeds.QUERIES | reports.QUERIES | questions.QUERIES
ORACLE: dict = {k: oracle(f(DUCK)) for k, f in CATALOG.items()} | dataframes.ORACLE | retrieval.ORACLE | graph.ORACLE | streams.ORACLE | composites.ORACLE | feeds.ORACLE | reports.ORACLE | questions.ORACLE
