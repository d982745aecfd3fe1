"""Hybrid retrieval for every query: nearest memories, graph expansion, four-factor rank (inventory R1 to R4, R7, M4, M7, M8, J19, A35).

Queries are the vectors whose id is divisible by 20. Each is asked by one of the 15 users, in turn, and sees that user's memories.
The SQL they are held against is written apart from the Spark form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.graph import first
from memloom.operators.topk import top_k_join
from memloom.sources.adapters import AS_OF, DUCK, SPARK, oracle, run
from memloom.sources.session import staged

# Fixed values.
COSINE, EDGE, AFFINITY, RECENCY = 0.4, 0.3, 0.2, 0.1
CANDIDATES, EXPANDED, NEIGHBOURS, MEMORIES = 50, 10, 5, 5
NEIGHBOUR_WEIGHT, LEAST_EDGE = 0.5, 0.3
BOOST, BOOST_DAYS = 1.15, 7


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live memories, their vectors and ages in days."""
    return run(spark, sf_dir, f"SELECT id, user_id, valence, status, created_at, embedding, {SPARK.days(SPARK.ts(), 'created_at')} AS days FROM memories WHERE status <> 'deleted'")


def near(spark: SparkSession, sf_dir: str, k: int = CANDIDATES) -> DataFrame:
    """query_id, user_id, id, sim, rn of the k nearest memories of the query's user."""
    asked = run(spark, sf_dir, "SELECT vec_id AS query_id, vec_id div 20 % 15 AS user_id, embedding AS vector FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
    stored = memories(spark, sf_dir).where("embedding IS NOT NULL").select("id", "user_id", F.col("embedding").alias("vector"))
    return top_k_join(asked, stored, k, "user_id").join(asked.select("query_id", "user_id"), "query_id").select("query_id", "user_id", "id", F.col("score").alias("sim"), "rn")


def primary_entities(mentions: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, node: the entity of each memory of highest confidence (0.8 if not given), the latest of equals."""
    rows = mentions.join(wanted.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi")
    order = [F.desc(F.coalesce("confidence", F.lit(0.8))), F.desc("created_at"), "node", "seq"]
    return first(rows, ["memory_id"], order, 1).select(F.col("memory_id").alias("id"), "node")


def neighbours(edges: DataFrame, wanted: DataFrame, least: float = LEAST_EDGE, most: int = NEIGHBOURS) -> DataFrame:
    """node, via, weight: the best neighbours of each node over edges in either direction whose decayed weight is above `least`."""
    kept = edges.where(F.col("current_weight") > least)
    both = kept.select(F.col("src").alias("node"), F.col("dst").alias("via"), "current_weight").unionByName(kept.select(F.col("dst").alias("node"), F.col("src").alias("via"), "current_weight"))
    best = both.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node", "via").agg(F.max("current_weight").alias("weight"))
    return first(best, ["node"], [F.desc(F.round("weight", 9)), "via"], most).select("node", "via", "weight")


def latest_memories(mentions: DataFrame, stored: DataFrame, wanted: DataFrame, most: int = MEMORIES) -> DataFrame:
    """user_id, via, memory_id: a user's latest committed memories that mention an entity, for the wanted (user_id, via)."""
    own = stored.where("status = 'committed'").select(F.col("id").alias("memory_id"), "user_id", F.col("created_at").alias("told_at"))
    some = mentions.withColumnRenamed("node", "via").join(wanted.select("via").distinct(), "via", "left_semi")  # others are left before the shuffle
    rows = some.join(own, "memory_id").join(wanted.select("user_id", "via").distinct(), ["user_id", "via"], "left_semi")
    order = [F.desc("created_at"), F.desc(F.coalesce("confidence", F.lit(0.8))), F.desc("told_at"), "memory_id", "seq"]
    return first(rows, ["user_id", "via"], order, most).select("user_id", "via", "memory_id")


def expanded(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """query_id, user_id, id, via: memories that neighbours of the first ten candidates' entities lead to, for each query, and that it has not found itself."""
    mentions = run(spark, sf_dir, "SELECT memory_id, node, seq, confidence, created_at FROM mentions")
    edges = run(spark, sf_dir, "SELECT src, dst, current_weight FROM decayed_edges WHERE rel_type = 'RELATED_TO'")
    seeds = found.where(F.col("rn") <= EXPANDED).select("query_id", "user_id", "id")
    at = staged(seeds.join(primary_entities(mentions, seeds), "id"), "seed_entities")
    steps = staged(at.join(neighbours(edges, at), "node").select("query_id", "user_id", "via").distinct(), "neighbours")
    more = steps.join(latest_memories(mentions, memories(spark, sf_dir), steps), ["user_id", "via"]).select("query_id", "user_id", F.col("memory_id").alias("id"), "via").distinct()
    return more.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, id and the four parts of the score of every candidate, found or reached over the graph."""
    found = staged(near(spark, sf_dir), "near")
    reached = expanded(spark, sf_dir, found).select("query_id", "user_id", "id").distinct()
    both = found.select("query_id", "user_id", "id", "sim", F.lit(0.0).alias("edge")).unionByName(reached.withColumn("sim", F.lit(0.0)).withColumn("edge", F.lit(NEIGHBOUR_WEIGHT)))
    affinity = run(spark, sf_dir, "SELECT user_id, new_score / 100 AS affinity FROM latest_affinity")
    rows = both.join(memories(spark, sf_dir).select("id", "valence", "days"), "id").join(affinity, "user_id", "left")
    bonus = F.when(F.col("valence") > 0, F.greatest(F.lit(0.0), F.coalesce("affinity", F.lit(0.0)))).otherwise(0.0)
    return rows.select("query_id", "user_id", "id", "sim", "days", "valence", (COSINE * F.col("sim")).alias("cosine_part"), (EDGE * F.col("edge")).alias("edge_part"), (AFFINITY * bonus).alias("affinity_part"), (RECENCY * F.exp(-F.col("days") / 30)).alias("recency_part"))


def total() -> Column:
    return F.round(F.col("cosine_part") + F.col("edge_part") + F.col("affinity_part") + F.col("recency_part"), 9)


def r1_hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best memories of each query by the four factors."""
    rows = factors(spark, sf_dir).withColumn("total", total())
    return first(rows, ["query_id"], [F.desc("total"), "id"], 10, "rk").select("query_id", "id", F.round("total", 6).alias("score"), "rk")


def r2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest of all live memories to each query, whoever they belong to, their similarity and recency."""
    stored = memories(spark, sf_dir).where("embedding IS NOT NULL").select("id", F.col("embedding").alias("vector"), "days")
    asked = run(spark, sf_dir, "SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
    found = top_k_join(asked, stored.select("id", "vector"), CANDIDATES)
    rows = found.withColumnRenamed("score", "sim").join(stored.select("id", "days"), "id")
    return rows.select("query_id", "id", F.round("sim", 6).alias("sim"), F.round(F.exp(-F.col("days") / 30), 6).alias("recency"), "rn")


def r3_graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph adds to each query's candidates."""
    return expanded(spark, sf_dir, staged(near(spark, sf_dir), "near")).select("query_id", "id").distinct().select("query_id", "id", F.lit(NEIGHBOUR_WEIGHT).alias("edge_weight"), F.lit(0.0).alias("cosine"))


def j19_neighbour_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each neighbour through which a query reaches a memory."""
    return expanded(spark, sf_dir, staged(near(spark, sf_dir), "near")).select("query_id", "via", F.col("id").alias("memory_id"))


def m4_factor_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every candidate's score."""
    return factors(spark, sf_dir).select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("cosine_part", "edge_part", "affinity_part", "recency_part")])


def mentioned(mentions: DataFrame, found: DataFrame) -> DataFrame:
    """memory_id, node: the distinct entities of the memories that found names; mentions of others are left before anything is shuffled for the distinct rows."""
    wanted = found.select(F.col("query_id").alias("memory_id")).union(found.select("id")).distinct()
    return mentions.join(wanted, "memory_id", "left_semi").select("memory_id", "node").distinct()


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near with the age, and the number of entities that the query's memory and the candidate both mention."""
    found = staged(near(spark, sf_dir), "near")
    names = mentioned(run(spark, sf_dir, "SELECT memory_id, node FROM mentions"), found)
    mine = found.select("query_id", "id").join(names.withColumnRenamed("memory_id", "query_id"), "query_id")
    common = mine.join(names.withColumnRenamed("memory_id", "id"), ["id", "node"]).groupBy("query_id", "id").agg(F.count("*").alias("common"))
    rows = found.join(common, ["query_id", "id"], "left").join(memories(spark, sf_dir).select("id", "days", "valence"), "id")
    return rows.withColumn("common", F.coalesce("common", F.lit(0)))


def m7_hybrid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 of the similarity and 0.3 of the overlap of entities, three being full."""
    return overlapping(spark, sf_dir).select("query_id", "id", F.round(0.7 * F.col("sim") + 0.3 * F.least(F.col("common") / 3, F.lit(1.0)), 6).alias("similarity"))


def m8_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and graph parts fused (alpha 0.6), with overlap and recency on top; the graph part is the share of the query's candidates' best overlap."""
    rows = overlapping(spark, sf_dir)
    most = rows.groupBy("query_id").agg(F.max("common").alias("most"))
    graph = F.when(F.col("most") > 0, F.col("common") / F.col("most")).otherwise(0.0)
    fused = 0.6 * F.col("sim") + 0.4 * graph + 0.02 * F.col("common") + 0.1 * F.exp(-F.col("days") / 30)
    return rows.join(most, "query_id").select("query_id", "id", F.round(fused, 6).alias("fused"))


def r7_context_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest memories of the query's user, the latest of equals, and how often all queries have read each of them."""
    stored = run(spark, sf_dir, "SELECT id, created_at FROM memories")
    wide = near(spark, sf_dir, 64).join(stored, "id").withColumn("sim", F.round("sim", 6))
    best = staged(first(wide, ["query_id"], [F.desc("sim"), F.desc("created_at"), "id"], 3, "rk"), "context")
    read = best.groupBy("id").agg(F.count("*").alias("access_count"))
    return best.join(read, "id").select("query_id", "id", "sim", "access_count")


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rn, hit of the ten nearest vectors, and gold, the number of relevant ones: those of the query's label."""
    v = run(spark, sf_dir, "SELECT vec_id, label, embedding AS vector FROM embeddings WHERE embedding IS NOT NULL")
    asked = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = top_k_join(asked.select("query_id", "vector"), v.select(F.col("vec_id").alias("id"), "vector"), 10)
    gold = v.groupBy("label").agg((F.count("*") - 1).alias("gold"))
    own = asked.select("query_id", "label").join(gold, "label")
    return found.join(own, "query_id").join(v.select(F.col("vec_id").alias("id"), F.col("label").alias("got")), "id").select("query_id", "rn", (F.col("label") == F.col("got")).cast("int").alias("hit"), "gold")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    per = relevance(spark, sf_dir).groupBy(F.col("query_id").alias("qid"), "gold").agg(
        F.sum("hit").alias("h10"), F.sum(F.when(F.col("rn") <= 5, F.col("hit")).otherwise(0)).alias("h5"),
        F.coalesce(F.max(F.when(F.col("hit") == 1, 1 / F.col("rn"))), F.lit(0.0)).alias("mrr"), F.sum(F.col("hit") / F.log2(F.col("rn") + 1.0)).alias("dcg"),
    )
    some = F.col("gold") > 0
    of = lambda c: F.when(some, F.col(c) / F.col("gold")).otherwise(0.0)
    return per.select("qid", of("h5").alias("recall_5"), of("h10").alias("recall_10"), "mrr", F.when(some, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg_10"))


def a35_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and NDCG of each query's ten nearest vectors."""
    return _metrics(spark, sf_dir).select("qid", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")])


def a35_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their means over all queries."""
    return _metrics(spark, sf_dir).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")])


QUERIES = {
    f.__name__: f
    for f in (r1_hybrid_retrieve, r2_vector_search, r3_graph_expand, j19_neighbour_memories, m4_factor_breakdown, m7_hybrid_similarity, m8_fusion, r7_context_retrieval, a35_retrieval_metrics, a35_metric_means)
}

# ---- the same by hand for DuckDB ---------------------------------------------------------------------
_AGE = DUCK.days(f"TIMESTAMP '{AS_OF}'", "m.created_at")
_NEAR = """near AS (SELECT * FROM (SELECT q.vec_id AS query_id, m.user_id, m.id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 9) AS sim,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 9) DESC, m.id) AS rn
  FROM embeddings q JOIN memories m ON m.user_id = q.vec_id // 20 % 15 AND m.id <> q.vec_id WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND m.embedding IS NOT NULL AND m.status <> 'deleted') x WHERE rn <= 50)"""
_NEAR_ALL = _NEAR.replace("m.user_id = q.vec_id // 20 % 15 AND m.id <> q.vec_id", "m.id <> q.vec_id")
_EXPAND = f"""{_NEAR},
 best_entity AS (SELECT memory_id, node FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY coalesce(confidence, 0.8) DESC, created_at DESC, node, seq) AS k FROM mentions) x WHERE k = 1),
 sides AS (SELECT src AS node, dst AS via, current_weight AS w FROM decayed_edges WHERE rel_type = 'RELATED_TO' UNION ALL SELECT dst, src, current_weight FROM decayed_edges WHERE rel_type = 'RELATED_TO'),
 around AS (SELECT node, via FROM (SELECT node, via, row_number() OVER (PARTITION BY node ORDER BY round(max(w), 9) DESC, via) AS k FROM sides WHERE w > 0.3 GROUP BY node, via) x WHERE k <= 5),
 told AS (SELECT user_id, node, memory_id FROM (SELECT m.user_id, e.node, e.memory_id, row_number() OVER (PARTITION BY m.user_id, e.node ORDER BY e.created_at DESC, coalesce(e.confidence, 0.8) DESC, m.created_at DESC, e.memory_id, e.seq) AS k
  FROM mentions e JOIN memories m ON m.id = e.memory_id WHERE m.status = 'committed') x WHERE k <= 5),
 reached AS (SELECT DISTINCT n.query_id, n.user_id, a.via, t.memory_id AS id FROM near n JOIN best_entity b ON b.memory_id = n.id JOIN around a ON a.node = b.node JOIN told t ON t.user_id = n.user_id AND t.node = a.via
  WHERE n.rn <= 10 AND NOT EXISTS (SELECT 1 FROM near s WHERE s.query_id = n.query_id AND s.id = t.memory_id))"""
_FACTORS = f"""{_EXPAND},
 everyone AS (SELECT query_id, user_id, id, sim, 0.0::DOUBLE AS edge FROM near UNION ALL SELECT DISTINCT query_id, user_id, id, 0.0::DOUBLE, 0.5::DOUBLE FROM reached),
 parts AS (SELECT e.query_id, e.id, 0.4::DOUBLE * e.sim AS cosine_part, 0.3::DOUBLE * e.edge AS edge_part, 0.2::DOUBLE * CASE WHEN m.valence > 0 THEN greatest(0.0::DOUBLE, coalesce(l.new_score / 100, 0.0::DOUBLE)) ELSE 0 END AS affinity_part,
  0.1::DOUBLE * exp(-CAST({_AGE} AS DOUBLE) / 30) AS recency_part FROM everyone e JOIN memories m ON m.id = e.id LEFT JOIN latest_affinity l ON l.user_id = e.user_id)"""
_COMMON = f"""{_NEAR}, names AS (SELECT DISTINCT memory_id, node FROM mentions),
 counted AS (SELECT n.query_id, n.id, count(y.node) AS common FROM near n LEFT JOIN names x ON x.memory_id = n.query_id LEFT JOIN names y ON y.memory_id = n.id AND y.node = x.node GROUP BY n.query_id, n.id),
 joined AS (SELECT n.query_id, n.id, n.sim, c.common, {_AGE} AS days FROM near n JOIN counted c ON c.query_id = n.query_id AND c.id = n.id JOIN memories m ON m.id = n.id)"""
_RANKED = """ranked AS (SELECT * FROM (SELECT q.vec_id AS qid, v.vec_id, q.label = v.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS rn
  FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL) x WHERE rn <= 10),
 gold AS (SELECT label, count(*) - 1 AS gold FROM embeddings WHERE embedding IS NOT NULL GROUP BY label),
 per AS (SELECT r.qid, g.gold, count(CASE WHEN hit AND rn <= 5 THEN 1 END) AS h5, count(CASE WHEN hit THEN 1 END) AS h10, coalesce(max(CASE WHEN hit THEN 1.0::DOUBLE / rn END), 0) AS mrr, sum(CASE WHEN hit THEN 1 / log2(CAST(rn + 1 AS DOUBLE)) ELSE 0 END) AS dcg
  FROM ranked r JOIN embeddings q ON q.vec_id = r.qid JOIN gold g ON g.label = q.label GROUP BY r.qid, g.gold),
 measured AS (SELECT qid, CASE WHEN gold > 0 THEN CAST(h5 AS DOUBLE) / gold ELSE 0 END AS recall_5, CASE WHEN gold > 0 THEN CAST(h10 AS DOUBLE) / gold ELSE 0 END AS recall_10, mrr,
  CASE WHEN gold > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(gold, 10) AS BIGINT) + 1), lambda i: 1 / log2(CAST(i + 1 AS DOUBLE)))) ELSE 0 END AS ndcg_10 FROM per)"""

ORACLE = {
    "r1_hybrid_retrieve": oracle(f"WITH {_FACTORS}, summed AS (SELECT query_id, id, round(cosine_part + edge_part + affinity_part + recency_part, 9) AS total FROM parts) SELECT query_id, id, round(total, 6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) AS rk FROM summed) y WHERE rk <= 10"),
    "r2_vector_search": oracle(f"WITH {_NEAR_ALL} SELECT n.query_id, n.id, round(n.sim, 6) AS sim, round(exp(-CAST({_AGE} AS DOUBLE) / 30), 6) AS recency, n.rn FROM near n JOIN memories m ON m.id = n.id"),
    "r3_graph_expand": oracle(f"WITH {_EXPAND} SELECT DISTINCT query_id, id, 0.5::DOUBLE AS edge_weight, 0.0::DOUBLE AS cosine FROM reached"),
    "j19_neighbour_memories": oracle(f"WITH {_EXPAND} SELECT query_id, via, id AS memory_id FROM reached"),
    "m4_factor_breakdown": oracle(f"WITH {_FACTORS} SELECT query_id, id, round(cosine_part, 6) AS cosine_part, round(edge_part, 6) AS edge_part, round(affinity_part, 6) AS affinity_part, round(recency_part, 6) AS recency_part FROM parts"),
    "m7_hybrid_similarity": oracle(f"WITH {_COMMON} SELECT query_id, id, round(0.7::DOUBLE * sim + 0.3::DOUBLE * least(CAST(common AS DOUBLE) / 3, 1), 6) AS similarity FROM joined"),
    "m8_fusion": oracle(f"WITH {_COMMON}, topped AS (SELECT *, max(common) OVER (PARTITION BY query_id) AS most FROM joined) SELECT query_id, id, round(0.6::DOUBLE * sim + 0.4::DOUBLE * CASE WHEN most > 0 THEN CAST(common AS DOUBLE) / most ELSE 0 END + 0.02::DOUBLE * common + 0.1::DOUBLE * exp(-CAST(days AS DOUBLE) / 30), 6) AS fused FROM topped"),
    "r7_context_retrieval": oracle(f"WITH {_NEAR}, three AS (SELECT * FROM (SELECT n.query_id, n.id, round(n.sim, 6) AS sim, row_number() OVER (PARTITION BY n.query_id ORDER BY round(n.sim, 6) DESC, m.created_at DESC, n.id) AS rk FROM near n JOIN memories m ON m.id = n.id) y WHERE rk <= 3) SELECT query_id, id, sim, count(*) OVER (PARTITION BY id) AS access_count FROM three"),
    "a35_retrieval_metrics": f"WITH {_RANKED} SELECT qid, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr, round(ndcg_10, 6) AS ndcg_10 FROM measured",
    "a35_metric_means": f"WITH {_RANKED} SELECT count(*) AS queries, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10 FROM measured",
}
