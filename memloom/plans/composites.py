"""Jobs over all users at once: recommendations, opposed statements, the graph's history (inventory R9, J14, V4, section 2.14).

The SQL they are held against is written apart from the Spark form.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators.folds import picked
from memloom.operators.graph import first
from memloom.sources.adapters import AS_OF, oracle, run
from memloom.sources.session import staged

# ---- recommendations ---------------------------------------------------------------------------------
# Fixed values.
SIMILARITY, RECENCY, QUALITY, REPEATED, DECAY = 0.5, 0.3, 0.2, 0.3, 0.05
KEYWORD, FULL_OVERLAP = 0.3, 3
POOL, LEAST_INTEREST, MOST_INTERESTS, LEAST_INTERESTS = 100, 0.5, 10, 3
DEFAULT_INTERESTS = ["科技", "生活", "新闻"]
FEW_CHOICES = 1000  # lists of candidates that may be broadcast; they are counted first
PER_TASK = 2_000  # users whose lists one task scores
FRIEND = 50  # scores above are friend or close friend


def interests(feedback: DataFrame) -> DataFrame:
    """user_id, tag: up to ten tags of a weight above 0.5, filled up to three with the defaults. feedback: user_id, tag, weight."""
    best = first(feedback.where(F.col("weight") > LEAST_INTEREST), ["user_id"], [F.desc("weight"), "tag"], MOST_INTERESTS)
    lists = feedback.select("user_id").distinct().join(best.groupBy("user_id").agg(F.collect_list("tag").alias("tags")), "user_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    more = F.slice(F.array(*[F.lit(x) for x in DEFAULT_INTERESTS]), F.lit(1), F.greatest(F.lit(0), LEAST_INTERESTS - F.size("tags")))
    return lists.select("user_id", F.explode(F.concat("tags", more)).alias("tag"))


def recommend(users: DataFrame, wanted: DataFrame, content: DataFrame, history: DataFrame, k: int = 3) -> DataFrame:
    """user_id, rank, id: for every user the diverse best of the candidates (one of a source, two of a main tag).

    users: user_id, sources (the preferred ones, null for any); wanted: user_id, tag; content: id, source, main_tag, tags, hours, quality_score; history:
    user_id, id. The candidates of a user are the 100 of best quality, then latest, among the preferred sources, so only the first 100 of each source
    and the first 100 of all can matter. Users who prefer the same sources have the same candidates: these are listed once for each such choice, and a
    user stays one row, with tags and what of the lists was seen."""
    order = [F.desc("quality_score"), "hours", "id"]
    slim = content.select("id", "source", "main_tag", "hours", "quality_score", "tags")
    every = slim.orderBy(*order).limit(POOL).withColumn("pool", F.lit("*"))
    pools = staged(every.unionByName(first(slim.where("source IS NOT NULL"), ["source"], order, POOL).drop("rn").withColumn("pool", F.concat(F.lit("="), "source"))), "pools")
    named = F.array_sort(F.array_distinct(F.transform("sources", lambda s: F.concat(F.lit("="), s))))
    asks = staged(users.select("user_id", F.coalesce(named, F.array(F.lit("*"))).alias("asks")), "asks")
    recency = F.coalesce(F.exp(-DECAY * F.col("hours")), F.lit(0.5))
    item = F.struct("id", "source", F.col("main_tag").alias("tag"), F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), (RECENCY * recency).alias("recency"), (QUALITY * F.col("quality_score")).alias("quality"))
    mine = first(asks.select("asks").distinct().select("asks", F.explode("asks").alias("pool")).join(pools, "pool"), ["asks"], order, POOL)
    lists = staged(mine.groupBy("asks").agg(F.collect_list(item).alias("items")), "lists")
    lists = F.broadcast(lists) if lists.count() <= FEW_CHOICES else lists
    likes = wanted.groupBy("user_id").agg(F.collect_set("tag").alias("likes"))
    seen = history.select("user_id", "id").join(pools.select("id").distinct(), "id", "left_semi").groupBy("user_id").agg(F.collect_set("id").alias("seen"))
    # a user is a small row and much work, so tasks go with their number and not with their bytes
    dealt = asks.join(likes, "user_id", "left").join(seen, "user_id", "left").repartition(4 + asks.count() // PER_TASK, "user_id")
    rows = dealt.join(lists, "asks")

    def scored(x: Column) -> Column:
        common = F.size(F.filter(x["tags"], lambda t: F.array_contains(F.coalesce("likes", F.array().cast("array<string>")), t)))
        similarity = KEYWORD * F.least(common / FULL_OVERLAP, F.lit(1.0))
        again = F.when(F.array_contains("seen", x["id"]), REPEATED).otherwise(1.0)
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (SIMILARITY * similarity + x["recency"] + x["quality"]) * again)), 9)
        return F.struct((-score).alias("r"), x["id"].alias("id"), x["source"].alias("source"), x["tag"].alias("tag"))

    best = rows.select("user_id", F.array_sort(F.transform("items", scored)).alias("c"))
    return picked(best, k, 1, 2)


def r9_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recommendations for every user who has them enabled, is a friend and has not had the day's share."""
    library = staged(run(spark, sf_dir, "SELECT id AS content_id, main_tag, source FROM content_library"), "library")  # of a known size, without the texts
    likes = run(spark, sf_dir, "SELECT user_id, feedback, content_id, recommended_at FROM recommendations").join(library, "content_id")
    weigh = F.round(0.5 + 0.5 * F.avg(F.when(F.col("feedback").isin("like", "click"), 1.0).when(F.col("feedback") == "dislike", -1.0).otherwise(0.0)), 9)
    tags = likes.select("user_id", "feedback", F.explode(F.array_compact(F.array("main_tag", "source"))).alias("tag"))
    wanted = interests(tags.groupBy("user_id", "tag").agg(weigh.alias("weight")))
    friends = run(spark, sf_dir, f"SELECT user_id FROM latest_affinity WHERE new_score > {FRIEND} AND user_id % 4 <> 3")
    today = likes.where(F.to_date("recommended_at") == datetime.date(2024, 1, 30)).groupBy("user_id").agg(F.count("*").alias("today"))
    choice = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("src1"), F.lit("src2"), F.lit("src3"), F.lit("src4")))
    users = friends.join(today, "user_id", "left").where(F.coalesce("today", F.lit(0)) < 5).select("user_id", choice.alias("sources"))
    content = run(spark, sf_dir, f"SELECT id, source, main_tag, quality_score, (unix_micros(CAST(TIMESTAMP_NTZ '{AS_OF}' AS TIMESTAMP)) - unix_micros(CAST(published_at AS TIMESTAMP))) / 3600000000.0D AS hours FROM content_library WHERE is_active AND published_at > TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '24' HOUR")
    content = content.withColumn("tags", F.array_compact(F.array("main_tag", "source")))
    return recommend(users, wanted, content, likes.select("user_id", F.col("content_id").alias("id")))


# ---- opposed statements ------------------------------------------------------------------------------
# Fixed values.
OPPOSITES = [("喜欢", "讨厌"), ("喜欢", "不喜欢"), ("爱", "恨"), ("想要", "不想要"), ("需要", "不需要"), ("是", "不是"), ("有", "没有")]
TOPICS = ["茶", "咖啡", "电影", "音乐", "书", "运动", "旅游", "美食", "游戏", "工作", "学习", "朋友", "家人"]
CONFIDENCE, THRESHOLD = 0.9, 0.8


def statements(memories: DataFrame, opposites: list[tuple[str, str]], topics: list[str]) -> DataFrame:
    """id, owner, topic, pair, side: what each memory (id, owner, content) says about a topic; pair numbers the opposites from 0, side is 0 or 1. A memory that
    holds both words of a pair is on both sides."""
    low = F.lower("content")
    said = [F.when(F.contains(low, F.lit(w.lower())), F.struct(F.lit(i).alias("pair"), F.lit(s).alias("side"))) for i, p in enumerate(opposites) for s, w in enumerate(p)]
    about = [F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in topics]
    rows = memories.select("id", "owner", F.array_compact(F.array(*said)).alias("said"), F.array_compact(F.array(*about)).alias("about"))
    rows = rows.where((F.size("said") > 0) & (F.size("about") > 0)).select("id", "owner", F.explode("said").alias("s"), "about")
    return rows.select("id", "owner", F.explode("about").alias("topic"), "s.pair", "s.side")


def sides(said: DataFrame) -> DataFrame:
    """owner, topic, pair and of each side its size and least id, where two different memories oppose each other."""
    of = lambda s, x: F.when(F.col("side") == s, x)
    per = said.groupBy("owner", "topic", "pair").agg(F.min(of(0, F.col("id"))).alias("first_id"), F.min(of(1, F.col("id"))).alias("second_id"), F.count(of(0, F.lit(1))).alias("n_first"), F.count(of(1, F.lit(1))).alias("n_second"))
    return per.where("n_first > 0 AND n_second > 0 AND NOT (n_first = 1 AND n_second = 1 AND first_id = second_id)")


def opposed(said: DataFrame) -> DataFrame:
    """id, owner, topic, pair, side, n_opposed: every memory that opposes others, with how many."""
    both = said.groupBy("id", "owner", "topic", "pair").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    other = F.when(F.col("side") == 0, F.col("n_second")).otherwise(F.col("n_first")) - F.when(F.col("lo") < F.col("hi"), 1).otherwise(0)
    rows = said.join(sides(said).select("owner", "topic", "pair", "n_first", "n_second"), ["owner", "topic", "pair"]).join(both, ["id", "owner", "topic", "pair"])
    return rows.withColumn("n_opposed", other).where("n_opposed > 0").select("id", "owner", "topic", "pair", "side", "n_opposed")


# Word parts that stand in for opposites and topics, as the tables hold invented prose.
_STAND_IN = [("heention", "blees"), ("queque", "auxment"), ("ertionha", "thanea"), ("erat", "ther")]
_ABOUT = ["inenan", "thesened", "eau", "tion", "hein"]


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(run(spark, sf_dir, "SELECT id, user_id AS owner, content FROM memories WHERE status <> 'deleted'"), _STAND_IN, _ABOUT)


def j14_conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opposed statements of one owner about one topic, as two classes: every member of one opposes every (other) member of the other."""
    return sides(_said(spark, sf_dir))


def v4_detect_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory's opponents, with the confidence that is at least the threshold."""
    return opposed(_said(spark, sf_dir)).withColumn("confidence", F.lit(CONFIDENCE)).where(F.col("confidence") >= THRESHOLD)


# ---- the graph's history -----------------------------------------------------------------------------
ALIVE = 0.1  # weight under which an edge is gone


def timeline(edges: DataFrame, first_day: datetime.date, last_day: datetime.date, alive: float = ALIVE) -> DataFrame:
    """day, edges, weight: at the start of each day the edges whose decayed weight is above `alive`, and the sum of their weights.

    edges: weight, decay_rate, updated_at. An edge counts from the day it was last told until the day its weight has fallen too low, so it is two changes;
    changes are summed by decay rate and day and run up over the days. The edges are read once, whatever the number of days; what is run up has one row a rate and day."""
    span = (last_day - first_day).days
    zero = F.lit(first_day)
    day = F.datediff(F.to_date("updated_at"), zero) + F.when(F.col("updated_at") > F.to_date("updated_at").cast("timestamp_ntz"), 1).otherwise(0)
    w, r = F.col("weight"), F.col("decay_rate")
    guess = F.ceil(F.log(w / alive) / r)  # days until it is gone; the two checks undo rounding
    gone = F.when(w * F.exp(-r * (guess - 1)) <= alive, guess - 1).when(w * F.exp(-r * guess) > alive, guess + 1).otherwise(guess)
    rows = edges.where(w > alive).select(r.alias("rate"), w.alias("w"), day.alias("enter"), F.when(r > 0, gone).alias("life"))
    rows = rows.withColumn("lift", F.col("w") * F.exp(F.col("rate") * F.col("enter")))  # its weight as if told on day 0
    told = F.col("life").isNull() | (F.col("enter") + F.col("life") > 0)
    into = F.when(told, F.struct(F.greatest(F.col("enter"), F.lit(0)).alias("at"), F.lit(1).alias("n"), F.col("lift").alias("x")))
    out = F.when(told & F.col("life").isNotNull(), F.struct((F.col("enter") + F.col("life")).alias("at"), F.lit(-1).alias("n"), (-F.col("lift")).alias("x")))
    # both changes of an edge come from one row: a union would read the edges twice, and filters would be worked out below what makes the edges distinct
    each = rows.select("rate", F.explode(F.array(into, out)).alias("c"))
    change = each.where(F.col("c.at") <= span).groupBy("rate", F.col("c.at").alias("at")).agg(F.sum("c.n").alias("n"), F.sum("c.x").alias("x"))
    change = staged(change, "changes")  # one row a rate and day, read twice
    days = edges.sparkSession.range(span + 1).select(F.col("id").alias("at"))
    grid = change.select("rate").distinct().select("rate", F.explode(F.sequence(F.lit(0), F.lit(span))).alias("at")).join(change, ["rate", "at"], "left")
    up = Window.partitionBy("rate").orderBy("at")
    run_up = grid.select("at", F.sum(F.coalesce("n", F.lit(0))).over(up).alias("n"), (F.sum(F.coalesce("x", F.lit(0.0))).over(up) * F.exp(-F.col("rate") * F.col("at"))).alias("x"))
    per = run_up.groupBy("at").agg(F.sum("n").alias("edges"), F.sum("x").alias("weight"))
    return days.join(per, "at", "left").select(F.date_add(zero, F.col("at").cast("int")).alias("day"), F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def c1_graph_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots over the last 30 days by day, 90 by week and 365 by month."""
    last = datetime.date(2024, 1, 31)
    rows = timeline(run(spark, sf_dir, "SELECT weight, decay_rate, updated_at FROM edges"), last - datetime.timedelta(days=365), last)
    back = F.datediff(F.lit(last), "day")
    kinds: list[tuple[str, Column]] = [("day", back <= 30), ("week", (back <= 90) & (back % 7 == 0)), ("month", F.dayofmonth("day") == 1)]
    kind = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]))).alias("interval")
    return rows.select(kind, "day", "edges", F.round("weight", 3).alias("weight"))


QUERIES = {f.__name__: f for f in (r9_recommend, j14_conflict_pairs, v4_detect_conflicts, c1_graph_timeline)}

# ---- the same by hand for DuckDB ---------------------------------------------------------------------
_SAID = """memo AS (SELECT id, user_id AS owner, lower(content) AS t FROM memories WHERE status <> 'deleted'),
 words(pair, side, w) AS (VALUES (0, 0, 'heention'), (0, 1, 'blees'), (1, 0, 'queque'), (1, 1, 'auxment'), (2, 0, 'ertionha'), (2, 1, 'thanea'), (3, 0, 'erat'), (3, 1, 'ther')),
 about(topic) AS (VALUES ('inenan'), ('thesened'), ('eau'), ('tion'), ('hein')),
 said AS (SELECT m.id, m.owner, a.topic, x.pair, x.side FROM memo m JOIN words x ON contains(m.t, x.w) JOIN about a ON contains(m.t, a.topic))"""
ORACLE = {
    "j14_conflict_pairs": oracle(f"WITH {_SAID} SELECT * FROM (SELECT owner, topic, pair, min(id) FILTER (side = 0) AS first_id, min(id) FILTER (side = 1) AS second_id, count(*) FILTER (side = 0) AS n_first, count(*) FILTER (side = 1) AS n_second FROM said GROUP BY owner, topic, pair) y WHERE n_first > 0 AND n_second > 0 AND NOT (n_first = 1 AND n_second = 1 AND first_id = second_id)"),
    "v4_detect_conflicts": oracle(f"WITH {_SAID} SELECT a.id, a.owner, a.topic, a.pair, a.side, count(*) AS n_opposed, 0.9::DOUBLE AS confidence FROM said a JOIN said b ON b.owner = a.owner AND b.topic = a.topic AND b.pair = a.pair AND b.side <> a.side AND b.id <> a.id GROUP BY a.id, a.owner, a.topic, a.pair, a.side"),
    "c1_graph_timeline": oracle(f"""WITH days AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '2023-01-31', DATE '2024-02-01', INTERVAL 1 DAY) t(d)),
 chosen AS (SELECT 'day' AS interval, day FROM days WHERE DATE '2024-01-31' - day <= 30 UNION ALL SELECT 'week', day FROM days WHERE DATE '2024-01-31' - day <= 90 AND (DATE '2024-01-31' - day) % 7 = 0 UNION ALL SELECT 'month', day FROM days WHERE day(day) = 1),
 state AS (SELECT c.interval, c.day, e.weight * exp(-e.decay_rate * (c.day - CAST(e.updated_at AS DATE))) AS w FROM chosen c JOIN edges e ON e.updated_at <= c.day)
 SELECT c.interval, c.day, count(s.w) AS edges, round(coalesce(sum(s.w), 0), 3) AS weight FROM chosen c LEFT JOIN state s ON s.interval = c.interval AND s.day = c.day AND s.w > 0.1 GROUP BY c.interval, c.day"""),
    "r9_recommend": oracle(
        f"""WITH RECURSIVE likes AS (SELECT r.user_id, c.main_tag, c.source, r.feedback, r.content_id, r.recommended_at FROM recommendations r JOIN content_library c ON c.id = r.content_id),
 tagged AS (SELECT user_id, feedback, unnest([main_tag, source]) AS tag FROM likes),
 weighed AS (SELECT user_id, tag, round(0.5 + 0.5 * avg(CASE WHEN feedback IN ('like', 'click') THEN 1.0 WHEN feedback = 'dislike' THEN -1.0 ELSE 0.0 END), 9) AS weight FROM tagged WHERE tag IS NOT NULL GROUP BY user_id, tag),
 wanted AS (SELECT user_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, tag) AS k FROM weighed WHERE weight > 0.5) y WHERE k <= 10),
 users AS (SELECT l.user_id FROM latest_affinity l LEFT JOIN (SELECT user_id, count(*) AS today FROM likes WHERE CAST(recommended_at AS DATE) = DATE '2024-01-30' GROUP BY user_id) t ON t.user_id = l.user_id
  WHERE l.new_score > 50 AND l.user_id % 4 <> 3 AND coalesce(t.today, 0) < 5),
 fresh AS (SELECT id, source, main_tag, quality_score, published_at FROM content_library WHERE is_active AND published_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR),
 pool AS (SELECT * FROM (SELECT u.user_id, f.*, row_number() OVER (PARTITION BY u.user_id ORDER BY f.quality_score DESC, f.published_at DESC, f.id) AS k FROM users u JOIN fresh f ON u.user_id % 3 <> 0 OR f.source IN ('src1', 'src2', 'src3', 'src4')) y WHERE k <= 100),
 scored AS (SELECT p.user_id, p.id, p.source, p.main_tag AS tag, round(greatest(0, least(1, (0.5 * 0.3 * least((SELECT count(*) FROM wanted w WHERE w.user_id = p.user_id AND w.tag IN (p.main_tag, p.source)) / 3.0::DOUBLE, 1)
  + 0.3 * exp(-0.05 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(p.published_at)) / 3600000000.0::DOUBLE) + 0.2 * p.quality_score)
  * CASE WHEN EXISTS (SELECT 1 FROM likes h WHERE h.user_id = p.user_id AND h.content_id = p.id) THEN 0.3 ELSE 1.0 END)), 9) AS score FROM pool p),
 best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS r FROM scored),
 tried AS (SELECT user_id, r, true AS goes, [source] AS sources, [tag] AS tags, id FROM best WHERE r = 1
 UNION ALL SELECT user_id, r, goes, CASE WHEN goes THEN list_append(sources, source) ELSE sources END, CASE WHEN goes THEN list_append(tags, tag) ELSE tags END, id
 FROM (SELECT b.user_id, b.r, b.id, b.source, b.tag, t.sources, t.tags, len(t.sources) < 3 AND len(list_filter(t.sources, lambda s: s = b.source)) < 1 AND len(list_filter(t.tags, lambda s: s = b.tag)) < 2 AS goes
  FROM tried t JOIN best b ON b.user_id = t.user_id AND b.r = t.r + 1) step)
 SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY r) AS INT) AS rank, id FROM tried WHERE goes"""
    ),
}
