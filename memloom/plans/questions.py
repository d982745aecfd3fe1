"""Policies of questions, answers by pattern and extra tags (inventory F13, F23, F24).

As the test tables hold neither questions with evidence nor Chinese, each memory or meme gives one made text of its own. The SQL states what each of
them must give, apart from the patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import answers
from memloom.sources.adapters import oracle, run

#: Questions and evidence by the remainder of a memory's id; {d}, {M}, {m}, {y} are a day, a month, its first three letters and a year.
ASKED = (
    ("When did they meet?", "We met on {d} {M} {y}, I think."),
    ("When was the trip?", "It was the Friday before {d} {m} {y}."),
    ("When did it start?", "In the week before {d} {M} {y} it began"),
    ("When is it?", "some time in {M} {y}"),
    ("How long have you known Ann?", "Known for 0{d} years now, since {y}"),
    ("Where did she move?", "moved from {M} to {m}"),
    ("What did Ann research?", "She researched the {M}-{d} agencies; then slept"),
    ("What is her identity? ", "a trans woman since {y}"),
    ("What is his relationship status?", "still Single in {M}"),
    ("What did they realize about self-care?", "that self-care is really important to us, {d}"),
    ("How does she do self-care?", "by  carving out time for her violin; in {M}"),
    ("What was the Sunday before {d} {M} {y}?", ""),
    ("Analyze the {M} of {y}, please", "from {M} {y}"),
)
NAMED = ("in 哈尔滨", "北京到上海", "Messi 梅西 in 南京", "泡茶", "欧冠 and 普洱 at 苏州, 苏州", "c罗", "plain")


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, question, evidence: one for each memory."""
    rows = run(spark, sf_dir, "SELECT id, user_id FROM memories").withColumn("month", F.get(F.array(*[F.lit(m.capitalize()) for m in answers.MONTHS]), (F.col("user_id") % 12).cast("int")))
    values = {"{d}": (F.col("id") % 28 + 1).cast("string"), "{M}": F.col("month"), "{m}": F.left("month", F.lit(3)), "{y}": (F.col("id") % 50 + 1980).cast("string")}
    out = []
    for part in (0, 1):
        text = F.get(F.array(*[F.lit(a[part]) for a in ASKED]), (F.col("id") % len(ASKED)).cast("int"))
        for mark, value in values.items():
            text = F.replace(text, F.lit(mark), value)
        out.append(text)
    return rows.select("id", out[0].alias("question"), out[1].alias("evidence"))


def f13_extra_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of every meme's description, to which a name is added."""
    rows = run(spark, sf_dir, "SELECT id, text_description FROM memes")
    text = F.concat_ws("\n", "text_description", F.get(F.array(*[F.lit(n) for n in NAMED]), (F.col("id") % len(NAMED)).cast("int")))
    return rows.select("id", F.array_join(answers.extra_tags(text), ",").alias("tags"))


def f23_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy of every turn, and of the question made for every memory."""
    turns = run(spark, sf_dir, "SELECT session_id * 1000 + turn AS id, content AS question FROM conversation_turns").withColumn("kind", F.lit("turn"))
    asked = _filled(spark, sf_dir).select("id", "question").withColumn("kind", F.lit("memory"))
    return turns.unionByName(asked).select("kind", "id", answers.answer_policy(F.col("question")).alias("policy"))


def f24_extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer found in each memory's evidence."""
    return _filled(spark, sf_dir).select("id", answers.extract_answer(F.col("question"), F.col("evidence")).alias("answer"))


QUERIES = {f.__name__: f for f in (f13_extra_tags, f23_policy, f24_extract_answer)}

# ---- the same by hand for DuckDB ---------------------------------------------------------------------
_TAGS = ("哈尔滨", "北京,上海", "南京,足球", "喝茶", "苏州,足球,喝茶", "", "")
_PARTS = f"""parts AS (SELECT id, id % {len(ASKED)} AS k, id % 28 + 1 AS d, id % 50 + 1980 AS y, ['January','February','March','April','May','June','July','August','September','October','November','December'][CAST(user_id % 12 AS INT) + 1] AS m FROM memories)"""
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ANY = lambda words: f"list_bool_or([contains(q, w) for w in {_LIST(words)}])"
_FIRST = lambda words: f"list_bool_or([starts_with(q, w) for w in {_LIST(words)}])"
ORACLE = {
    "f13_extra_tags": oracle(f"SELECT id, {_LIST(_TAGS)}[CAST(id % {len(NAMED)} AS INT) + 1] AS tags FROM memes"),
    "f23_policy": oracle(f"""WITH told AS (SELECT 'turn' AS kind, session_id * 1000 + turn AS id, trim(lower(coalesce(content, '')), chr(32) || chr(9) || chr(10) || chr(13)) AS q FROM conversation_turns),
 counted AS (SELECT *, len([w for w in string_split_regex(q, '\\s+') if w <> '']) AS n FROM told)
 SELECT kind, id, CASE WHEN {_ANY(answers.OPINION)} THEN 'reasoning' WHEN {_FIRST(('what ', 'which '))} AND n <= 20 THEN 'strict_factual' WHEN {_ANY(answers.REASONING_MARKERS)} THEN 'reasoning'
 WHEN {_FIRST(answers.STRICT_STARTS)} OR {_ANY(answers.STRICT_MARKERS)} OR n < 15 THEN 'strict_factual' ELSE 'reasoning' END AS policy FROM counted
 UNION ALL SELECT 'memory', id, CASE WHEN id % {len(ASKED)} = 12 THEN 'reasoning' ELSE 'strict_factual' END FROM memories"""),
    "f24_extract_answer": oracle(f"""WITH {_PARTS} SELECT id, CASE k WHEN 0 THEN concat(d, ' ', m, ' ', y) WHEN 1 THEN concat('The friday before ', d, ' ', m, ' ', y) WHEN 2 THEN concat('The week before ', d, ' ', m, ' ', y) WHEN 3 THEN concat(m, ' ', y)
 WHEN 4 THEN concat(d, ' years') WHEN 5 THEN m WHEN 6 THEN concat(m, ' ', d, ' agencies') WHEN 7 THEN 'Transgender woman' WHEN 8 THEN 'Single' WHEN 9 THEN 'self-care is important' WHEN 10 THEN 'by carving out time for the violin'
 WHEN 11 THEN concat('The sunday before ', d, ' ', m, ' ', y) END AS answer FROM parts"""),
}
