"""Policies, answers by pattern and tags against values worked out by hand."""

from pyspark.sql import functions as F

from memloom.functions import answers


def test_policies(spark):
    long = "tell me about the park and the lake and the old town near it in the south"
    cases = {
        "What do you think of when it rains?": "reasoning", "what is why": "strict_factual", "Which " + "x " * 25: "reasoning", "when is it and why": "reasoning", "  Did he say so": "strict_factual",
        long: "reasoning", long + ", exactly": "strict_factual", "has " + long: "strict_factual", "short": "strict_factual", "": "strict_factual", None: "strict_factual", "他为什么在哪": "reasoning",
        "他在哪": "strict_factual", "what " + "y " * 19: "strict_factual", "what " + "y " * 20: "reasoning",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "q string").select("q", answers.answer_policy(F.col("q")).alias("p")).collect()
    assert {r.q: r.p for r in rows} == cases


def test_extracted_answers(spark):
    cases = [
        ("When?", "7 May 2023", None), ("When was it?", "on 07 may 2023", "7 May 2023"), ("When was it?", "7 Foo 2023", None), ("When was it?", "7 Foo 2023 or June 2024", None), ("When was it?", "a sunny June 2024", "June 2024"),
        ("when was it?", "Sunday before 3 Decem 1999", "The sunday before 3 December 1999"), ("when was it?", "sunday before 3 xyz 1999; the week before 4 jan 2000", "The week before 4 January 2000"),
        ("How long ago?", "10 years ago", "10 years"), ("How long ago?", "1 year", "1 years"), ("How long ago?", "ten years", None), ("Where is he?", "he is from Rome", "Rome"), ("Where is he?", "from rome", None),
        ("What did he research?", "He was researching an old-time   map it's big", "Old time map"), ("What did he research?", "researched birds\nand bees", "Birds"), ("What did he see?", "researched birds", None),
        ("Her identity?", "transgender ... Woman", "Transgender woman"), ("relationship status now", "He is SINGLE", "Single"), ("he realised self-care how", "self-care is nice", None),
        ("What came after the charity race?", "Self-care, how important", "self-care is important"), ("How does self-care go?", "carving out me-time, running, reading, violin", answers.CARE_WAY),
        ("How does self-care go?", "by carving out  her violin.", "by carving out the violin"), ("was it the Sunday before 05 JUNE 2021", None, "The sunday before 5 June 2021"), (None, "7 May 2023", None), (None, None, None),
    ]
    rows = spark.createDataFrame(cases, "q string, e string, want string").withColumn("got", answers.extract_answer(F.col("q"), F.col("e")))
    assert rows.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_tags(spark):
    cases = {"": "", "上海 and 北京": "北京,上海", "C罗, 红茶": "足球,喝茶", "茶": "喝茶", None: ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.array_join(answers.extra_tags(F.col("t")), ",").alias("tags")).collect()
    assert {r.t: r.tags for r in rows} == cases
