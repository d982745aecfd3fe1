"""Dates in text, normalised answers and their comparison, policies of questions, answers by pattern, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ISO = r"(\d{4})-(\d{2})-(\d{2})"
DAY_MONTH_YEAR = r"(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})"
MONTH_DAY_YEAR = r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
DAY = r"(\d{1,2})"
TEMPORAL = 2  # the category of questions about time
OPINION = ["what do you think", "what do you feel", "what do you make of"]
STRICT_STARTS = ["did ", "have you ", "has ", "was there ", "were there "]
STRICT_MARKERS = [
    "when", "what time", "what date", "which day", "how long", "duration", "where", "what location", "which place", "who", "what name", "which person", "how many", "how much", "what number",
    "哪天", "什么时候", "何时", "多久", "哪里", "什么地方", "在哪", "谁", "什么名字", "多少", "几个", "编号", "第几", "是否", "有没有", "发生过", "确切", "具体", "precisely", "exactly", "specifically",
]
REASONING_MARKERS = [
    "why", "how come", "analyze", "reason", "because", "motivation", "interpret", "meaning", "significance", "relationship", "connection",
    "为什么", "原因", "动机", "分析", "理解", "意义", "关系", "关联", "感受", "心情", "情绪", "如何看", "怎么想", "影响",
]
CITIES = ["深圳", "北京", "上海", "广州", "杭州", "成都", "重庆", "武汉", "西安", "南京", "苏州", "天津", "长沙", "郑州", "青岛", "厦门", "大连", "宁波", "合肥", "昆明", "福州", "济南", "沈阳", "哈尔滨"]
TOPICS = {"足球": ["足球", "中超", "英超", "西甲", "欧冠", "世界杯", "梅西", "C罗", "国足"], "喝茶": ["茶", "绿茶", "红茶", "乌龙", "普洱", "茶叶", "泡茶"]}
CARE = "self-care is important"
CARE_PARTS = ["carving out", "me-time", "running", "reading", "violin"]
CARE_WAY = "by carving out some me-time each day for activities like running, reading, or playing the violin"
QUESTION_MARKS = ["？", "吗", "呢", "是否", "是不是", "谁", "什么", "哪里", "怎么", "为什么", "多少", "认识", "知道", "记得"]


def iso_date(text: Column) -> Column:
    """The first date in a text as YYYY-MM-DD: of the form YYYY-MM-DD, else D Month YYYY, else Month D, YYYY; null if there is none or its month is no month.
    A day is not checked against its month."""
    grab = lambda pattern, g: F.regexp_extract(text, pattern, g)
    number = lambda name: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name))

    def told(pattern: str, day: int, name: int) -> Column:
        n = number(grab(pattern, name))
        return F.when((grab(pattern, day) != "") & (n > 0), F.concat_ws("-", F.lpad(grab(pattern, 3), 4, "0"), F.lpad(n.cast("string"), 2, "0"), F.lpad(grab(pattern, day), 2, "0")))

    return F.coalesce(F.nullif(F.regexp_extract(text, ISO, 0), F.lit("")), told(DAY_MONTH_YEAR, 1, 2), told(MONTH_DAY_YEAR, 2, 1))


def normalised(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", " "))


def exact_match(reference: Column, prediction: Column, category: Column) -> Column:
    """Equal dates, for questions about time where both texts hold one; else equal normalised texts that aren't empty."""
    a, b = iso_date(reference), iso_date(prediction)
    n = normalised(reference)
    return F.when((F.coalesce(category, F.lit(0)) == TEMPORAL) & a.isNotNull() & b.isNotNull(), a == b).otherwise((n != "") & (n == normalised(prediction)))


def is_question(text: Column) -> Column:
    """Whether a text holds a mark of a question or ends in one."""
    any_mark = F.lit(False)
    for m in QUESTION_MARKS:
        any_mark |= F.contains(text, F.lit(m))
    return any_mark | F.endswith(F.trim(text), F.lit("?"))


def minutes(hhmm: Column) -> Column:
    """HH:MM as minutes from midnight; null where it is none."""
    h, m = (F.regexp_extract(hhmm, r"^([01]?\d|2[0-3]):([0-5]\d)$", g) for g in (1, 2))
    return F.when(h != "", h.cast("int") * 60 + m.cast("int"))


def has_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found |= F.contains(text, F.lit(w))
    return found


def _bare(text: Column) -> Column:
    """Without white space at its ends; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def answer_policy(question: Column) -> Column:
    """strict_factual or reasoning. In this order: an opinion is asked for; a short question begins with what or which; a word asks for reasons; a yes-or-no opening or a
    word asks for a fact; else questions under 15 words are factual."""
    q = F.lower(_bare(question))
    words = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    opens = lambda starts: F.regexp_like(q, F.lit("^(" + "|".join(starts) + ")"))
    why, fact = F.lit("reasoning"), F.lit("strict_factual")
    return (
        F.when(has_any(q, OPINION), why).when(opens(["what ", "which "]) & (words <= 20), fact).when(has_any(q, REASONING_MARKERS), why)
        .when(opens(STRICT_STARTS) | has_any(q, STRICT_MARKERS) | (words < 15), fact).otherwise(why)
    )


def extra_tags(text: Column) -> Column:
    """The cities a text names, then the topics of which it holds a word; each once, in the order of the lists."""
    tags = [F.when(F.contains(text, F.lit(c)), F.lit(c)) for c in CITIES] + [F.when(has_any(text, words), F.lit(t)) for t, words in TOPICS.items()]
    return F.array_compact(F.array(*tags))


def extract_answer(question: Column, evidence: Column) -> Column:
    """The answer that a pattern for this kind of question finds in the evidence; null if none does. The first pattern of those below that gives something counts; a date
    whose month is no month gives nothing."""
    q, e = F.lower(_bare(question)), F.coalesce(evidence, F.lit(""))
    low = F.lower(e)
    short = F.create_map(*[x for m in MONTHS for x in (F.lit(m[:3]), F.lit(m.capitalize()))])
    number = lambda digits: F.regexp_replace(digits, r"^0+(?=\d)", "")
    has = lambda text, *words: F.lit(True) if not words else F.contains(text, F.lit(words[0])) & has(text, *words[1:])

    def asked(start: str) -> Column:
        return F.startswith(q, F.lit(start))

    def dated(text: Column, pattern: str, lead: Column, first: int) -> Column:
        """lead, then day (if the pattern has one), month and year, whose groups begin at `first`."""
        parts = [F.regexp_extract(text, pattern, g) for g in range(first, first + 2 + pattern.count(DAY))]
        month = F.try_element_at(short, F.lower(F.left(parts[-2], F.lit(3))))
        rest = [number(parts[0])] if len(parts) == 3 else []
        return F.when((parts[-1] != "") & month.isNotNull(), F.concat(lead, F.concat_ws(" ", *rest, month, number(parts[-1]))))

    def piece(text: Column, pattern: str, group: int) -> Column:
        return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))

    no = F.lit("")
    weekday = rf"(?U)\b(?:the\s+)?(sunday|monday|tuesday|wednesday|thursday|friday|saturday)\s+before\s+{DAY}\s+([a-z]+)\s+(\d{{4}})\b"
    when = F.coalesce(
        dated(low, weekday, F.concat(F.lit("The "), F.regexp_extract(low, weekday, 1), F.lit(" before ")), 2),
        dated(low, rf"(?U)\bthe\s+week\s+before\s+{DAY}\s+([a-z]+)\s+(\d{{4}})\b", F.lit("The week before "), 1),
        dated(e, rf"(?U)\b{DAY}\s+([A-Za-z]+)\s+(\d{{4}})\b", no, 1),
        dated(e, r"(?U)\b([A-Za-z]+)\s+(\d{4})\b", no, 1),
    )
    topic = _bare(F.regexp_replace(_bare(piece(low, r"(?Ud)\bresearch(?:ed|ing)\s+(.+?)(?:\s+it'?s\b|[.\n;]|$)", 1)), r"(?U)^(?:the|a|an)\s+", ""))
    topic = _bare(F.regexp_replace(F.translate(topic, "—-", "  "), r"(?U)\s+", " "))
    topic = F.when(F.regexp_like(low, F.lit(r"(?Ud)\bresearch(?:ed|ing)\s+(.+?)(?:\s+it'?s\b|[.\n;]|$)")), F.concat(F.upper(F.left(topic, F.lit(1))), F.substring(topic, 2, 1 << 30)))
    felt = F.replace(F.trim(F.regexp_extract(low, r"(?U)\bself-care\s+is\s+([a-z ]{1,40})\b", 1)), F.lit("really "), no)
    way = piece(low, r"(?Ud)\bby\s+carving\s+out[^.\n;]+", 0)
    way = F.when(way.isNotNull(), F.regexp_replace(F.replace(_bare(way), F.lit("her violin"), F.lit("the violin")), r"(?U)\s+", " "))
    return F.coalesce(
        F.when(has(q, "sunday before"), dated(F.coalesce(question, no), rf"(?Ui)\bsunday\s+before\s+{DAY}\s+([A-Za-z]+)\s+(\d{{4}})\b", F.lit("The sunday before "), 1)),
        F.when(asked("when "), when),
        F.when(asked("how long "), F.concat(number(piece(low, r"(?U)\b(\d+)\s+years?\b", 1)), F.lit(" years"))),
        F.when(asked("where "), piece(e, r"(?U)\bfrom\s+([A-Z][A-Za-z]+)\b", 1)),
        F.when(asked("what did ") & has(q, "research"), topic),
        F.when(has(q, "identity") & (has(low, "transgender", "woman") | has(low, "trans woman")), "Transgender woman"),
        F.when(has(q, "relationship status") & has(low, "single"), "Single"),
        F.when(has(q, "self-care") & has_any(q, ["realize", "realised"]) & has(felt, "important"), CARE),
        F.when(has(q, "after the charity race") & has(low, "self-care", "important"), CARE),
        F.when(asked("how does ") & has(q, "self-care"), F.when(has(low, *CARE_PARTS), CARE_WAY).otherwise(way)),
    )
