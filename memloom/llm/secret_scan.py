"""Secret scan with corpus-wide ownership frequency (operator 6), in DataFrame functions only.

Base spans come from three fixed patterns. The method adds candidates of a further kind, `key`: runs of
20 or more key characters that mix letters and digits. All candidate values are hashed and counted over
the corpus by distinct repositories (documents) and owners (sources): a value held by more than
`most_owners` owners, or by more than `most_repos` repositories, is a widely copied example; any other is
owner-specific and looks live.
Base spans stay whatever their owners; `key` candidates become spans only if they look live and touch
no base span.

Defined cases: null text: empty; a null source is an owner of its own; rows that repeat a doc_id are
scanned one by one; null doc_id: kept; empty table: empty result. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import row_key, stage, whole_row, with_text


@dataclass(frozen=True)
class SecretConfig:
    most_owners: int = 2
    most_repos: int = 25
    placeholder: str = "[SECRET]"


#: The patterns of the base spans. hex and access are written with their least length,
#: which finds the same spans, as a match there is a whole run of its characters.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KEY = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "key")


def _hits(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Array of (k, i, g, n, h): the i-th leftmost non-overlapping match, g code points after the one before it, n long, and the hash
    of its value, null where the match fails. Matches and the text between them alternate, so sums of g and n give the places."""
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hit

    def good(v: Column) -> Column:
        mixed = F.regexp_like(v, F.lit("[0-9]")) & F.regexp_like(v, F.lit("[A-Za-z]")) if kind == KINDS.index("key") else F.lit(True)
        return (F.length(v) >= least) & mixed

    pair = F.zip_with(hit, value, lambda h, v: F.struct(F.length(h).alias("n"), F.when(good(v), F.sha2(v, 256)).alias("h")))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hit)), lambda g: F.length(g))
    row = F.transform(F.arrays_zip(gaps.alias("g"), pair.alias("x")), lambda z, i: F.struct(F.lit(kind).alias("k"), i.alias("i"), z["g"].alias("g"), z["x"]["n"].alias("n"), z["x"]["h"].alias("h")))
    return F.when(F.regexp_like(text, F.lit(pattern)), row).otherwise(F.lit([]).cast("array<struct<k:int,i:int,g:int,n:int,h:string>>"))


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, its join key (id0, th), repo, owner, and hits: the matches of all four patterns. One row for each row of docs. repo is
    the document; one without an id is known by its text."""
    text = F.coalesce("text", F.lit(""))
    i = F.col("doc_id").cast("long")
    owner = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    hits = F.concat(_hits(text, 0, ASSIGN, 2, 12), _hits(text, 1, ACCESS, 0, 18), _hits(text, 2, HEX, 0, 16), _hits(text, 3, KEY, 0, 20))
    return docs.select(i.alias("doc_id"), *row_key(), F.xxhash64(i, F.when(i.isNull(), text)).alias("repo"), owner.alias("owner"), hits.alias("hits"))


def placed(found: DataFrame) -> DataFrame:
    """id0, th, repo, owner, s, k, e, h of the candidates: running sums give the places of matches, running extremes of base spans
    tell which `key` matches touch one. A text's matches are sorted once and walked, so the work grows with their number."""
    row = ["id0", "th", "owner"]
    each = found.where(F.size("hits") > 0).dropDuplicates(row).select(*row, "repo", F.inline("hits"))
    end = F.sum(F.col("g") + F.col("n")).over(Window.partitionBy(*row, "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    spans = each.withColumn("e", end.cast("int")).withColumn("s", F.col("e") - F.col("n")).where("h is not null")
    base = F.col("k") < 3
    up, down = (Window.partitionBy(*row).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("s", "k"), (F.desc("s"), F.desc("k"))))
    spans = spans.withColumn("reach", F.max(F.when(base, F.col("e"))).over(up)).withColumn("next", F.min(F.when(base, F.col("s"))).over(down))
    touch = F.coalesce(F.col("reach") > F.col("s"), F.lit(False)) | F.coalesce(F.col("next") < F.col("e"), F.lit(False))
    return spans.where(base | ~touch).select("id0", "th", "repo", "owner", "s", "k", "e", "h")


def ownership(spans: DataFrame) -> DataFrame:
    """h, owners, repos: how many distinct owners and documents hold each candidate value."""
    each = spans.select("repo", "owner", "h").distinct()
    return each.groupBy("h", "owner").agg(F.count("*").alias("repos")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def judged(docs: DataFrame, cfg: SecretConfig) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (doc_id, id0, th), and their spans (id0, th, s, k, e, live)."""
    found = stage(matches(docs), "matches")
    spans = stage(placed(found), "spans")
    flat = spans.select("id0", "th", "s", "k", "e", "h").distinct()
    live = (F.col("owners") <= cfg.most_owners) & (F.col("repos") <= cfg.most_repos)
    return found.select("doc_id", "id0", "th"), flat.join(ownership(spans), "h").withColumn("live", live).where("k < 3 or live").select("id0", "th", "s", "k", "e", "live")


def scan(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """doc_id, id0, th and all: the document's spans as array of (s, k, e, live), by start, then kind. One row
    for each row of docs."""
    rows, spans = judged(docs, cfg)
    per = spans.groupBy("id0", "th").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e", "live"))).alias("all"))
    none = F.lit([]).cast(per.schema["all"].dataType)
    return rows.join(per, ["id0", "th"], "left").select("doc_id", "id0", "th", F.coalesce("all", none).alias("all"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op6(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and by ownership, base spans included, n_live, n_copied and the spans
    of copied examples, copied_spans."""
    def count(k: int) -> Column:
        return F.size(F.filter("all", lambda x: x["k"] == k)).cast("long")
    return scan(docs, cfg).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("all", lambda x: x["k"] < 3)), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("all", lambda x: ~x["live"])).cast("long").alias("n_copied"),
        _joined(F.filter("all", lambda x: ~x["live"])).alias("copied_spans"),
    )


def redact(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """docs with every span, base or added, replaced by the placeholder (overlapping spans by one)."""
    by = Window.partitionBy("id0", "th").orderBy("s", "e")
    far = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = judged(docs, cfg)[1].withColumn("opens", F.coalesce(F.col("s") >= far, F.lit(True)).cast("int"))
    spans = spans.withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("id0", "th", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    hits = runs.groupBy("id0", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cut"))
    rows = docs.select(whole_row(docs).alias("row"), *row_key()).join(hits, ["id0", "th"], "left").withColumn("t", F.col("row.text"))
    before = F.transform("cut", lambda x, i: F.substring(F.col("t"), F.when(i == 0, 0).otherwise(F.get("cut", i - 1)["e"]) + 1, x["s"] - F.when(i == 0, 0).otherwise(F.get("cut", i - 1)["e"])))
    last = F.substring(F.col("t"), F.try_element_at("cut", F.lit(-1))["e"] + 1, F.length("t"))
    text = F.concat(F.array_join(before, cfg.placeholder), F.lit(cfg.placeholder), last)
    return with_text(rows, docs, "row", F.col("cut").isNotNull(), text)
