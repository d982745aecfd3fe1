"""Bounded walks over a property graph from every node at once. Work grows with the edges, not with the square of a node's edges.

Joins of tables that grow ask for a merge: by the size of their compressed files Spark would broadcast them through the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.sources.session import discard, release, staged


def first(rows: DataFrame, by: list[str], order: list, most: int, name: str = "rn") -> DataFrame:
    """The first `most` rows of each group; Spark keeps as many a task before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def undirected(edges: DataFrame, least: float) -> DataFrame:
    """node, via, w: the best edge between two different nodes, from both ends; only weights above `least`. A pair is shuffled once, not once an end."""
    kept = edges.where((F.col("w") > least) & (F.col("src") != F.col("dst")))
    pairs = kept.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))
    end = lambda n, v: F.struct(F.col(n).alias("node"), F.col(v).alias("via"))
    return pairs.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e"), "w").select("e.node", "e.via", "w")


HEAD = 4  # places of a list that every neighbour is shown at once


def within(rows: DataFrame) -> DataFrame:
    """The rows (target, w) that are not behind their node's bar (_bar, _last), if it has one: a weight of nine places and of equals the smaller target."""
    w = F.round("w", 9)
    return rows.where(F.col("_bar").isNull() | (w > F.col("_bar")) | ((w == F.col("_bar")) & (F.col("target") <= F.col("_last")))).drop("_bar", "_last")


LISTS = ("targets", "ws", "hs")


def listed(rows: DataFrame) -> DataFrame:
    """node, targets, ws, hs: the rows (node, target, w, hops, at) as one row a node, in the order of `at`; shuffled so, the node and its sort key are told once."""
    lists = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "target", "w", "hops"))).alias("l"))
    return lists.select("node", F.col("l.target").alias("targets"), F.col("l.w").alias("ws"), F.col("l.hops").alias("hs"))


def best_neighbours(edges: DataFrame, depth: int, least: float, most: int = 50, spare: int = 14) -> DataFrame:
    """node, target, w, hops, rn: for every node its `most` best other nodes within `depth` edges in any direction, by the product of weights
    (above `least`; of equals the smaller target), and the hops of the best path.

    edges: src, dst, w with weights of at most 1, so that a best path uses no edge twice. Each round joins the edges with the best lists
    of their far ends. A node that is among the best of v through u is among the best of u, but for v itself, so lists of `most` and one
    more are enough; `spare` more absorb ties that rounding makes. Of each list the first places come first; the last of what a node then has is a
    bar, and of the rest only what is not behind it is made and shuffled. Rounds are staged tables; what no later round reads is deleted,
    so the disk in use is that of a step and not of all."""
    keep, order, spark = most + 1 + spare, [F.desc(F.round("w", 9)), "target"], edges.sparkSession
    links = staged(undirected(edges, least), "links")
    release(spark)
    best = staged(listed(first(links.select("node", F.col("via").alias("target"), "w", F.lit(1).alias("hops")), ["node"], order, keep, "at")), "hop1")
    release(spark)

    def barred(lists: DataFrame) -> DataFrame:
        """The links with their node's bar; as no path is heavier than its first edge, those behind the bar lead nowhere."""
        bars = lists.where(F.size("targets") == keep).select("node", F.round(F.element_at("ws", keep), 9).alias("_bar"), F.element_at("targets", keep).alias("_last"))
        out = links.join(bars.hint("merge"), "node", "left")
        return out.where(F.col("_bar").isNull() | (F.round("w", 9) >= F.col("_bar")))

    def longer(some: DataFrame, lists: DataFrame, start: int, length: int) -> DataFrame:
        """The paths over the links to `length` places of the far ends' lists."""
        part = lists.where(F.size("targets") >= start).select(F.col("node").alias("via"), *[F.slice(c, start, length).alias(c) for c in LISTS])
        rows = some.join(part.hint("merge"), "via").where(F.col("_bar").isNull() | (F.col("w") * F.col("ws")[0] > F.col("_bar") - 1e-8))
        rows = rows.select("node", F.col("w").alias("_w"), "_bar", "_last", F.inline(F.arrays_zip(*LISTS)).alias("target", "w", "hops"))
        rows = rows.where(F.col("target") != F.col("node")).withColumn("w", F.col("_w") * F.col("w")).where(F.col("w") > least)
        return within(rows.select("node", "target", "w", (F.col("hops") + 1).alias("hops"), "_bar", "_last"))

    def top(lists: DataFrame, more: DataFrame) -> DataFrame:
        # lists and paths go by node in one shuffle: the sums by target and the ranks need none of their own
        dealt = lists.unionByName(more, allowMissingColumns=True).repartition("node")
        rows = dealt.select("node", "target", "w", "hops", F.inline_outer(F.arrays_zip(*LISTS)).alias("_t", "_w", "_h"))
        rows = rows.select("node", F.coalesce("target", "_t").alias("target"), F.coalesce("w", "_w").alias("w"), F.coalesce("hops", "_h").alias("hops"))
        each = rows.groupBy("node", "target").agg(F.max(F.struct("w", (-F.col("hops")).alias("h"))).alias("b"))
        return listed(first(each.select("node", "target", "b.w", (-F.col("b.h")).alias("hops")), ["node"], order, keep, "at"))

    if depth > 1:  # bars only rise, so a link behind its node's first bar is never needed again
        every, links = links, staged(barred(best).drop("_bar", "_last"), "open_links")
        discard(every)
    for d in range(2, depth + 1):
        near = staged(top(best, longer(barred(best), best, 1, HEAD)), f"near{d}")
        release(spark)
        last, best = best, staged(top(near, longer(barred(near), best, HEAD + 1, keep)), f"hop{d}")
        discard(last, near)
    discard(links)
    return best.select("node", F.posexplode(F.arrays_zip(*LISTS)).alias("at", "x")).where(F.col("at") < most).select("node", "x.targets", "x.ws", "x.hs", F.col("at") + 1).toDF("node", "target", "w", "hops", "rn")


def best_walks(edges: DataFrame, hops: int, most: int) -> list[DataFrame]:
    """For 1 .. `hops` edges, the walks from each node along edges (src, dst, rel, weight, dst_name) that use no edge twice: node, nodes, names, rels, weight.

    One edge: all. More: the best 2 * most of each node by the product of weights, then by the nodes and relations passed. The second half is
    there because a walk of the rest may have to be left out when an edge before it is the same (at most one for each relation between two nodes)."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to"), F.col("dst_name").alias("_name"), F.col("rel").alias("_rel"), F.col("weight").alias("_w"))
    out = [step.select("node", F.array("_to").alias("nodes"), F.array("_name").alias("names"), F.array("_rel").alias("rels"), F.col("_w").alias("weight"))]
    order = [F.desc(F.round("weight", 9)), "nodes", "rels"]
    rest = out[0]
    for h in range(2, hops + 1):
        tail = staged(first(rest, ["node"], order, 2 * most).drop("rn"), f"walk{h - 1}")
        if h > 2:
            out[-1] = tail
        tail = tail.withColumnRenamed("node", "_to")
        again = (F.col("node") == F.col("_to")) & (F.col("nodes")[0] == F.col("_to")) & (F.col("rels")[0] == F.col("_rel"))
        if h > 2:
            again |= (F.col("nodes")[0] == F.col("node")) & (F.col("nodes")[1] == F.col("_to")) & (F.col("rels")[1] == F.col("_rel"))
        head = lambda a, b: F.concat(F.array(a), b).alias(b)
        rest = step.join(tail.hint("merge"), "_to").where(~again).select("node", head("_to", "nodes"), head("_name", "names"), head("_rel", "rels"), (F.col("_w") * F.col("weight")).alias("weight"))
        out.append(rest)
    return out


FEW = 100_000  # nodes that may go through the driver; they are counted first


def around(edges: DataFrame, asked: DataFrame, steps: int) -> DataFrame | None:
    """node: the asked nodes and those within `steps` edges from them, src to dst; None if they are more than FEW. Each step reads the edges once and shuffles only those that leave the nodes it has."""
    near = staged(asked.select("node").distinct(), "around0")
    for step in range(1, steps + 1):
        if near.count() > FEW:
            return None
        more = edges.join(F.broadcast(near.select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node"))
        near = staged(near.union(more.where("node IS NOT NULL").distinct()).distinct(), f"around{step}")
    return near if near.count() <= FEW else None


def on_walks(edges: DataFrame, asked: DataFrame, hops: int, seen: Callable[[str], Column]) -> DataFrame | None:
    """src, dst, rel, weight: all edges that walks of `hops` edges from or to the asked nodes use (and perhaps others, some twice); None if these nodes are many."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = [around(rows.where(seen("dst")), asked, hops - 1) for rows in (edges, back)]
    if None in ways:
        return None
    some = [edges.join(F.broadcast(near.select(F.col("node").alias(c))), c, "left_semi").select("src", "dst", "rel", "weight") for c, near in zip(("src", "dst"), ways, strict=True)]
    return some[0].unionByName(some[1])


def entity_facts(edges: DataFrame, names: DataFrame, caps: tuple[int, ...] = (15, 10), hidden: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """node, block, hop, entity, relation, target, weight: the facts about every node, or every `asked` (node). Blocks in order: edges out, edges in, the best walks
    of two edges out (`caps[0]`), in, of three out (`caps[1]`), in, ...

    edges: src, dst, rel, weight; names: node, name. Nodes whose id starts with `hidden` are on no walk, but may be asked about. If few nodes are asked about,
    only the edges that can lie on their walks are named and walked."""
    seen = (lambda c: ~F.col(c).startswith(hidden)) if hidden else (lambda c: F.lit(True))
    some = None if asked is None else on_walks(edges, asked, len(caps) + 1, seen)
    edges = (edges if some is None else some).groupBy("src", "dst", "rel").agg(F.max(F.coalesce("weight", F.lit(0.5))).alias("weight"))
    if some is not None:
        edges = staged(edges, "walked_edges")
        nodes = staged(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "walked_nodes")
        if nodes.count() <= FEW:
            names = staged(names.join(F.broadcast(nodes), "node", "left_semi"), "walked_names")
    of = lambda c: names.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name"))
    edges = edges.join(of("src").hint("merge"), "src", "left").join(of("dst").hint("merge"), "dst", "left").withColumn("src_name", F.coalesce("src_name", "src")).withColumn("dst_name", F.coalesce("dst_name", "dst"))
    edges = staged(edges, "named_edges")
    title = edges.select(F.col("src").alias("node"), F.col("src_name").alias("title")).union(edges.select("dst", "dst_name")).distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "weight", F.col("src_name").alias("dst_name"))
    facts = []
    for way, rows in enumerate((edges.select("src", "dst", "rel", "weight", "dst_name"), back)):
        # the node that is asked about may be hidden, the nodes passed may not
        walks = best_walks(rows.where(seen("dst")), len(caps) + 1, max(caps))
        for h, walk in enumerate(walks, start=1):
            if asked is not None:
                walk = walk.join(asked.select("node").distinct().hint("merge"), "node", "left_semi")
            if h > 1:
                walk = first(walk, ["node"], [F.desc(F.round("weight", 9)), "nodes", "rels"], caps[h - 2]).drop("rn")
            walk = walk.join(title.hint("merge"), "node")
            far = F.element_at("names", -1)
            names_on, rels = (F.slice("names", F.lit(1), F.lit(h - 1)), F.col("rels")) if way == 0 else (F.reverse(F.slice("names", F.lit(1), F.lit(h - 1))), F.reverse("rels"))
            relation = F.concat(F.array(F.lit(None).cast("string")), names_on)  # a name before each relation but the first
            relation = F.concat_ws(" -> ", F.flatten(F.zip_with(relation, rels, lambda a, r: F.array(a, r))))
            entity, target = (F.col("title"), far) if way == 0 else (far, F.col("title"))
            facts.append(walk.select("node", F.lit(2 * (h - 1) + way).alias("block"), F.lit(h).alias("hop"), entity.alias("entity"), relation.alias("relation"), target.alias("target"), "weight"))
    out = facts[0]
    for more in facts[1:]:
        out = out.unionByName(more)
    return out


def roots_of(queries: DataFrame, matched: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """query, node, at: the first `most` entities (by id) whose name matches a query.

    matched: query, name; names: node, name. Only the first `most` ids of a name can be among the first of a query, so a frequent name stays small."""
    few = first(names, ["name"], ["node"], most).drop("rn")
    return first(queries.join(matched.hint("merge"), "query").join(few.hint("merge"), "name"), ["query"], ["node"], most, "at").select("query", "node", "at")


def facts_at(roots: DataFrame, facts: DataFrame) -> DataFrame:
    """query, hop, entity, relation, target, weight: the facts of the roots (query, node, at) of each query; of facts with equal entity, relation and target the first counts."""
    rows = roots.join(facts.hint("merge"), "node")
    return first(rows, ["query", "entity", "relation", "target"], ["at", "block", F.desc("weight")], 1).select("query", "hop", "entity", "relation", "target", "weight")


def facts_of(queries: DataFrame, matched: DataFrame, names: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """facts_at of roots_of."""
    return facts_at(roots_of(queries, matched, names, most), facts)
