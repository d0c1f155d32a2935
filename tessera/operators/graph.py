"""Concept graphs as tables of nodes (id, kind, label) and edges (src, dst, kind, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as c
from tessera.storage import stored

#: Members of a group whose pairs are made in one block.
BLOCK = 1000
#: Pairs that a task makes and counts, and into how many parts a task's groups are dealt so that tasks come out even.
TASK_PAIRS, DEALT = 500_000, 64


def hierarchy(levels: list[tuple[DataFrame, str, str, str | None, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and contains edges of levels (table, kind, id column, parent column or None, label column), from the top down."""
    nodes = edges = None
    above = ""
    for df, kind, key, parent, label in levels:
        node = df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label")).distinct()
        nodes = node if nodes is None else nodes.unionByName(node)
        if parent:
            edge = df.select(F.concat(F.lit(f"{above}:"), F.col(parent).cast("string")).alias("src"), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight")).distinct()
            edges = edge if edges is None else edges.unionByName(edge)
        above = kind
    return nodes, edges


def _pairs_within(m: DataFrame, group: str, item: str) -> DataFrame:
    """__k, group, a and b: a group's pairs a < b from the array of its items."""
    held = m.groupBy("__k", group).agg(F.array_sort(F.collect_set(item)).alias("__s"))
    pair = F.flatten(F.transform("__s", lambda x, i: F.transform(F.slice("__s", i + 2, F.size("__s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return held.select("__k", group, F.inline(pair))


def _pairs_by_blocks(m: DataFrame, sizes: DataFrame, group: str, item: str) -> DataFrame:
    """The same of large groups, block by block: each pair of blocks is a key of its own."""
    m = m.select(group, item).distinct()
    dealt = m.join(sizes.select(group, F.ceil(F.col("n") / BLOCK).cast("int").alias("__n")), group).withColumn("__own", F.pmod(F.xxhash64(item), F.col("__n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    left = dealt.select(group, F.col(item).alias("a"), F.col("__own").alias("__i"), every.alias("__j"))
    right = dealt.select(group, F.col(item).alias("b"), F.col("__own").alias("__j"), every.alias("__i"))
    pairs = left.join(right, [group, "__i", "__j"]).where("a < b")
    return pairs.select(F.pmod(F.xxhash64(group, "__i", "__j"), F.lit(DEALT)).alias("__k"), group, "a", "b")


def cooccurrence(members: DataFrame, group: str, item: str, least: int = 2, sources: int = 0) -> DataFrame:
    """Pairs a < b of items that share groups: weight (how many) and, if asked for, so many first groups of each.

    Tasks grow in number with the pairs there are, not in size: each makes some TASK_PAIRS and counts them, by __k, before
    they are dealt by pair.
    """
    m = members.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull())
    sizes = stored(m.groupBy(group).agg(F.count("*").alias("n")))
    made, large = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum((F.col("n") > BLOCK).cast("int"))).first()
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, -(-int(made or 0) // TASK_PAIRS))
    small, by_blocks = m, None
    if large:
        wide = stored(sizes.where(F.col("n") > BLOCK))
        small = m.join(wide, group, "left_anti")
        by_blocks = _pairs_by_blocks(m.join(wide, group, "left_semi"), wide, group, item)
    pairs = _pairs_within(small.withColumn("__k", F.pmod(F.xxhash64(group), F.lit(DEALT * tasks))).repartition(tasks, "__k"), group, item)
    count = lambda df: df.groupBy("__k", "a", "b").agg(F.count("*").alias("n")).select("a", "b", "n")
    parts = count(pairs) if by_blocks is None else count(pairs).union(count(by_blocks))
    out = parts.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("weight")).where(F.col("weight") >= least)
    if not sources:
        return out
    # A window with a limit keeps no more than so many of a pair's groups at a time.
    every = pairs if by_blocks is None else pairs.unionByName(by_blocks)
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy(group))).where(F.col("n") <= sources)
    return out.join(first.groupBy("a", "b").agg(F.array_sort(F.collect_list(group)).alias("groups")), ["a", "b"])


def merged_edges(edges: DataFrame, all_sources: bool = False) -> DataFrame:
    """Edges with the same ends and kind as one: weights add up; the first source stays, or all distinct ones do."""
    kept = [F.array_sort(F.collect_set("source")).alias("sources")] if all_sources else []
    return edges.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"), F.count("*").alias("merged"), F.min("source").alias("first_source"), *kept)


def merged_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """Nodes (id, kind, label, attrs: a map, and an order column) with the same id as one: the first kind, the first label that is not empty, and of each attribute the last value."""
    pairs = nodes.select("id", order, F.explode("attrs").alias("key", "value")).groupBy("id", "key").agg(F.max_by("value", order).alias("value"))
    attrs = pairs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    named = F.min_by("label", F.when(F.coalesce("label", F.lit("")) != "", F.col(order)))
    return nodes.groupBy("id").agg(F.min_by("kind", order).alias("kind"), F.coalesce(named, F.lit("")).alias("label")).join(attrs, "id", "left")


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind)


def subgraph(nodes: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a kind and the edges between them."""
    own = of_kind(nodes, kind)
    ends = lambda df, side: df.join(own.select(F.col("id").alias(side)), side, "left_semi")
    return own, ends(ends(edges, "src"), "dst")


def ego(edges: DataFrame, node: str, most: int = 50) -> DataFrame:
    """The edges of one node, the heaviest first: neighbour, kind, weight and direction."""
    near = edges.where((F.col("src") == node) | (F.col("dst") == node))
    out = near.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("neighbour"), "kind", "weight", F.when(F.col("src") == node, "out").otherwise("in").alias("direction"))
    return out.orderBy(F.desc("weight"), "neighbour", "kind").limit(most)


def related_of_resources(provenance: DataFrame, related: DataFrame, concepts: int = 12, neighbours_: int = 5) -> DataFrame:
    """resource, concept, related and weight: of each resource's first concepts the heaviest related concepts. provenance: resource, concept; related: src, dst, weight."""
    first = provenance.withColumn("n", F.row_number().over(Window.partitionBy("resource").orderBy("concept"))).where(F.col("n") <= concepts).select("resource", "concept")
    near = both_ways(related.withColumn("kind", F.lit("related_to"))).select(F.col("src").alias("concept"), F.col("dst").alias("related"), "weight")
    place = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("weight"), "related"))
    best = near.withColumn("n", place).where(F.col("n") <= neighbours_).drop("n")
    return first.join(best, "concept").select("resource", "concept", "related", "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "kind", "weight").union(edges.select(F.col("dst"), F.col("src"), "kind", "weight"))


def neighbours(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, direction: str = "both") -> DataFrame:
    """node and neighbour, over edges of the kinds, out, in or both."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    e = {"out": lambda: e, "in": lambda: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "weight"), "both": lambda: both_ways(e)}[direction]()
    return nodes.select(F.col("id").alias("src")).join(e, "src").select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "kind", "weight").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density and mean degree."""
    n, m = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    both = n.join(m, F.lit(True))  # one row each
    return both.select("nodes", "edges", F.round(F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0), 9).alias("density"), F.round(F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0), 6).alias("mean_degree"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) over edges taken both ways: least labels spread, and jump along themselves, until none changes."""
    pairs = stored(both_ways(edges).select("src", "dst").where("src != dst").distinct())
    labels = stored(pairs.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        seen = pairs.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        met = labels.join(seen, labels["node"] == seen["src"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = met.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = stored(met.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        changed = not new.where("label != next").isEmpty()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def edge_weight(kind: str = "kind") -> F.Column:
    out = F.lit(c.OTHER_EDGE)
    for name, weight in c.EDGE_WEIGHTS.items():
        out = F.when(F.col(kind) == name, weight).otherwise(out)
    return out


def expanded(seeds: DataFrame, edges: DataFrame, hops: int = c.MAX_HOPS, decay: float = c.DECAY, beam: int = c.BEAM, most: int = c.MAX_EXPANDED) -> DataFrame:
    """query, node, score, hop, path and relationship (the kind of its last edge; seed) of what seeds (query, node, score) reach.

    A hop gives a neighbour the best of score * decay * edge weight over the frontier before it; only nodes that it betters
    join the next frontier, of which the best go on. Ties are broken by node and by path.
    """
    moves = both_ways(edges).select(F.col("src").alias("node"), F.col("dst").alias("to"), (edge_weight() * decay).alias("factor"), "kind")
    moves = moves.groupBy("node", "to").agg(F.max(F.struct("factor", "kind")).alias("m")).select("node", "to", "m.factor", F.col("m.kind").alias("relationship"))
    known = seeds.groupBy("query", "node").agg(F.max("score").alias("score")).withColumns({"hop": F.lit(0), "path": F.array("node"), "relationship": F.lit("seed")})
    frontier = known
    best = lambda by: Window.partitionBy("query", *by).orderBy(F.round("score", 9).desc(), *([] if by else ["node"]), F.array_join("path", "/"))
    for hop in range(1, hops + 1):
        front = frontier.withColumn("n", F.row_number().over(best([]))).where(F.col("n") <= beam)
        reached = front.drop("relationship").join(moves, "node").select("query", F.col("to").alias("node"), (F.col("score") * F.col("factor")).alias("score"), F.lit(hop).alias("hop"), F.concat("path", F.array("to")).alias("path"), "relationship")
        reached = reached.withColumn("n", F.row_number().over(best(["node"]))).where("n = 1").drop("n")
        had = known.select("query", "node", F.col("score").alias("had"))
        frontier = stored(reached.join(had, ["query", "node"], "left").where("had IS NULL OR score > had").drop("had"))
        known = stored(known.join(frontier.select("query", "node"), ["query", "node"], "left_anti").unionByName(frontier))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "node"))
    return known.withColumn("place", place).where(F.col("place") <= most)


def prerequisites(modules: DataFrame, group: str, order: list[str], item: str) -> DataFrame:
    """Each item of a group and the next one in order: prerequisite edges, and depends_on edges back."""
    follows = F.lead(item).over(Window.partitionBy(group).orderBy(*order))
    pairs = modules.withColumn("dst", follows).where("dst IS NOT NULL").select(F.col(item).alias("src"), "dst")
    return pairs.withColumn("kind", F.lit("prerequisite")).union(pairs.select("dst", "src", F.lit("depends_on")))
