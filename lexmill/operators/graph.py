"""PageRank in its unnormalised form: PR = 0.15 + 0.85 * sum(PR(src) / outdegree(src)), from 1.0, no dangling shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.lineage import cut


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("n"))


def pagerank(edges: DataFrame, iterations: int, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(id, pr).  Multi-edges are summed into weights first, so an iteration moves one row per distinct edge.

    Edges are dealt by source once and written to the checkpoint folder; every ``cut_every`` steps the ranks are too,
    so plans stay short and a lost executor costs a few steps only.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    weighted = pairs.join(pairs.groupBy("src").agg(F.sum("m").alias("out")), "src").select("src", "dst", (F.col("m") / F.col("out")).alias("w"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if iterations == 0:
        return nodes.select("id", F.lit(0.0).alias("pr"))
    weighted, nodes = cut(weighted), cut(nodes)
    ranks = nodes.select("id", F.lit(1.0).alias("pr"))
    for step in range(1, iterations + 1):
        flow = weighted.join(ranks, weighted.src == ranks.id).groupBy("dst").agg(F.sum(F.col("pr") * F.col("w")).alias("flow"))
        ranks = nodes.join(flow, nodes.id == flow.dst, "left").select("id", (F.lit(1 - damping) + F.lit(damping) * F.coalesce("flow", F.lit(0.0))).alias("pr"))
        if step % cut_every == 0 and step < iterations:
            ranks = cut(ranks)
    return ranks


def ranked(ranks: DataFrame) -> DataFrame:
    return ranks.orderBy(F.desc("pr"), F.asc("id"))


def combine(scored: DataFrame, ranks: DataFrame, weight: float, k: int | None, key: str = "doc_id") -> DataFrame:
    """score + weight * pr by id; a document that is no node of the graph gets 0 for its rank."""
    from lexmill.operators.ranking import top

    both = scored.join(ranks, scored[key] == ranks.id, "left")
    return top(both.select(key, (F.col("score") + F.lit(float(weight)) * F.coalesce("pr", F.lit(0.0))).alias("score")), k, key)
