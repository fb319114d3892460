"""Connected components of a link table by label hooking and pointer jumping, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """links: (a, b).  Returns a staged (node, root): root is the smallest node of the component.

    A step takes for every node the least label next to it, then the label of its label; steps stop when nothing
    changes, after a number that grows with the logarithm of a component's diameter on stars and chains.  Labels of a
    step are written to the shared folder, and those of the step before are deleted.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    edges = staged(both, "links")
    labels = staged(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        beside = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("least"))
        hooked = labels.join(beside, labels.node == beside.a).select("node", "root", F.least("root", "least").alias("low"))
        up = labels.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        jumped = hooked.join(up, hooked.low == up._n, "left").select("node", F.least("low", F.coalesce("_up", "low")).alias("root"), (F.col("root") != F.least("low", F.coalesce("_up", "low"))).alias("moved"))
        step = staged(jumped, "labels")
        done = step.filter("moved").isEmpty()
        dropped(labels)
        labels = step.select("node", "root")
        labels._staged_path = step._staged_path
        if done:
            dropped(edges)
            return labels


def extended(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, root) of earlier links, joined by further links (a, b): a staged (node, root) of them all.

    Only the graph of the earlier roots is labelled anew, so what later links cost follows their own number.
    """
    at_a = comp.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
    at_b = comp.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
    lifted = links.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b"))
    step = components(lifted)
    above = step.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
    old = comp.join(above, comp.root == above._n, "left").select("node", F.coalesce("_up", "root").alias("root"))
    out = staged(old.unionByName(step.join(comp, "node", "left_anti").select("node", "root")), "labels")
    dropped(comp)
    dropped(step)
    return out
