"""Connected components of a link table, as a distributed contraction.

Each round hooks every class to the smallest class it is linked with, follows
these hooks to their ends, and rewrites the links between the classes that are
left; equal links and those inside a class go.  All tables are checkpointed, so the joins see
plain shuffles, which adaptive execution splits for a class with many links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def _one_way(links: DataFrame) -> DataFrame:
    return (links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .filter(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); component is its smallest node.

    Nodes are of any type that can be ordered; rows with a null are no links.
    """
    links = cut(_one_way(links.select("a", "b").dropna()))
    none = links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    members = None  # (node, component) of every node seen so far
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A class hooks to its smallest neighbour if that is smaller than itself.
        hooks = cut(both.groupBy("a").agg(F.min("b").alias("to"))
                    .select(F.col("a").alias("node"), F.least("a", "to").alias("to")))
        while True:  # pointer jumping
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            jumped = cut(hooks.join(up, "to").select("node", F.col("further").alias("to"), (F.col("to") != F.col("further")).alias("moved")))
            hooks = jumped.select("node", "to")
            if jumped.filter("moved").isEmpty():
                break
        if members is None:
            members = hooks.select("node", F.col("to").alias("component"))
        else:
            members = cut(members.join(hooks.withColumnRenamed("node", "component"), "component", "left")
                          .select("node", F.coalesce("to", "component").alias("component")))
        left = links.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("ca")), "a")
        left = cut(left.select("b", "ca"))
        left = left.join(hooks.select(F.col("node").alias("b"), F.col("to").alias("cb")), "b")
        links = cut(_one_way(left.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    return none if members is None else members


def with_component(rows: DataFrame, node: str, members: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of their node; a node without links is its own."""
    found: Column = F.coalesce(F.col("_component"), F.col(node))
    side = members.select(F.col("node").alias(node), F.col("component").alias("_component"))
    return rows.join(side, node, "left").withColumn(name, found).drop("_component")
