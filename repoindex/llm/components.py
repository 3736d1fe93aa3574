"""Connected components of a table of links, by repeated joins; no neighbourhood is ever collected."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoindex.llm.batches import staged


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots: root is the smallest node of its component.

    In turn every node is linked to the smallest of its neighbours, first from its larger, then from its smaller ones,
    until nothing changes: then all nodes of a component point to its smallest. A node of very many links is a hot
    join key, which adaptive execution splits; minima are combined before the shuffle. Each turn is staged in the
    shared folder. Links to itself are no links; no links give an empty table.
    """
    pairs = staged(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    before = None
    while True:
        pairs = staged(_to_smallest(_to_smallest(pairs, larger=True), larger=False), "links")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def _to_smallest(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link a node's larger neighbours, or itself and its smaller ones, to the smallest of them all."""
    if larger:
        around = pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).union(
            pairs.select(F.col("b").alias("v"), F.col("a").alias("u")))
        smallest = around.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("m"))
        moved = around.where("u > v").join(smallest, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    else:
        smallest = pairs.groupBy("a").agg(F.min("b").alias("m"))
        joined = pairs.join(smallest, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(
            smallest.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()
