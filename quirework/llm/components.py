"""Connected components of a link table by minimum labels and pointer jumping, in joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. links: columns a and b; nodes without links are absent.

    Each round hands every node the smallest label among its neighbours and itself and then replaces that label by
    the label's own label, so paths shorten by half or better. The state of a round is a written table, deleted when the next one
    stands: a lost executor costs a round's work at most. Grouped minima combine before the shuffle, so a node with very many links is no hot spot.
    """
    both = written(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    old = state
    for _ in range(most_rounds):
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        told = state.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("label"))
        heads = state.select(F.col("node").alias("head"), F.col("component").alias("above"))
        after = written(told.join(heads, F.col("label") == F.col("head"), "left").select("node", F.least("label", "above").alias("component"), (F.least("label", "above") < F.col("component")).alias("moved")), "labels")
        discard(old)
        state, old = after.select("node", "component"), after
        if after.where("moved").isEmpty():
            discard(both)
            return state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
