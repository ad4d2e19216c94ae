"""Greedy keep-best selection within a radius, in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import measured


def keep_best(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that a pass in rank order would keep when a kept node drops its neighbours.

    ``nodes`` has unique ``node, rank`` (a total order, smallest first); ``edges`` has ``src, dst`` in either direction.
    Every round keeps each open node that outranks all of its open neighbours and drops the neighbours of kept nodes,
    which gives the same set as the sequential pass.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both, _ = measured(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    status, _ = measured(nodes.select("node", "rank", F.lit(0).alias("state")))
    while True:
        open_ = status.filter("state = 0").select("node", "rank")
        rivals = (both.hint("merge").join(open_.select(F.col("node").alias("b"), F.col("rank").alias("r_rank")), "b").groupBy("a").agg(F.min("r_rank").alias("best")))
        kept = open_.hint("merge").join(rivals, open_["node"] == rivals["a"], "left").filter(F.col("best").isNull() | (F.col("rank") < F.col("best"))).select("node", F.lit(True).alias("k"))
        hit = both.hint("merge").join(kept.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node"), F.lit(True).alias("d")).distinct()
        state = F.when(F.col("state") != 0, F.col("state")).when(F.col("k"), 1).when(F.col("d"), 2).otherwise(0)
        status, waiting = measured(status.hint("merge").join(kept, "node", "left").hint("merge").join(hit, "node", "left").select("node", "rank", state.alias("state")), "state = 0")
        if not waiting:
            return status.filter("state = 1").select("node")
