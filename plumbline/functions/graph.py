"""Graph helpers expressed as DataFrame loops (no UDF, no driver-side graph)."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the cluster's ``spark.checkpoint.dir``.

    A directory set by the cluster is used as it is. Where none is set, a local session gets one of its own; on
    a cluster, whose nodes share no temporary folder, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        context.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def measured(df: DataFrame, test: str = "false") -> tuple[DataFrame, int]:
    """``df`` like :func:`checkpointed`, with the true size of its rows, and the number of rows that pass ``test``; for tables
    that a loop makes anew from themselves.

    A checkpoint takes over the size that the optimizer estimates for the plan before it, and that of a join is the
    product of its sides. In a loop such estimates have several times the digits each round, until these numbers alone fill the
    driver. Cached rows are measured, so they are cached until the checkpoint is written.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    passed = kept.agg(F.count_if(F.expr(test))).first()[0]
    out = checkpointed(kept)
    kept.unpersist()
    return out, passed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of an undirected edge list with the smallest node of its component.

    Nodes point at a node that is no larger, first at their smallest neighbour. Each round a node and the node that it points at
    both take the smallest of what the neighbours' parents point at, and pointers are jumped (FastSV), so long chains close
    in a logarithmic number of rounds. The loop ends when no pointer changes. Returns ``(node, component)``; an empty
    edge list gives an empty table. Both aggregates combine map-side, so a hub with very many neighbours never meets in one
    task. Tables meet by shuffles, however small they seem, so none passes through the driver.
    """
    c = F.col
    both = edges.select(c(src).alias("a"), c(dst).alias("b"))
    both, _ = measured(both.unionByName(both.select(c("b").alias("a"), c("a").alias("b"))).distinct())
    to = both.groupBy(c("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
    while True:
        parent = to.select(c("node").alias("to"), c("to").alias("next"))
        labels = to.hint("merge").join(parent, "to").select("node", "to", "next")
        near = both.hint("merge").join(labels.select(c("node").alias("b"), "next"), "b").groupBy(c("a").alias("node")).agg(F.min("next").alias("near"))
        met, moving = measured(labels.hint("merge").join(near, "node"), "next < to or near < to")
        if not moving:
            return met.select("node", c("to").alias("component"))
        hooks = F.array(F.struct("node", F.least("to", "next", "near").alias("to")), F.struct(c("to").alias("node"), F.least("next", "near").alias("to")))
        to = met.select(F.explode(hooks).alias("hook")).groupBy("hook.node").agg(F.min("hook.to").alias("to"))
