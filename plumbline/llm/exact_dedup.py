"""Exact deduplication by a heavy-hitter split, in native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, documents, drop_marked, whole_text

#: Counters of the frequent-items summary. Any digest with more than about 1/TRACKED of the rows is found.
TRACKED = 4096
#: Partial summaries are first combined in so many groups, so no task meets all of them.
COMBINERS = 64


def frequent_digests(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """At most ``tracked`` candidate heavy hitters of column ``text_sha256`` (Misra-Gries counters).

    Spark's mergeable frequent-items summary keeps ``tracked`` counters and decrements all of them when they
    run out, which is the Misra-Gries rule. Its counts are bounds, so callers verify them exactly.
    """
    partial = digests.groupBy((F.spark_partition_id() % COMBINERS).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(text_sha256, {tracked})").alias("summary"))
    # One group rather than a global aggregate: the combining function fails on an empty partition.
    top = partial.groupBy(F.col("part") < 0).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {tracked}), {tracked})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest id stays (null ids rank lowest; of rows repeating that id exactly one stays). Frequent digests
    are counted exactly with map-side combine and their winners, at most ``tracked`` rows, are broadcast: rows
    of a hot group are settled where they are. Only the remaining, infrequent digests are shuffled.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(whole_text(text_col)), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("uid")))
    candidates = frequent_digests(rows.select("text_sha256"), tracked)
    best = F.max(F.struct("doc_id", "uid")).alias("best")
    winners = checkpointed(rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
                           .groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size")))
    settled = rows.join(F.broadcast(winners), "text_sha256")
    same = Window.partitionBy("text_sha256")
    rest = (rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
            .withColumns({"best": F.max(F.struct("doc_id", "uid")).over(same), "group_size": F.count(F.lit(1)).over(same)}))
    return settled.unionByName(rest).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all columns kept, with one row of each group of equal texts: the one with the largest id.

    Null ids rank lowest, so a row without an id stays only where its whole group has none; of rows repeating
    the kept id with an equal text one stays.
    """
    found = checkpointed(exact_dedup(docs)).select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return drop_marked(docs, found, lambda rows: rows.withColumn("key", F.sha2(ascii_lower(whole_text()), 256)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
