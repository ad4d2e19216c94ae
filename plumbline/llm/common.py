"""Column helpers shared by the text operators."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from plumbline.functions.graph import checkpointed

__all__ = ["add_columns", "ascii_lower", "checkpointed", "columns_of", "documents", "drop_marked", "held_out", "shared_folder", "small_enough", "table", "unused_name", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path below the checkpoint folder, which driver and executors share."""
    checkpointed(spark.range(0))  # makes sure that the folder is set
    return f"{spark.sparkContext.getCheckpointDir()}/{name}"


def whole_text(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the JVM's fast path, others a character map."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """True for rows of the evaluation fold: crc32 of the id as text, modulo ``modulus``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def unused_name(df: DataFrame) -> str:
    """A plain name longer than those of all columns, so none has it."""
    return "x" * (max(map(len, df.columns), default=0) + 1)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns as they are named, dots and quotes in the names included."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def add_columns(rows: DataFrame, reads: Sequence[str], compute: Callable[..., Sequence], columns: str, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) of ``rows``, and ``columns`` (a DDL list) from ``compute``.

    ``compute`` gets the values of the columns ``reads`` as lists, a batch at a time, and returns one sequence
    (or Arrow array) for each new column. Kept columns pass through as Arrow, never as pandas: an integer
    beside a null stays the integer that it is. On the way columns are named by position, so names may hold anything.
    """
    keep = list(rows.columns if keep is None else keep)
    added = StructType.fromDDL(columns)
    types = [to_arrow_type(f.dataType) for f in added]
    place = {name: f"c{k}" for k, name in enumerate(rows.columns)}
    kept, read = [place[name] for name in keep], [place[name] for name in reads]
    plain = rows.toDF(*place.values())
    schema = StructType([plain.schema[name] for name in kept] + [StructField(f"n{k}", f.dataType) for k, f in enumerate(added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = compute(*(batch.column(name).to_pylist() for name in read))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *arrays], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*keep, *added.names)


def drop_marked(docs: DataFrame, found: DataFrame, with_key: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows that ``found`` (``doc_id, key, kept`` for every row of ``docs``) marks.

    Rows are known by id and key (of their text), and of rows with a kept id and key exactly one stays. Most ids
    stand for one row: an id none of whose rows is kept goes by an anti join on the id alone. Ids on several rows
    some of which stay, and null ids on several rows, are told apart by the key, which ``with_key`` adds to a
    table with a column ``text``; their equal rows are reduced map-side first, so a hot id meets in no task.
    """
    ids = checkpointed(found.groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1"))
    gone = ids.filter("not stays and doc_id is not null").select("doc_id")
    unclear = ids.filter("(stays and n > 1) or doc_id is null").select(F.col("doc_id").alias("unclear"))
    if unclear.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*columns_of(docs))
    rows = docs.select("doc_id", "text", F.struct(*columns_of(docs)).alias("row"))
    named = rows.filter("doc_id is not null").join(gone, "doc_id", "left_anti").unionByName(rows.filter("doc_id is null"))
    is_unclear = F.col("doc_id").eqNullSafe(F.col("unclear"))
    plain = named.join(unclear, is_unclear, "left_anti").select("row.*")
    keyed = with_key(named.join(unclear, is_unclear, "left_semi")).dropDuplicates(["doc_id", "key"])
    stays = (found.filter("kept").select("doc_id", "key").join(unclear, is_unclear, "left_semi").distinct()
             .select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")))
    once = keyed.join(stays, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    return plain.unionByName(once.select("row.*"))
