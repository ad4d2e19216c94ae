"""Near-duplicate detection with 64-bit SimHash and a popcount-grid range join."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.graph import connected_components

from .common import add_columns, ascii_lower, checkpointed, documents, drop_marked, whole_text

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
#: Segments of a fingerprint, whose bit counts are its embedding.
SEGMENTS = 32
#: A fingerprint with more than such a share of the rows has its class broadcast; fewer than so many can.
HEAVY = 1024
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text whose A-Z are already lower case, as an unsigned 64-bit number.

    A bit is set when it is set in over half of the XXH64 values of all word shingles, repeats included.
    A text with fewer words than a shingle is one shingle; a text without words has fingerprint zero.
    """
    tokens = WORD.findall(text.encode("utf-8", "surrogatepass"))
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    if len(tokens) <= words:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = np.concatenate([[0], ends[:-words] + 1]).tolist(), ends[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _hashed(texts: list[str]) -> list[np.ndarray]:
    return [np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row as a signed 64-bit number; null texts count as empty."""
    source = docs.select("doc_id", ascii_lower(whole_text()).alias("t"))
    return add_columns(source, ["t"], _hashed, "fp long", keep=["doc_id"])


def embedding(fp: str = "fp") -> Column:
    """The bit counts of the ``SEGMENTS`` segments of two bits, each written in unary (0, 1, 2 as 00, 01, 11) in one long.

    So the Manhattan distance of two embeddings is the number of bits in which they differ. It is at most that of the
    fingerprints: no bit changes a count by more than one.
    """
    pairs = 0x5555555555555555
    either, both = f"(({fp} | shiftrightunsigned({fp}, 1)) & {pairs}L)", f"(({fp} & shiftrightunsigned({fp}, 1)) & {pairs}L)"
    return F.expr(f"{either} | shiftleft({both}, 1)")


def grid_cells(code: str = "code") -> Column:
    """Grid cells of an embedding, as an array of ``(half, cell, moved)``.

    Embeddings within Manhattan distance 3 are within 1 in one of the two halves of 16 segments: there they are equal, or one
    segment holds one bit more in one of them. A row is put in the cell of each half, and, marked ``moved``, in the
    cells one step up in one segment. Of two rows one step apart exactly one reaches the other's cell.
    """
    cells = []
    for half in (0, 1):
        own = f"(shiftrightunsigned({code}, {32 * half}) & 4294967295L)"
        count = f"(shiftrightunsigned({own}, 2 * i) & 3L)"
        cells.append(f"array(struct({half} AS half, {own} AS cell, false AS moved))")
        cells.append(f"transform(filter(sequence(0, {SEGMENTS // 2 - 1}), i -> {count} < 3L), "
                     f"i -> struct({half} AS half, {own} + shiftleft({count} + 1L, 2 * i) AS cell, true AS moved))")
    return F.expr(f"concat({', '.join(cells)})")


def fingerprint_links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``src, dst``: all pairs of different fingerprints of column ``fp`` within ``max_distance`` bits.

    Exact for distances up to 3: the grid finds all embeddings within that Manhattan distance, which bounds the bit
    difference from below, and pairs that pass it are verified bit by bit; only true links leave the join.
    """
    if max_distance > 3:
        raise ValueError("the grid reaches distances up to 3")
    coded = distinct.select("fp", embedding().alias("code"))
    spread = coded.select("fp", "code", F.explode(grid_cells()).alias("g")).select("fp", "code", "g.*")
    left = spread.select("half", "cell", "moved", F.col("fp").alias("src"), F.col("code").alias("src_code"))
    right = spread.filter("not moved").select("half", "cell", F.col("fp").alias("dst"), F.col("code").alias("dst_code"))
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    near = (apart("src_code", "dst_code") <= max_distance) & (apart("src", "dst") <= max_distance) & (F.col("moved") | (F.col("src") < F.col("dst")))
    found = left.join(right, (left["half"] == right["half"]) & (left["cell"] == right["cell"]) & near)
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def classified(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id, n_links, keep_id, keep_fp`` per row; the last two name the row that stays of a group.

    Fingerprints that hold over a ``HEAVY``-th of all rows, so fewer than ``HEAVY``, have their classes broadcast
    and their rows settled where they are; only the rows of the others are shuffled to their classes.
    """
    rows = checkpointed(fingerprints(docs))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    links = checkpointed(fingerprint_links(distinct.select("fp"), max_distance))
    degree = links.select(F.explode(F.array("src", "dst")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    linked = connected_components(links).withColumnRenamed("node", "fp").join(degree, "fp")
    first = F.min(F.struct(F.col("low").isNull().alias("unnamed"), "low", "fp"))
    members = checkpointed(distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    groups = members.filter("n_links is not null").groupBy("component").agg(first.alias("first"))
    alone = members.filter("n_links is null").withColumn("first", F.struct(F.col("low").isNull().alias("unnamed"), "low", "fp"))
    classes = checkpointed(members.filter("n_links is not null").join(groups, "component").unionByName(alone, allowMissingColumns=True).select(
        "fp", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("first.low").alias("component_id"), F.col("first.fp").alias("keep_fp")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") > total / HEAVY
    known = F.broadcast(classes.filter(heavy).drop("n"))
    rest = rows.join(F.broadcast(classes.filter(heavy).select("fp")), "fp", "left_anti").join(classes.filter(~heavy).drop("n"), "fp")
    return rows.join(known, "fp").unionByName(rest).withColumn("keep_id", F.col("component_id"))


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links`` per row.

    ``component_id`` is the smallest id reachable over links between fingerprints that differ in at most
    ``max_distance`` bits; equal fingerprints (so copies, and all texts without words) share one class, and
    links are sought between classes only. ``n_links`` counts the other classes linked to the row's class.
    Rows with a null id are linked like any other, but the smallest id ignores nulls (null if a group has no
    other). Repeated rows are returned as often as they stand. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    return classified(docs, max_distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all columns kept, with one row of each group of near duplicates: the one with the smallest id.

    Null ids come after all others; of rows with the same id in one group the one with the smaller fingerprint stays,
    of equal ones any. Ids repeated over different texts are settled text by text.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp"))
    found = checkpointed(classified(docs).select("doc_id", F.col("fp").alias("key"), kept.alias("kept")))
    return drop_marked(docs, found, lambda rows: add_columns(
        rows.withColumn("t", ascii_lower(whole_text())), ["t"], _hashed, "key long", keep=["doc_id", "row"]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
