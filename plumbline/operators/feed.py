"""The public feed of anomalies: stations under pseudonyms, in columns and in free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.graph import checkpointed
from plumbline.functions.ranks import numbered
from plumbline.functions.rules import OVERLAY, PRIMARY

# What stands for a station in a text, in the order in which a text's names are numbered.
NAME_PATTERNS = (r"\b[A-Z0-9]{8,12}\b", r"NRBY_\w+", r"ONO_\w+")
SALTS = 16


def public_feed(rows: DataFrame, order: str = "id", station: str = "station", text: str = "text") -> DataFrame:
    """``rows`` with stations as STN-0001 and so on, in the column and inside the text, and network names as ``network``.

    ``order`` tells the rows apart. Names are numbered in the order of their first use: row by row, in a row its station
    first, then the names in its text, pattern by pattern. A text is cut into its names and what lies between, names are
    joined with their numbers, and the pieces are put together again in order; the join is salted, for one station may be
    named in most rows. No map of names is held anywhere. Null stations and texts stay null.
    """
    c = F.col
    any_name = "|".join(NAME_PATTERNS)
    mask = lambda x: F.regexp_replace(x, rf"(?i){PRIMARY}|{OVERLAY}", "network")
    own = checkpointed(rows.withColumns({"_id": c(order), "_station": F.when(c(station) != "", c(station)), "_text": c(text)}))
    between, names = F.split("_text", any_name), F.regexp_extract_all("_text", F.lit(any_name), F.lit(0))
    pieces = own.filter("_text is not null").select("_id", F.posexplode(F.arrays_zip(between.alias("plain"), names.alias("name"))).alias("_pos", "p")).select(
        "_id", "_pos", mask(c("p.plain")).alias("plain"), F.when(c("p.name").rlike(f"^(?:{NAME_PATTERNS[1]}|{NAME_PATTERNS[2]})$"), mask(c("p.name"))).otherwise(c("p.name")).alias("name"))
    kind = F.when(c("name").startswith("NRBY_"), 2).when(c("name").startswith("ONO_"), 3).otherwise(1)
    pieces = checkpointed(pieces.withColumn("_kind", kind))
    used = pieces.filter("name is not null").select("name", "_id", "_kind", "_pos").unionByName(
        own.filter("_station is not null").select(c("_station").alias("name"), "_id", F.lit(0).alias("_kind"), F.lit(0).alias("_pos")))
    first = used.groupBy("name").agg(F.min(F.struct("_id", "_kind", "_pos")).alias("first"))
    codes = numbered(first, [c("first"), c("name")], "n").select("name", F.format_string("STN-%04d", c("n")).alias("code"))
    codes = checkpointed(codes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lambda df, *by: df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    texts = (salted(pieces, "_id", "_pos").join(codes, ["name", "salt"], "left")
             .groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "plain", "code"))).alias("parts"))
             .select("_id", F.array_join(F.transform("parts", lambda p: F.concat(p["plain"], F.coalesce(p["code"], F.lit("")))), "").alias("_clean")))
    stations = codes.select(c("name").alias("_station"), "salt", c("code").alias("_code"))
    named = salted(own, "_id").join(stations, ["_station", "salt"], "left").join(texts, "_id", "left")
    shown = {station: c("_code"), text: c("_clean")}
    return named.select(*(shown.get(name, c(name)).alias(name) for name in rows.columns))
