"""Target-distribution importance resampling over hashed words and word pairs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.ranks import numbered

from .common import add_columns, checkpointed, documents, table, whole_text

BUCKETS = 10_000
SEED, PERCENT, MIN_WORDS = 7, 25, 20
#: Relative rank error of the first quantile sketch, and the factor by which a bracket that misses is widened.
SKETCH_ERROR, WIDEN = 0.002, 4
#: Bytes of text whose words are hashed together; longer texts are cut between words.
CHUNK_BYTES = 1 << 21
#: Words up to this many bytes are hashed as arrays, longer ones one by one.
ARRAY_WORD = 48


def _steps() -> np.ndarray:
    """Register after one byte, for each value of its low byte (the reflected polynomial of CRC-32)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320) ^ (out >> np.uint32(1)), out >> np.uint32(1))
    return out


_STEP = _steps()


def _shifts() -> np.ndarray:
    """``[length, k, b]``: what byte ``k`` of a checksum with value ``b`` turns into when ``length`` bytes follow."""
    at = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    rows = [at]
    for _ in range(ARRAY_WORD):
        at = _STEP[at & np.uint32(255)] ^ (at >> np.uint32(8))
        rows.append(at)
    return np.stack(rows)


_SHIFT = _shifts()
_BLANK = np.uint32(zlib.crc32(b" "))
#: Lower case of A-Z as bytes, and the bytes that words consist of: digits, letters and all of other scripts.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def pieces(texts: Iterable[bytes]) -> Iterator[tuple[int, bytes, bool]]:
    """``text number, bytes, whether the first word was counted before``: each text, long ones cut between words. A later
    piece starts with the last word of those before, so that no pair is lost."""
    for k, text in enumerate(texts):
        if len(text) <= CHUNK_BYTES:
            yield k, text, False
            continue
        word = _WORD[_LOWER[np.frombuffer(text, np.uint8)]]
        gaps, begins = np.flatnonzero(~word), np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))

        def gap_from(at: int, gaps: np.ndarray = gaps, size: int = len(text)) -> int:
            place = int(np.searchsorted(gaps, at))
            return int(gaps[place]) if place < len(gaps) else size

        end, last = 0, b""
        while end < len(text):
            stop = gap_from(end + CHUNK_BYTES)
            yield k, last + text[end:stop], bool(last)
            w = int(np.searchsorted(begins, stop)) - 1
            if w >= 0:
                last = text[begins[w]:gap_from(int(begins[w]))]
            end = stop


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``buckets, text number of each, words of each text``, for a bounded stretch of the texts at a time.

    Checksums of words come from one table step per byte position over all words still that long. The checksum of a
    pair is that of the first word and a blank, shifted by the length of the second, and that of the second: checksums
    are linear, so no pair is spelled out.
    """
    held: list[tuple[int, bytes, bool]] = []
    size = 0
    for piece in pieces(texts):
        held.append(piece)
        size += len(piece[1]) + 1
        if size >= CHUNK_BYTES:
            yield _hashed(held, len(texts))
            held, size = [], 0
    if held:
        yield _hashed(held, len(texts))


def _hashed(held: list[tuple[int, bytes, bool]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = b"\0".join([b"", *(p for _, p, _ in held), b""])
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(_WORD[data].view(np.int8)))
    start, end = edge[0::2] + 1, edge[1::2] + 1
    size = end - start
    crc = _checksums(data, start, size)
    ends = np.cumsum([len(p) + 1 for _, p, _ in held])
    piece = np.searchsorted(ends, start, side="left")
    text, seen = np.array([k for k, _, _ in held]), np.array([again for _, _, again in held])
    first = np.ones(len(start), bool)
    first[1:] = piece[1:] != piece[:-1]
    counted = ~(first & seen[piece])
    second = np.flatnonzero(~first)
    pair = _STEP[crc[second - 1] & np.uint32(255)] ^ (crc[second - 1] >> np.uint32(8)) ^ _BLANK
    length = np.minimum(size[second], ARRAY_WORD)
    moved = np.zeros(len(second), np.uint32)
    for k in range(4):
        moved ^= _SHIFT[length, k, (pair >> np.uint32(8 * k)) & np.uint32(255)]
    moved ^= crc[second]
    for i in np.flatnonzero(size[second] > ARRAY_WORD).tolist():
        word = data[start[second[i]]:end[second[i]]].tobytes()
        moved[i] = zlib.crc32(word, int(pair[i]))
    buckets = np.concatenate([crc[counted], moved]) % np.uint32(BUCKETS)
    return buckets.astype(np.int64), text[np.concatenate([piece[counted], piece[second]])], np.bincount(text[piece[counted]], minlength=n)


def _checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    order = np.argsort(-np.minimum(size, ARRAY_WORD + 1), kind="stable")
    at, left = start[order], size[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(ARRAY_WORD):
        n = int(np.searchsorted(-left, -k, side="left"))  # words longer than k come first
        if not n:
            break
        state[:n] = _STEP[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > ARRAY_WORD).tolist():
        out[i] = zlib.crc32(data[start[i]:start[i] + size[i]].tobytes())
    return out


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket; every task adds up its own before the shuffle, and the driver
    receives at most ``BUCKETS`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buckets, _, _ in features(batch.column(0).to_pylist()):
                total += np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    counted = docs.select(whole_text().cast("binary").alias("t")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed target and source shares of each bucket, in thousandths, rounded down."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A Gumbel draw in thousandths, rounded down, from the seed and the id (rows without an id: the empty one)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` per row: gains are looked up as arrays and averaged per text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(ids: list[int | None], texts: list[bytes]) -> tuple:
        words, found, total = (np.zeros(len(texts), np.int64) for _ in range(3))
        for buckets, text, counts in features(texts):
            words += counts
            found += np.bincount(text, minlength=len(texts))
            total += np.bincount(text, shared.value[buckets], len(texts)).astype(np.int64)  # exact: sums stay below 2**53
        weight = total // np.maximum(found, 1)
        return words, found, weight, weight + np.array([noise(i, seed) for i in ids], np.int64)

    source = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    return add_columns(source, ["doc_id", "text"], run, "n_words long, n_features long, weight long, score long", keep=["doc_id"])


def best_first() -> list[Column]:
    """The order of the draw: highest score, then smallest id (nulls last), then size; ``uid`` tells equal rows apart."""
    return [-F.col("score"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("n_features"), F.col("uid")]


def cutoff(rows: DataFrame, total: int, draw: int, error: float = SKETCH_ERROR) -> Row | None:
    """The last row of the first ``draw`` of ``total`` rows (None: draw none).

    A quantile sketch of the scores brackets it. Rows above and inside the bracket are counted exactly; a bracket that
    misses is widened, in the end to all scores. Only the rows inside are sorted.
    """
    if draw <= 0:
        return None
    while True:
        share = 1 - draw / total
        if error < 1:
            low, high = rows.approxQuantile("score", [max(0.0, share - error), min(1.0, share + error)], error)
        else:
            low, high = -math.inf, math.inf
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < draw <= above + inside:
            bracket = rows.filter(F.col("score").between(low, high))
            return numbered(bracket, best_first(), "rank").filter(F.col("rank") == draw - above).first()
        error *= WIDEN


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` per row; the rows with a rank are drawn.

    Of the rows with at least ``min_words`` words ``percent`` per cent (rounded down) are drawn without replacement, by the
    highest sums of weight and Gumbel noise. ``target`` is a table with a column ``text``. Null and empty texts have no
    features and weight 0. Ties go to the smaller id, rows without an id come after all others; rows equal in id and
    score are ranked by size, equal rows in any order. An empty table gives no rows, an empty target equal shares; other
    columns are ignored.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = checkpointed(scored(docs, gain, seed).withColumn("uid", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= min_words
    total = rows.filter(fit).count()
    last = cutoff(rows.filter(fit), total, percent * total // 100)
    if last is None:
        drawn = F.lit(False)
    else:
        at = [-last.score, last.doc_id is None, last.doc_id or 0, last.n_features, last.uid]
        drawn = fit & (F.struct(*(c.alias(f"k{k}") for k, c in enumerate(best_first()))) <= F.struct(*(
            F.lit(v).cast("boolean" if isinstance(v, bool) else "long").alias(f"k{k}") for k, v in enumerate(at))))
    ranked = numbered(rows.filter(drawn), best_first(), "rank")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH RECURSIVE crc_step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS n, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
worded AS MATERIALIZED (
  SELECT kind, n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
found AS MATERIALIZED (
  SELECT kind, n, f, count(*) AS m
  FROM (SELECT kind, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded)
  GROUP BY ALL),
spelled AS (
  SELECT f, list_transform(string_split(hex(encode(f)), ''), lambda c: ord(c) - CASE WHEN c > '9' THEN 55 ELSE 48 END) AS h
  FROM (SELECT DISTINCT f FROM found)),
placed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(f)), lambda i: h[2 * i + 1] * 16 + h[2 * i + 2])),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, crc_table),
counted AS (SELECT kind, bucket, sum(m) AS m FROM found JOIN placed USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(m) FILTER (kind = 'd'), 0) AS s_all, coalesce(sum(m) FILTER (kind = 'b'), 0) AS t_all FROM counted),
shares AS (SELECT bucket, coalesce(sum(m) FILTER (kind = 'd'), 0) AS s, coalesce(sum(m) FILTER (kind = 'b'), 0) AS t FROM counted GROUP BY bucket),
gained AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM shares, totals),
weighed AS (
  SELECT n, sum(m)::BIGINT AS n_features, floor(sum(m * gain)::DOUBLE / sum(m)::DOUBLE)::BIGINT AS weight
  FROM found JOIN placed USING (f) JOIN gained USING (bucket) WHERE kind = 'd' GROUP BY n),
drawn AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weighed USING (n) WHERE kind = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS total
  FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * total // 100 THEN place END AS rank FROM ranked
"""
