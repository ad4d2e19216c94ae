"""Token-id files: static range asymmetric numeral system in independent interleaved blocks."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import checkpointed, documents, shared_folder, whole_text
from .ragged import ChunkCache, Encoded, from_lists

VOCABULARY = 50_257
END_ID = 0
#: Frequencies of the shared table add up to 2**SCALE_BITS; every id of the vocabulary has at least one.
SCALE_BITS = 20
#: Tokens of a block, and the interleaved states of one.
BLOCK, LANES = 4096, 8
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
#: A segment holds whole documents of about so many tokens and is one record of the file.
SEGMENT_TOKENS = 1 << 21
#: Text bytes that one file is made for.
FILE_BYTES = 1 << 27
#: Counts of the frequency table travel in so many ranges of ids.
COUNT_RANGES = 256
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of the Latin blocks up to U+024F; any character of them is a letter to the tokenizer too.
LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Words with the one space before them, what else is not white space, and white space: the tokenizer never
#: merges across their edges. A word ends for certain only before white space or an ASCII character that is no letter.
CHUNK = re.compile(rf" ?[{LATIN}]+(?=[{SPACE}!-@\[-`{{-\x7e]|\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Words that begin with a space are encoded in strings of so many, which saves most of the cost per call.
JOINED = 512


class Tokenizer:
    """Byte-level BPE of the tokenizers library; each different chunk of text is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        #: Added tokens are found before all else and keep their ids; texts are cut around them.
        self.literals = [t.content for _, t in sorted(self.library.get_added_tokens_decoder().items())]
        self.added = re.compile("|".join(map(re.escape, self.literals)))
        self.bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.bytes[i] = len(token)  # one character per byte in this kind of vocabulary
        self.cache = ChunkCache(self._encode_chunks)

    def _encode_chunks(self, chunks: list[str]) -> Encoded:
        """Spaced words end to end in long strings, cut again by the byte lengths of their ids; others one by one."""
        spaced = np.fromiter((len(c) > 1 and c[0] == " " and c[1].isalpha() for c in chunks), bool, len(chunks))
        words = [c for c, s in zip(chunks, spaced.tolist()) if s]
        joined = self.library.encode_batch_fast(["".join(words[k:k + JOINED]) for k in range(0, len(words), JOINED)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in joined]) if joined else np.zeros(0, np.int32)
        edges = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.int64)
        reached = np.cumsum(self.bytes[ids])
        ends = np.searchsorted(reached, edges) + 1
        if len(words) and not (reached[np.minimum(ends - 1, len(reached) - 1)] == edges).all():
            return from_lists([e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)])
        rest, n_rest = from_lists([e.ids for e in self.library.encode_batch_fast([c for c, s in zip(chunks, spaced.tolist()) if not s], add_special_tokens=False)])
        counts = np.zeros(len(chunks), np.int64)
        counts[spaced], counts[~spaced] = np.diff(np.concatenate([[0], ends])) if len(words) else 0, n_rest
        flat, owner = np.zeros(int(counts.sum()), np.int32), np.repeat(spaced, counts)
        flat[owner], flat[~owner] = ids, rest
        return flat, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.ids([self._chunks(t) for t in texts])

    def _chunks(self, text: str) -> list[str]:
        if not any(token in text for token in self.literals):
            return CHUNK.findall(text)
        chunks, at = [], 0
        for m in self.added.finditer(text):
            chunks += [*CHUNK.findall(text[at:m.start()]), m[0]]
            at = m.end()
        return chunks + CHUNK.findall(text[at:])


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> Tokenizer:
    """One tokenizer per worker process, so that its cache serves all tasks of the worker."""
    return Tokenizer(path)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to add up to ``2**SCALE_BITS``, each at least 1 (largest ids absorb the rounding)."""
    total, room = 1 << SCALE_BITS, (1 << SCALE_BITS) - len(counts)
    scaled = 1 + (counts * (room / max(1, counts.sum()))).astype(np.int64)
    order = np.argsort(-scaled, kind="stable")
    rest = total - int(scaled.sum())
    if rest >= 0:
        scaled[order[0]] += rest
    for k in order if rest < 0 else ():
        take = min(-rest, int(scaled[k]) - 1)
        scaled[k] -= take
        rest += take
        if not rest:
            break
    return scaled


class Coder:
    """Encodes and decodes id arrays with one frequency table; all blocks of a call advance together."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    @staticmethod
    def _shape(n: int) -> tuple[int, int]:
        return -(-n // BLOCK), BLOCK // LANES

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """``words, states (blocks x LANES), first word of each block, crc32 of each block``.

        States and first words are the checkpoints: any block can be decoded on its own.
        """
        blocks, steps = self._shape(len(ids))
        padded = np.zeros(blocks * BLOCK, np.int64)
        padded[: len(ids)] = ids
        live = (np.arange(blocks * BLOCK) < len(ids)).reshape(blocks, steps, LANES)
        grid = padded.reshape(blocks, steps, LANES)
        state = np.full((blocks, LANES), LOW, np.uint64)
        words = np.zeros((blocks, steps, LANES), np.uint32)
        written = np.zeros((blocks, steps, LANES), bool)
        shift, bits = np.uint64(63 - SCALE_BITS), np.uint64(SCALE_BITS)
        for t in range(steps - 1, -1, -1):
            on = live[:, t]
            f = self.freq[grid[:, t]]
            out = (state >= (f << shift)) & on
            words[:, t][out] = (state[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            written[:, t] = out
            x = np.where(out, state >> WORD, state)
            high = x // f
            x = (high << bits) + (x - high * f) + self.cum[grid[:, t]]
            state = np.where(on, x, state)
        per_block = written.sum((1, 2))
        raw = ids.astype("<u4").tobytes()
        crc = np.array([zlib.crc32(raw[4 * BLOCK * b:4 * BLOCK * (b + 1)]) for b in range(blocks)], np.uint32)
        return words[written].astype("<u4").tobytes(), state, np.cumsum(per_block) - per_block, crc

    def decode(self, words: bytes | np.ndarray, states: np.ndarray, first: np.ndarray, crc: np.ndarray, n: int) -> np.ndarray:
        """The ids; raises ``ValueError`` naming the first block whose checksum does not match."""
        blocks, steps = self._shape(n)
        stream = np.concatenate([np.frombuffer(words, "<u4"), np.zeros(LANES, np.uint32)]).astype(np.uint64)
        state, at = states.reshape(blocks, LANES).copy(), first.astype(np.int64).copy()
        live = (np.arange(blocks * BLOCK) < n).reshape(blocks, steps, LANES)
        out = np.zeros((blocks, steps, LANES), np.uint16)
        mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        for t in range(steps):
            slot = state & mask
            symbol = self.symbol[slot]
            out[:, t] = symbol
            x = self.freq[symbol] * (state >> bits) + slot - self.cum[symbol]
            need = (x < LOW) & live[:, t]
            rank = np.cumsum(need, axis=1)
            place = np.minimum(at[:, None] + rank - 1, len(stream) - 1)
            x = np.where(need, (x << WORD) | stream[np.maximum(place, 0)], x)
            state = np.where(live[:, t], x, state)
            at += rank[:, -1]
        ids = out.reshape(-1)[:n]
        raw = ids.astype("<u4").tobytes()
        for b in range(blocks):
            if zlib.crc32(raw[4 * BLOCK * b:4 * BLOCK * (b + 1)]) != crc[b]:
                raise ValueError(f"block {b} is damaged")
        return ids


def _groups(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def file_numbers(doc_ids: pa.Array, cuts: np.ndarray, null_files: int, first_row: int) -> np.ndarray:
    """The file of each row, the first of which is row ``first_row`` of its task.

    Rows without an id take turns in the first ``null_files`` files. Of the others an id goes behind the ``cuts`` below it;
    an id that stands in ``cuts`` several times holds a file's share of rows each time, and its rows take turns in the
    files between.
    """
    rows = np.arange(first_row, first_row + len(doc_ids))
    ids = doc_ids.fill_null(0).to_numpy()
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    shared = np.maximum(high - low, 1)  # ends of a range are one file, not two
    found = null_files + np.where(high - low > 1, low + rows % (shared + 1), low)
    return np.where(doc_ids.is_null(), rows % max(null_files, 1), found)


def tokenised(docs: DataFrame, tokenizer_path: str, cuts: np.ndarray, null_files: int = 0) -> DataFrame:
    """``doc_id, file_no, n, ids`` per row (16-bit ids, end id included, compressed), and rows with ``counts`` instead:
    the id counts of one task in one range of ids. ``file_no`` is that of :func:`file_numbers`. Null texts count as empty. Ids of documents stay Arrow integers throughout."""
    width = -(-VOCABULARY // COUNT_RANGES)
    names = ["doc_id", "file_no", "n", "ids", "part", "counts"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pack = tokenizer_of(tokenizer_path), zstandard.ZstdCompressor(level=1)
        total, seen = np.zeros(COUNT_RANGES * width, np.int64), 0
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id")
            file_no = file_numbers(doc_ids, cuts, null_files, seen)
            seen += len(texts)
            for a, b in _groups(texts):
                flat, sizes = tokenizer.encode(texts[a:b])
                total += np.bincount(flat, minlength=len(total))
                total[END_ID] += b - a
                ends = np.cumsum(sizes)
                flat = flat.astype("<u2")
                packed = [pack.compress(flat[e - n:e].tobytes() + END_ID.to_bytes(2, "little")) for e, n in zip(ends.tolist(), sizes.tolist())]
                arrays = [doc_ids[a:b], pa.array(file_no[a:b], types[1]), pa.array(sizes + 1, types[2]), pa.array(packed, types[3]),
                          pa.nulls(b - a, types[4]), pa.nulls(b - a, types[5])]
                yield pa.RecordBatch.from_arrays(arrays, names)
        counts = [x.tobytes() for x in total.reshape(COUNT_RANGES, width)]
        arrays = [*(pa.nulls(COUNT_RANGES, t) for t in types[:4]), pa.array(range(COUNT_RANGES), types[4]), pa.array(counts, types[5])]
        yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return source.mapInArrow(run, "doc_id long, file_no int, n int, ids binary, part int, counts binary")


def shared_table(tokens: DataFrame) -> np.ndarray:
    """The frequency table of the whole corpus; the driver receives one row per range of ids."""

    def add(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "counts": [sum(np.frombuffer(c, np.int64) for c in pdf["counts"]).tobytes()]})

    rows = tokens.filter("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    counts = np.zeros((COUNT_RANGES, -(-VOCABULARY // COUNT_RANGES)), np.int64)
    for r in rows:
        counts[r.part] = np.frombuffer(r.counts, np.int64)
    return frequencies(counts.reshape(-1)[:VOCABULARY])


SEGMENT = ("file_no int, segment int, start long, doc_ids array<long>, lengths array<int>, n_tokens long, words binary, states binary, "
           "first_words binary, checksums binary")


def file_count(docs: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Files for the whole texts of ``docs``: one for each ``file_bytes`` of them, but no fewer than a shuffle has partitions."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, files: int | None = None) -> np.ndarray:
    """Tokenise ``docs`` and write the ids to ``path`` in ascending ``doc_id`` order (nulls first).

    Every record of the files is a segment of whole documents: their ids and lengths, the position of the
    first token in the corpus, the compressed words and, per block, checkpoint and checksum. The frequency
    table, returned too, is written beside them. Rows are dealt to files by ranges of ``doc_id``, so no sort is
    global, and there are as many files as the bytes of the texts ask for; rows without an id, and rows of an id that
    fills more than a file, are dealt to several files in turn, within a file in the order of their tokens. An empty table gives files without records; other columns are ignored.
    """
    spark = docs.sparkSession
    files = files or file_count(docs)
    cuts = np.sort(docs.select("doc_id").approxQuantile("doc_id", [k / files for k in range(1, files)], 0.2 / files)).astype(np.int64)
    without, total = docs.agg(F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1))).first()
    null_files = -(-files * without // max(total, 1))
    tokens = checkpointed(tokenised(docs, tokenizer_path, cuts, null_files))
    table = shared_table(tokens)
    shared = spark.sparkContext.broadcast(table)
    rows = tokens.filter("part is null").select("doc_id", "n", "ids", "file_no")
    sizes = {r.file_no: r.n for r in rows.groupBy("file_no").agg(F.sum("n").alias("n")).collect()}  # one row per file
    starts, at = {}, 0
    for k in sorted(sizes):
        starts[k], at = at, at + sizes[k]
    schema = to_arrow_schema(StructType.fromDDL(SEGMENT))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, unpack = Coder(shared.value), zstandard.ZstdDecompressor()
        file, number, start, waiting = -1, 0, 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, start, waiting
            ids = np.concatenate([np.frombuffer(unpack.decompress(x[2]), "<u2") for x in held])
            words, states, first, crc = coder.encode(ids)
            row = (file, number, start, [x[0] for x in held], [x[1] for x in held], len(ids), words, states.tobytes(),
                   first.astype("<i8").tobytes(), crc.tobytes())
            number, start, waiting = number + 1, start + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema.names)

        small = (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256))  # few rows as Python values at once
        for batch in small:
            for doc_id, n, ids, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "file_no"))):
                if f != file:
                    if held:
                        yield flush()
                    file, number, start = f, 0, starts[f]
                held.append((doc_id, n, ids))
                waiting += n
                if waiting >= SEGMENT_TOKENS:
                    yield flush()
        if held:
            yield flush()

    ordered = rows.repartitionById(len(cuts) + 1 + null_files, "file_no").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(encode, SEGMENT).write.option("compression", "uncompressed").parquet(f"{path}/segments")
    spark.createDataFrame([(table.astype("<i4").tobytes(),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    return table


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from the files, every block on its own."""
    table = np.frombuffer(spark.read.parquet(f"{path}/table").first().frequencies, "<i4").astype(np.int64)
    shared = spark.sparkContext.broadcast(table)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                raw = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)  # noqa: B023, E731
                start, n = batch.column("start")[k].as_py(), batch.column("n_tokens")[k].as_py()
                sizes = batch.column("lengths")[k].values.to_numpy().astype(np.int64)
                ids = coder.decode(raw("words", "<u4"), raw("states", np.uint64), raw("first_words", "<i8"), raw("checksums", np.uint32), n)
                tokens, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                sums = [zlib.crc32(tokens[4 * (e - m):4 * e]) for e, m in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(start + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.parquet(f"{path}/segments").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_folder(spark, f"token-files-{uuid.uuid4().hex}")
    write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path)
