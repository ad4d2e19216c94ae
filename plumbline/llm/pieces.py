"""Piece encoding and decoding: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, documents
from .ragged import ChunkCache, from_lists
from .rans import _groups

MARK = "▁"
#: Penalty of an unknown character below the lowest score, as usual for unigram models.
UNKNOWN_PENALTY = 10.0
#: Chunks of up to so many bytes are solved together; longer ones one by one.
TOGETHER_BYTES = 48


@dataclass
class Vocabulary:
    """Pieces with log scores. ``pieces[id]`` is None for control and unknown ids."""

    pieces: list[bytes | None]
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown_id: int
    dummy_prefix: bool = True

    @property
    def unknown_score(self) -> float:
        used = [s for p, s in zip(self.pieces, self.scores) if p is not None]
        return (min(used) if used else 0.0) - UNKNOWN_PENALTY


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file. Unigram models bring log scores; models of merges bring ranks only, which become
    log scores by Zipf's law, ``-log(rank + 2)``, with the rank given by the order of the ids."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    reader = SentencePieceProcessor(model_file=path)
    unigram = model.trainer_spec.model_type == schema.TrainerSpec.UNIGRAM
    n = reader.get_piece_size()
    pieces: list[bytes | None] = [None] * n
    scores, byte_ids, rank = np.zeros(n), np.full(256, -1, np.int32), 0
    for i in range(n):
        if reader.is_byte(i):
            byte_ids[int(reader.id_to_piece(i)[3:5], 16)] = i
        elif not (reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i)):
            pieces[i] = reader.id_to_piece(i).encode()
            scores[i] = reader.get_score(i) if unigram else -math.log(rank + 2)
            rank += 1
    return Vocabulary(pieces, scores, byte_ids, reader.unk_id(), model.normalizer_spec.add_dummy_prefix)


@dataclass
class Trie:
    """Double array over UTF-8 bytes: the child of ``s`` by byte ``c`` is ``base[s] + c + 1`` if ``check`` of it is ``s``.

    ``value[s]`` is the id of the piece that ends in state ``s``, or -1. State 0 is the root.
    """

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(pieces: list[bytes | None]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for i, piece in enumerate(pieces):
        if piece:
            node = 0
            for c in piece:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    ends.append(-1)
            ends[node] = i
    size = 2 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0], value[0], check[0] = 1, ends[0], -2
    queue, free = [(0, 0)], 257  # low slots stay open, so that every byte can reach the first free one
    hint = [0] * 257  # by number of children: where the last such node found room
    for node, state in queue:
        kids = sorted(children[node])
        if not kids:
            continue
        while taken[free]:
            free += 1
        at = max(free - kids[0] - 1, 0) if len(kids) == 1 else max(free - kids[0] - 1, hint[len(kids)], 0)
        while any(at + c + 1 >= size or taken[at + c + 1] for c in kids):
            at += 1
            if at + 257 >= size:
                grow = size
                base, check, value = (np.concatenate([x, np.full(grow, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                taken.extend(bytes(grow))
                size += grow
        base[state] = hint[len(kids)] = at
        for c in kids:
            child, target = children[node][c], at + c + 1
            taken[target], check[target], value[target] = 1, state, ends[child]
            queue.append((child, target))
    room = np.zeros(258, np.int32)
    return Trie(np.concatenate([base, room]), np.concatenate([check, room - 1]), np.concatenate([value, room - 1]))


class Encoder:
    """Exact Viterbi segmentation. Of equally good segmentations the one found first, with the longer last piece, wins."""

    def __init__(self, vocabulary: Vocabulary, trie: Trie) -> None:
        self.vocabulary, self.trie = vocabulary, trie
        words = [p.decode() for p in vocabulary.pieces if p]
        self.longest = max(map(len, (p for p in vocabulary.pieces if p)), default=1)
        # Text may be cut before a mark where no piece has a mark after another letter, and around line feeds if no piece has one.
        self.cuts = not any(MARK in w.lstrip(MARK) for w in words)
        lines = not any("\n" in w for w in words)
        self.chunk = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if lines else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache = ChunkCache(lambda chunks: from_lists(self._solve(chunks)))
        self.scores = np.append(vocabulary.scores, 0.0)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (MARK if self.vocabulary.dummy_prefix else "") + text.replace(" ", MARK)
        return self.chunk.findall(marked) if self.cuts else [marked]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        return self.cache.ids([self.chunks(t) for t in texts])

    def _solve(self, chunks: list[str]) -> list[list[int]]:
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        out: list[list[int]] = [[] for _ in raw]
        by_size: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            by_size.setdefault(len(b), []).append(k)
        for size, rows in by_size.items():
            for at in range(0, len(rows), 20_000 if size <= TOGETHER_BYTES else 1):
                part = rows[at:at + (20_000 if size <= TOGETHER_BYTES else 1)]
                for k, ids in zip(part, self._together([raw[r] for r in part], size)):
                    out[k] = ids
        return out

    def _together(self, raw: list[bytes], size: int) -> list[list[int]]:
        """Viterbi for texts of equal length, all at once; a step handles one start and one length."""
        if len(raw) == 1:
            return [self._single(raw[0])]
        trie, n = self.trie, len(raw)
        text = np.frombuffer(b"".join(raw), np.uint8).reshape(n, size).astype(np.int32)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
        width = np.where(text < 0xC0, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        starts = (text & 0xC0) != 0x80
        for i in range(size):
            rows = np.flatnonzero(starts[:, i] & (best[:, i] > -np.inf))
            single = np.zeros(n, bool)
            state = np.zeros(len(rows), np.int32)
            for j in range(i, min(size, i + self.longest)):
                to = trie.base[state] + text[rows, j] + 1
                on = trie.check[to] == state
                rows, state = rows[on], to[on]
                if not len(rows):
                    break
                value = trie.value[state]
                hit = value >= 0
                r, v = rows[hit], value[hit]
                single[r] |= width[r, i] == j + 1 - i
                score = best[r, i] + self.scores[v]
                better = score > best[r, j + 1]
                r, v, score = r[better], v[better], score[better]
                best[r, j + 1], back[r, j + 1], piece[r, j + 1] = score, i, v
            rows = np.flatnonzero(starts[:, i] & (best[:, i] > -np.inf) & ~single)
            if len(rows):
                end = np.minimum(i + width[rows, i], size)
                score = best[rows, i] + self.vocabulary.unknown_score
                better = score > best[rows, end]
                rows, end, score = rows[better], end[better], score[better]
                best[rows, end], back[rows, end], piece[rows, end] = score, i, -1
        return [self._trace(b, back[k].tolist(), piece[k].tolist()) for k, b in enumerate(raw)]

    def _single(self, b: bytes) -> list[int]:
        base, check, value, scores = self._lists()
        size, unknown = len(b), self.vocabulary.unknown_score
        best, back, piece = [-math.inf] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        i = 0
        while i < size:
            lead = b[i]
            end = min(size, i + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4))
            single, state, here = False, 0, best[i]
            for j in range(i, min(size, i + self.longest)):
                to = base[state] + b[j] + 1
                if check[to] != state:
                    break
                state = to
                v = value[state]
                if v >= 0:
                    single |= j + 1 == end
                    if here + scores[v] > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = here + scores[v], i, v
            if not single and here + unknown > best[end]:
                best[end], back[end], piece[end] = here + unknown, i, -1
            i = end
        return self._trace(b, back, piece)

    def _lists(self) -> tuple[list, list, list, list]:
        if not hasattr(self, "_plain"):
            self._plain = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        return self._plain

    def _trace(self, b: bytes, back: list[int], piece: list[int]) -> list[int]:
        ids, end, byte_ids = [], len(b), self.vocabulary.byte_ids
        while end > 0:
            start = back[end]
            if piece[end] >= 0:
                ids.append(piece[end])
            elif byte_ids[0] >= 0:
                ids.extend(int(byte_ids[c]) for c in reversed(b[start:end]))
            else:
                ids.append(self.vocabulary.unknown_id)
            end = start
        return ids[::-1]


class Decoder:
    """Ids to text: pieces and fallback bytes are joined as UTF-8, marks become spaces, the first one is dropped."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        raw = [p or b"" for p in vocabulary.pieces]
        for c, i in enumerate(vocabulary.byte_ids):
            if i >= 0:
                raw[i] = bytes([c])
        self.dummy_prefix = vocabulary.dummy_prefix
        self.size = np.array([len(p) for p in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)
        text = self.bytes[at].tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_pieces, piece_ids, ids_crc32, round_trip`` per row, for whole texts (null: empty).

    ``round_trip`` tells whether decoding gives the text back, which it does for every text without the mark
    U+2581 itself (that one decodes to a space) and without unpaired surrogates. Empty texts have no pieces.
    The trie is built once and broadcast; its size is that of the vocabulary. Repeated rows and null ids are
    encoded like any other; an empty table gives no rows, other columns are ignored.
    """
    vocabulary = load_vocabulary(model_path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, build_trie(vocabulary.pieces)))

    def run(texts: list[str | None]) -> tuple:
        encoder, decoder = _coders(shared)
        texts = [t or "" for t in texts]
        parts = []
        for a, b in _groups(texts):
            flat, sizes = encoder.encode(texts[a:b])
            each = np.split(flat, np.cumsum(sizes)[:-1])
            parts.append((flat, sizes, [zlib.crc32(ids.astype("<u4")) for ids in each], [decoder.decode(ids) == t for t, ids in zip(texts[a:b], each)]))
        flat, sizes = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int32) for k in (0, 1))
        ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat.astype(np.int32)))
        return sizes, ids, [x for p in parts for x in p[2]], [x for p in parts for x in p[3]]

    return add_columns(docs, ["text"], run, "n_pieces long, piece_ids array<int>, ids_crc32 long, round_trip boolean", keep=["doc_id"])


_KEPT: dict = {}


def _coders(shared) -> tuple[Encoder, Decoder]:
    """One encoder and decoder per broadcast and worker process, so that the cache serves all batches of the worker."""
    if shared.value is not _KEPT.get("value"):
        _KEPT.update(value=shared.value, coders=(Encoder(*shared.value), Decoder(shared.value[0])))
    return _KEPT["coders"]


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from rows with ``doc_id, piece_ids``; a null array gives an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(ids: list[list[int] | None]) -> tuple[list[str]]:
        decoder = Decoder(shared.value)
        return ([decoder.decode(np.asarray(x or [], np.int64)) for x in ids],)

    return add_columns(encoded, ["piece_ids"], run, "text string", keep=["doc_id"])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), default_model())
