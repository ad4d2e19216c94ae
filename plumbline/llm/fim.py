"""Fill-in-middle transformation over texts stored as seekable compressed frames."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, documents, shared_folder, whole_text

#: Bytes of text in a frame. A cut costs at most one frame of decompression, a digest holds one frame at a time.
FRAME_BYTES = 1 << 18
LEVEL = 3

# The markers of the three parts, and the shares (in percent) of transformed and of suffix-first texts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM_RATE = 42, 50, 80

#: Space and the five control characters from tab to carriage return; all other bytes belong to words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
FRAMES = "array<struct<units: long, chars: long, frame: binary>>"
FRAME_NAMES = ("units", "chars", "frame")
#: A stored text: its frames, each with the units and the code points that begin before it, and both totals.
Frame = dict


@dataclass(frozen=True)
class Part:
    """A stretch of a stored text: whole frames as they are stored, and cut ones packed anew."""

    frames: list[bytes]
    chars: int


def unit_starts(data: bytes, before: int) -> np.ndarray:
    """Where units begin in ``data``, whose preceding byte is ``before`` (-1: none).

    A unit is a word with the white space before it, and white space that ends the text is a unit of its own: so one
    begins wherever white space follows a word, and at the start. The last byte before ``data`` tells all that is needed,
    hence frames may be cut anywhere.
    """
    space = _SPACE[np.frombuffer(data, np.uint8)]
    follows = np.empty(len(space), bool)
    if len(space):
        follows[0] = before < 0 or (not _SPACE[before] and space[0])
        follows[1:] = space[1:] & ~space[:-1]
    return np.flatnonzero(follows)


def characters(data: bytes) -> int:
    """Code points that begin in ``data`` (UTF-8)."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def pack(text: bytes, frame_bytes: int = FRAME_BYTES) -> tuple[list[Frame], int, int]:
    """The frames of a text, its number of units and of code points. An empty text has no frame."""
    packer, frames, units, chars = zstandard.ZstdCompressor(level=LEVEL), [], 0, 0
    for at in range(0, len(text), frame_bytes):
        data = text[at:at + frame_bytes]
        frames.append({"units": units, "chars": chars, "frame": packer.compress(data)})
        units += len(unit_starts(data, text[at - 1] if at else -1))
        chars += characters(data)
    return frames, units, chars


def place_of(frames: list[Frame], unit: int, n: int, chars: int) -> tuple[int, int, int, bytes]:
    """Where unit number ``unit`` begins: frame, byte in it, code point of the text, and the frame's content.

    The cumulative counts name the frame, and only that one is decompressed; the unit after the last begins after
    the last frame. Whether a frame's first byte follows a word is told by the count of its units.
    """
    if unit >= n:
        return len(frames), 0, chars, b""
    k = int(np.searchsorted([f["units"] for f in frames], unit, side="right")) - 1
    data = zstandard.ZstdDecompressor().decompress(frames[k]["frame"])
    inner = unit_starts(data, 0x20)  # as if white space came before: the units that begin past the first byte
    ends = frames[k + 1]["units"] if k + 1 < len(frames) else n
    if ends - frames[k]["units"] > len(inner):
        inner = np.concatenate([[0], inner])
    byte = int(inner[unit - frames[k]["units"]])
    return k, byte, frames[k]["chars"] + characters(data[:byte]), data


def split(frames: list[Frame], n: int, chars: int, first: int, second: int) -> tuple[Part, Part, Part]:
    """Prefix, middle and suffix: cut before unit ``first`` and before unit ``second``. Frames without a cut are taken as
    they are."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    (a, a_byte, a_char, a_data), (b, b_byte, b_char, b_data) = (place_of(frames, u, n, chars) for u in (first, second))
    stored = [f["frame"] for f in frames]

    def piece(data: bytes) -> list[bytes]:
        return [packer.compress(data)] if data else []

    prefix = stored[:a] + piece(a_data[:a_byte])
    middle = piece(a_data[a_byte:b_byte]) if a == b else piece(a_data[a_byte:]) + stored[a + 1:b] + piece(b_data[:b_byte])
    suffix = piece(b_data[b_byte:]) + stored[b + 1:]
    return Part(prefix, a_char), Part(middle, b_char - a_char), Part(suffix, chars - b_char)


def output_frames(form: str, parts: tuple[Part, Part, Part]) -> list[bytes]:
    """The output as frames: those of the parts in the order of the form, each part after its marker."""
    packer, (prefix, middle, suffix) = zstandard.ZstdCompressor(level=LEVEL), parts
    if form == "plain":
        return prefix.frames + middle.frames + suffix.frames
    order = {"psm": ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)), "spm": ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))}[form]
    return [frame for mark, part in order for frame in (packer.compress(mark), *part.frames)]


def stream(frames: list[bytes]) -> Iterator[bytes]:
    """The content of the frames in order, one frame at a time."""
    unpacker = zstandard.ZstdDecompressor()
    return map(unpacker.decompress, frames)


def find_marks(frames: list[bytes]) -> dict[bytes, int]:
    """The byte offset of each marker in the content; it may lie across frames."""
    found, at, tail = {}, 0, b""
    for data in stream(frames):
        joined = tail + data
        for mark in (PREFIX, SUFFIX, MIDDLE):
            hit = joined.find(mark)
            if hit >= 0:
                found.setdefault(mark, at - len(tail) + hit)
        at += len(data)
        tail = joined[-2:]
    return found


def between(frames: list[bytes], start: int, end: int) -> Iterator[bytes]:
    """The content from byte ``start`` to byte ``end``."""
    at = 0
    for data in stream(frames):
        if at < end and at + len(data) > start:
            yield data[max(0, start - at):end - at]
        at += len(data)


def restore(form: str, frames: list[bytes]) -> Iterator[bytes]:
    """The original text, from nothing but the output and its form, as a stream."""
    if form == "plain":
        yield from stream(frames)
        return
    marks = find_marks(frames)
    size = sum(map(len, stream(frames)))
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    spans = {first: (marks[first] + 3, marks[second]), second: (marks[second] + 3, marks[MIDDLE]), MIDDLE: (marks[MIDDLE] + 3, size)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from between(frames, *spans[mark])


def digest(data: Iterator[bytes]) -> str:
    out = hashlib.sha256()
    for block in data:
        out.update(block)
    return out.hexdigest()


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the seed and the id; rows without an id share those of the empty id."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(raw[k:k + 4], "big") for k in range(0, 16, 4)]


def store_frames(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``doc_id, n, chars, marked, frames`` per row: the whole text as independent frames with cumulative counts.

    ``n`` is the number of units, ``marked`` whether the text holds one of the three markers. Null and empty texts have no
    frames; other columns are ignored.
    """

    def run(texts: list[bytes]) -> tuple:
        packed = [pack(t, frame_bytes) for t in texts]
        return [n for _, n, _ in packed], [c for _, _, c in packed], [any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts], [f for f, _, _ in packed]

    source = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    return add_columns(source, ["text"], run, f"n long, chars long, marked boolean, frames {FRAMES}", keep=["doc_id"])


def transform_frames(stored: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per stored text; ``output`` holds the frames of the result.

    The two cuts, and the form, are drawn from the seed and the id alone, so a lost task draws the same again. A text
    without units, or with a marker in it, stays plain, and its part sizes are null.
    """

    def run(ids: list, ns: list, sizes: list, marked: list, frames: list) -> tuple:
        forms, prefix, middle, output = [], [], [], []
        for doc_id, n, chars, taken, held in zip(ids, ns, sizes, marked, frames):
            h1, h2, h3, h4 = draws(doc_id, seed)
            if not n or taken or h3 % 100 >= rate:
                forms.append("plain")
                prefix.append(None)
                middle.append(None)
                output.append([f["frame"] for f in held])
                continue
            form = "spm" if h4 % 100 < spm_rate else "psm"
            parts = split(held, n, chars, *sorted((h1 % (n + 1), h2 % (n + 1))))
            forms.append(form)
            prefix.append(parts[0].chars)
            middle.append(parts[1].chars)
            output.append(output_frames(form, parts))
        return forms, prefix, middle, output

    return add_columns(stored, ["doc_id", "n", "chars", "marked", "frames"], run,
                       "form string, prefix_chars long, middle_chars long, output array<binary>", keep=["doc_id", "n"])


def output_texts(transformed: DataFrame) -> DataFrame:
    """``doc_id, form, text``: the output as text, for texts that a row can hold."""
    return add_columns(transformed, ["output"], lambda rows: ([b"".join(stream(x)).decode("utf-8", "replace") for x in rows],), "text string", keep=["doc_id", "form"])


def with_digests(transformed: DataFrame) -> DataFrame:
    """``output_sha256`` of the streamed output and ``restored_sha256`` of the text rebuilt from it, beside the other columns."""

    def run(forms: list[str], output: list[list[bytes]]) -> tuple:
        return [digest(stream(x)) for x in output], [digest(restore(f, x)) for f, x in zip(forms, output)]

    return add_columns(transformed, ["form", "output"], run, "output_sha256 string, restored_sha256 string",
                       keep=["doc_id", "n", "form", "prefix_chars", "middle_chars"])


def fill_in_middle(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` per row.

    The frames are stored as Parquet below ``path`` (a new folder beside the checkpoints, if not given; remove it when it
    is no longer wanted), then transformed from there. Null and empty texts give a plain, empty output; repeated rows and
    null ids are treated row by row; an empty table gives no rows; other columns are ignored.
    """
    path = path or shared_folder(docs.sparkSession, f"frames-{uuid.uuid4().hex}")
    store_frames(docs).write.option("compression", "uncompressed").parquet(path)
    return with_digests(transform_frames(docs.sparkSession.read.parquet(path)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir))


ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k::INTEGER + 1, 8))::BIGINT) AS r FROM units),
cut AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
              WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
