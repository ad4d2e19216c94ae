"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, documents, unused_name, whole_text

#: Bound of the sample that costs and selectivities are estimated on, in rows (expected).
SAMPLE_ROWS = 2_000
SAMPLE_SEED = 13
#: Bytes of a text that are split into word objects at once.
SPLIT_BYTES = 1 << 20

# Classes of bytes (UTF-8).
SPACES = bytes([32, *range(9, 14)])
CONTINUED = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: Everything in words but letters; bytes of other scripts count as letters.
NO_LETTERS = bytes(b for b in range(128) if b not in UPPER + LOWER + SPACES)

_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False


def without(text: bytes, dropped: bytes) -> int:
    return len(text) - len(text.translate(None, dropped))


def word_count(text: bytes) -> int:
    inside = _WORD[np.frombuffer(text, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])


@dataclass
class Text:
    """One whole text (UTF-8), and what rules ask of it, each computed when it is first asked for."""

    raw: bytes

    @cached_property
    def n_words(self) -> int:
        return word_count(self.raw)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.raw.translate(None, SPACES + CONTINUED))

    @cached_property
    def n_symbols(self) -> int:
        return without(self.raw, SYMBOLS)

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and how many of them equal an earlier one."""
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return len(lines), len(lines) - len(set(lines))

    @cached_property
    def word_numbers(self) -> np.ndarray:
        """A number for each word, the same for equal words. Word objects are made a stretch at a time."""
        index: defaultdict[bytes, int] = defaultdict(count().__next__)
        numbers, at = array("q"), 0
        while at < len(self.raw):
            end = min(len(self.raw), at + SPLIT_BYTES)
            while end < len(self.raw) and self.raw[end] not in SPACES:
                end += 1
            numbers.extend(map(index.__getitem__, self.raw[at:end].split()))
            at = end
        return np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words which the text holds twice or more."""
        number = self.word_numbers
        if len(number) < 4:
            return 0
        base = int(number.max()) + 1
        pair = number[:-1] * base + number[1:]
        if base >= 1 << 21:  # three numbers do not fit into 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * base + number[2:]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        again = np.zeros(len(window), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        covered = np.zeros(len(number), bool)
        for k in range(3):
            covered[k:k + len(window)] |= again
        return int(np.count_nonzero(covered))


#: The rules: whether a text is rejected. Their verdicts do not depend on each other, so any order keeps the same texts.
RULES: dict[str, Callable[[Text], bool]] = {
    "short": lambda t: t.n_words < 50,
    "repetitive": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "capitals": lambda t: without(t.raw, UPPER) > without(t.raw, LOWER),
    "shouting": lambda t: 5 * t.raw.count(b"!") > t.n_words,
    "digits": lambda t: 5 * without(t.raw, DIGITS) > t.word_chars,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 12 * t.n_words,
    "repeated_lines": lambda t: 2 * t.lines[1] > t.lines[0],
    "few_letters": lambda t: 5 * (t.n_words - word_count(t.raw.translate(None, NO_LETTERS))) > t.n_words,
}
BASE = ("short", "repetitive")


def estimates(docs: DataFrame, rules: Sequence[str] = tuple(RULES), sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[int, int, int]]:
    """``rows, rejected, nanoseconds`` of each rule over a sample of about ``sample_rows`` rows.

    Every rule meets every sampled text afresh, so its cost is what it takes when it is the first to be asked. Tasks add
    up their own rows; the driver receives one row per rule.
    """
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = docs.select(whole_text().cast("binary").alias("t")).sample(share, SAMPLE_SEED)
    names = list(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, {name: [0, 0] for name in names}
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows += 1
                for name in names:
                    begun = time.perf_counter_ns()
                    sums[name][0] += RULES[name](Text(raw))
                    sums[name][1] += time.perf_counter_ns() - begun
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([rows] * len(names)), *(pa.array([sums[n][k] for n in names]) for k in (0, 1))],
                                         ["rule", "n", "rejected", "ns"])

    found = sample.mapInArrow(measure, "rule string, n long, rejected long, ns long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("n", "rejected", "ns")))
    return {r.rule: (r.n, r.rejected, r.ns) for r in found.collect()}


def cascade(found: dict[str, tuple[int, int, int]], rules: Sequence[str] = tuple(RULES)) -> list[str]:
    """The rules with the most rejections per cost first (ties, and rules not met: as listed)."""
    rate = {name: found[name][1] / max(found[name][2], 1) if name in found else 0.0 for name in rules}
    return sorted(rules, key=lambda name: -rate[name])


def passes(text: Text, order: Sequence[str]) -> bool:
    """Whether no rule rejects the text; rules after the first that does are not asked."""
    return not any(RULES[name](text) for name in order)


def keep_good(docs: DataFrame, rules: Sequence[str] = tuple(RULES)) -> DataFrame:
    """``docs``, all columns kept, without the rows whose text any of ``rules`` rejects.

    Only the order of the rules comes from the sample, so the same rows stay whatever the sample or the clock says. Null texts
    count as empty and go with the rule ``short``; repeated rows and null ids stay or go like any other; an empty
    table stays empty.
    """
    order, kept = cascade(estimates(docs, rules), rules), unused_name(docs)
    out = add_columns(docs, ["text"], lambda texts: ([passes(Text((t or "").encode("utf-8", "surrogatepass")), order) for t in texts],), f"{kept} boolean")
    return out.filter(F.col(kept)).drop(kept)


def measure(docs: DataFrame, rules: Sequence[str] = tuple(RULES)) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` per row.

    The counts are taken of every text, and reused by the rules. ``base_failed`` is the verdict of the rules ``short`` and
    ``repetitive``; a text that passes them is kept if the cascade of the other rules lets it pass. Null texts count as empty;
    an empty table gives no rows; other columns are ignored.
    """
    others = [r for r in rules if r not in BASE]
    order = cascade(estimates(docs, others), others)

    def run(texts: list[bytes]) -> tuple:
        out = []
        for raw in texts:
            t = Text(raw)
            failed = any(RULES[name](t) for name in BASE)
            out.append((t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words, failed, not failed and passes(t, order)))
        return tuple(zip(*out)) or ((),) * 7

    source = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    return add_columns(source, ["text"], run, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean", keep=["doc_id"])


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))


ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
worded AS MATERIALIZED (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (SELECT n, i, unnest(list_transform(range(1, len(w) - 1), lambda k: [w[k], w[k + 1], w[k + 2]])) AS x, unnest(range(1, len(w) - 1)) AS k FROM worded, range(1) r(i)),
repeated AS (SELECT n, k FROM (SELECT n, k, count(*) OVER (PARTITION BY n, x) AS m FROM windows) WHERE m > 1),
covered AS (SELECT n, count(DISTINCT k + d) AS n_repeat_words FROM repeated, range(3) s(d) GROUP BY n),
counted AS (
  SELECT n, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower_,
         length(regexp_replace(t, '[^!]', '', 'g')) AS marks, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS unlettered
  FROM worded),
judged AS (
  SELECT *, coalesce(n_repeat_words, 0)::BIGINT AS repeats, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM counted LEFT JOIN covered USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, repeats AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR upper_ > lower_ OR 5 * marks > n_words OR 5 * digits > word_chars
            OR word_chars NOT BETWEEN 2 * n_words AND 12 * n_words OR 2 * n_dup_lines > n_lines OR 5 * unlettered > n_words) AS kept
FROM judged
"""
