"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import add_columns, checkpointed, columns_of, documents, unused_name, whole_text

KINDS = ("email", "ip", "card", "phone", "term")
# The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")

#: Words on either side of an entity that count as its context.
CONTEXT_WORDS = 8
#: Different texts in which a term must stand near an entity.
LEAST_SUPPORT = 3
#: Share of the entity's information that a term must reveal to be generalised, and to be removed.
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
#: Revealing terms are applied in blocks of so many.
BLOCK_TERMS = 200_000

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in found.split(".")))
    digits = "".join(DIGIT.findall(found))
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


#: The pattern of addresses without its retries: a match begins with a whole run of digits, so no start within one is tried.
WHOLE_RUNS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")


def _matches(kind: str, text: str) -> Iterator[re.Match]:
    """Leftmost non-overlapping matches in linear time; e-mail search starts only at runs that reach an at sign."""
    if kind != "email":
        yield from (WHOLE_RUNS if kind == "ip" else PATTERNS[kind]).finditer(text)
        return
    at = 0
    while (sign := text.find("@", at)) >= 0:
        start = sign
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        m = PATTERNS["email"].match(text, start) if start < sign else None
        if m:
            yield m
        at = m.end() if m else sign + 1


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` of all valid base matches, by start, then in the order of the kinds."""
    spans: list[Span] = []
    for kind in KINDS[:4]:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        spans += [(m.start(), m.end(), kind) for m in _matches(kind, text) if _valid(kind, m[0])]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def entity(kind: str, found: str) -> str:
    """The protected value behind a span, without its spelling: numbers by digits, addresses in lower case."""
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else ''.join(DIGIT.findall(found))}"


def contexts(text: str, spans: list[Span]) -> set[tuple[str, str]]:
    """``(entity, term)`` for the words next to each entity, outside all spans."""
    if not spans:
        return set()
    covered = [(a, b) for a, b, _ in spans]
    words = [(m.start(), m[0].lower()) for m in TERM.finditer(text) if not any(a < m.end() and m.start() < b for a, b in covered)] \
        if len(spans) < 20 else _outside(text, covered)
    places = [p for p, _ in words]
    found = set()
    for a, b, kind in spans:
        k = bisect_right(places, a)
        found |= {(entity(kind, text[a:b]), w) for _, w in words[max(0, k - CONTEXT_WORDS):k + CONTEXT_WORDS]}
    return found


def _outside(text: str, covered: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """Words that no span touches, in one sweep."""
    ends, reach = [a for a, _ in covered], []
    for _, b in covered:
        reach.append(max(b, reach[-1] if reach else 0))
    out = []
    for m in TERM.finditer(text):
        k = bisect_right(ends, m.end() - 1)
        if not k or reach[k - 1] <= m.start():
            out.append((m.start(), m[0].lower()))
    return out


def revealing_terms(docs: DataFrame) -> DataFrame:
    """``term, disclosure, action, reveals``: terms that reveal a protected entity of the corpus, and of which kind.

    A term's disclosure of an entity is their pointwise mutual information over all documents as a share of
    the entity's information content, ``log(c N / (n_t n_e)) / log(N / n_e)``: 1 when the term never occurs
    without the entity. ``c`` counts documents with the term within eight words of the entity, in at least three
    different texts, so copies of one text reveal nothing. Terms at 0.8 or more are generalised, at 0.95 or more
    removed. Documents without entities carry only their word counts; no text is shuffled.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, digest in zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist()):
                spans = base_spans(text)
                if spans:
                    pairs = sorted(contexts(text, spans))
                    names = sorted({entity(k, text[a:b]) for a, b, k in spans})
                    rows.append({"digest": digest, "entities": names, "pairs": [{"entity": e, "term": w} for e, w in pairs]})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    schema = StructType.fromDDL("digest long, entities array<string>, pairs array<struct<entity: string, term: string>>")
    arrow = to_arrow_schema(schema)
    text = docs.select(whole_text().alias("text")).withColumn("digest", F.xxhash64("text"))
    held = checkpointed(text.mapInArrow(near, schema))
    n = float(docs.count())
    per_entity = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    per_pair = (held.select("digest", F.explode("pairs").alias("p")).select("digest", "p.entity", "p.term")
                .groupBy("entity", "term", "digest").agg(F.count(F.lit(1)).alias("k"))
                .groupBy("entity", "term").agg(F.sum("k").alias("c"), F.count(F.lit(1)).alias("support")))
    near_docs = (held.select(F.explode(F.array_distinct(F.transform("pairs", lambda p: p["term"]))).alias("term"))
                 .groupBy("term").agg(F.count(F.lit(1)).alias("n_near")))

    def disclosure(n_t: str):
        share = F.log(F.col("c") * n / (F.col(n_t) * F.col("n_e"))) / F.log(F.lit(n) / F.col("n_e"))
        return F.when(F.col("n_e") < n, share).otherwise(F.lit(0.0))

    possible = checkpointed(per_pair.filter(F.col("support") >= LEAST_SUPPORT).join(per_entity, "entity").join(near_docs, "term")
                            .filter(disclosure("n_near") >= GENERALISE_AT))
    counts = term_counts(docs, possible.select("term").distinct())
    most = F.max(F.struct(F.col("d").alias("disclosure"), F.substring_index("entity", ":", 1).alias("reveals"))).alias("most")
    scored = possible.join(counts, "term").withColumn("d", disclosure("n_t")).groupBy("term").agg(most).select("term", "most.*")
    return scored.filter(F.col("disclosure") >= GENERALISE_AT).select(
        "term", "disclosure", F.when(F.col("disclosure") >= REMOVE_AT, "remove").otherwise("generalise").alias("action"), "reveals")


def blocks(terms: DataFrame, size: int = BLOCK_TERMS) -> Iterator[list]:
    """Rows of ``terms`` in blocks of bounded size, streamed to the driver partition by partition."""
    block: list = []
    for row in terms.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def term_counts(docs: DataFrame, terms: DataFrame, size: int = BLOCK_TERMS) -> DataFrame:
    """``term, n_t``: the number of documents that hold each term, over all whole texts.

    Each block of terms is one job whose counts are written before the next block is broadcast, so executors
    hold one block at a time.
    """
    spark, parts = docs.sparkSession, []
    for block in blocks(checkpointed(terms), size):
        wanted = spark.sparkContext.broadcast(frozenset(r.term for r in block))

        def count(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            total: Counter[str] = Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    total.update(wanted.value.intersection(TERM.findall(text.lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

        found = docs.select(whole_text().alias("text")).mapInArrow(count, "term string, n long")
        parts.append(checkpointed(found.groupBy("term").agg(F.sum("n").alias("n_t"))))
        wanted.destroy()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "term string, n_t long")


SPANS = "array<struct<start: int, end: int, kind: string, action: string, label: string>>"


def _marked(text: str, spans: list[dict], actions: dict[str, tuple[str, str]]) -> list[dict]:
    """``spans`` and the terms of ``actions`` that touch no base span, in order."""
    if not actions:
        return spans
    taken = [(x["start"], x["end"], x["kind"]) for x in spans if x["kind"] != "term"]
    words = _outside(text, [(a, b) for a, b, _ in taken]) if taken else [(m.start(), m[0].lower()) for m in TERM.finditer(text)]
    new = []
    for at, word in words:
        if word in actions:
            action, reveals = actions[word]
            new.append({"start": at, "end": at + len(TERM.match(text, at)[0]), "kind": "term", "action": action, "label": f"{reveals}-related".upper()})
    return sorted([*spans, *new], key=lambda x: (x["start"], KINDS.index(x["kind"]))) if new else spans


def find_personal_data(docs: DataFrame, terms: DataFrame | None = None, column: str = "pii", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """All columns of ``docs`` and ``column``, an array of ``(start, end, kind, action, label)`` in code points, per row.

    Base spans have the action ``mask``; ``terms`` (as from :func:`revealing_terms`, computed from ``docs`` if not
    given) add spans of kind ``term`` outside the base spans wherever such a term occurs. Null texts count as
    empty; empty texts have no spans. Ids may be null or repeated, equal texts get equal spans; an empty table stays
    empty. A column already of that name is replaced, as by ``withColumn``. Up to ``block_terms`` terms are applied
    in the pass that finds the base spans; each further block is one more job over the written result of the last,
    so that executors hold one block at a time.
    """
    spark, docs = docs.sparkSession, docs.drop(column)
    terms = checkpointed(revealing_terms(docs) if terms is None else terms)
    out, shared, done = docs, None, False
    for block in chain(blocks(terms, block_terms), [[]]):
        if done and not block:
            break
        if shared is not None:
            out = checkpointed(out)
            shared.destroy()
        shared = spark.sparkContext.broadcast({r.term: (r.action, r.reveals) for r in block})

        def first(texts: list[str | None], shared=shared) -> tuple[list]:
            found = []
            for text in texts:
                spans = [{"start": a, "end": b, "kind": k, "action": "mask", "label": k.upper()} for a, b, k in base_spans(text or "")]
                found.append(_marked(text or "", spans, shared.value))
            return (found,)

        def more(texts: list[str | None], spans: list[list[dict]], shared=shared) -> tuple[list]:
            return ([_marked(t or "", x, shared.value) for t, x in zip(texts, spans)],)

        if done:
            before = unused_name(docs) + column
            out = add_columns(out.withColumnRenamed(column, before), ["text", before], more, f"`{column}` {SPANS}", keep=docs.columns)
        else:
            out, done = add_columns(docs, ["text"], first, f"`{column}` {SPANS}"), True
    return out


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``docs`` with personal data masked by its kind and revealing terms generalised to what they relate to
    (``[EMAIL-RELATED]``) or removed. All columns are kept, whatever their names; null texts stay null."""

    def rewrite(texts: list[str | None], found: list[list[dict]]) -> tuple[list]:
        out = []
        for text, spans in zip(texts, found):
            parts, at = [], 0
            for x in spans if text is not None else ():
                if x["end"] > at:
                    parts += [text[at:max(at, x["start"])], "" if x["action"] == "remove" or x["start"] < at else f"[{x['label']}]"]
                    at = x["end"]
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return (out,)

    found = unused_name(docs)
    marked, clean = find_personal_data(docs, terms, found), found + "_"
    out = add_columns(marked, ["text", found], rewrite, f"`{clean}` string", keep=docs.columns)
    texts = dict(zip(docs.columns, columns_of(docs))) | {"text": F.col(clean)}
    return out.select(*(texts[c].alias(c) for c in docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("pii", lambda x: x["kind"] != "term")
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def _matches_sql(kind: str, pattern: str, keep: str) -> str:
    """``rid, kind, s, e, m``: matches of one kind with their places, which add up from the texts between them."""
    return f"""
SELECT rid, '{kind}' AS kind, s, s + length(m) AS e, m FROM (
  SELECT rid, m, (sum(length(b) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m))::BIGINT AS s FROM (
    SELECT rid, unnest(found) AS m, unnest(between[1:len(found)]) AS b, unnest(range(len(found))) AS i
    FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS between FROM docs))) WHERE {keep}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse({_DIGITS}), i + 1, 1)::INT "
         f"ELSE 2 * substr(reverse({_DIGITS}), i + 1, 1)::INT - CASE WHEN substr(reverse({_DIGITS}), i + 1, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0")
_IP = "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0"
_WORD = "[\\p{L}\\p{Nl}\\p{No}]{3,}"
_LISTED = "list_position(['email', 'ip', 'card', 'phone', 'term'], kind)"
#: The whole query in SQL: base spans, disclosure by co-occurrence, and the spans of terms that pass.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_matches_sql("email", PATTERNS["email"].pattern, "true")} UNION ALL {_matches_sql("ip", PATTERNS["ip"].pattern, _IP)}
  UNION ALL {_matches_sql("card", PATTERNS["card"].pattern.replace(chr(92) + "x20", " "), f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")}
  UNION ALL {_matches_sql("phone", PATTERNS["phone"].pattern.replace(chr(92) + "x20", " "), f"length({_DIGITS}) BETWEEN 10 AND 15")}),
words AS ({_matches_sql("term", _WORD, "true")}),
free AS (SELECT w.rid, w.s, w.e, lower(w.m) AS term FROM words w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s < w.e AND w.s < b.e)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY s) - 1 AS at FROM free WHERE rid IN (SELECT rid FROM base)),
entities AS (
  SELECT rid, CASE WHEN kind IN ('email', 'ip') THEN kind || ':' || lower(m) ELSE kind || ':' || {_DIGITS} END AS entity,
         (SELECT count(*) FROM numbered n WHERE n.rid = base.rid AND n.s <= base.s) AS k FROM base),
pairs AS (SELECT DISTINCT e.rid, e.entity, n.term FROM entities e JOIN numbered n ON n.rid = e.rid AND n.at >= e.k - {CONTEXT_WORDS} AND n.at < e.k + {CONTEXT_WORDS}),
counted AS (SELECT entity, term, count(*) AS c FROM pairs JOIN docs USING (rid) GROUP BY 1, 2 HAVING count(DISTINCT t) >= {LEAST_SUPPORT}),
held AS (SELECT rid, lower(m) AS term FROM words WHERE lower(m) IN (SELECT term FROM counted) GROUP BY 1, 2),
scored AS (
  SELECT term, max(ln(c * n / (n_t * n_e)) / ln(n / n_e)) AS d FROM counted
  JOIN (SELECT entity, count(DISTINCT rid) AS n_e FROM entities GROUP BY 1) USING (entity)
  JOIN (SELECT term, count(*) AS n_t FROM held GROUP BY 1) USING (term), (SELECT count(*)::DOUBLE AS n FROM docs) WHERE n_e < n GROUP BY 1),
spans AS (SELECT rid, kind, s, e FROM base UNION ALL SELECT rid, 'term', s, e FROM free WHERE term IN (SELECT term FROM scored WHERE d >= {GENERALISE_AT}))
SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
       count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {_LISTED}) FILTER (kind <> 'term'), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {_LISTED}) FILTER (kind IS NOT NULL), '') AS spans
FROM docs LEFT JOIN spans USING (rid) GROUP BY rid, doc_id
"""
