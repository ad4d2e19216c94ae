"""Ids beside nulls, beyond 2**53 and on repeated rows stay what they are in every operator and stage."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, exact_dedup, html_extract, langid, pieces, pii, rans, sharding, simhash, toxicity

BIG = 2**60
IDS = [BIG + 1, None, BIG + 3, 7, 7, None, -BIG - 1, BIG + 5, None]
EN = "the quick brown fox jumps over the lazy dog and runs through the green wood with them number "
TEXTS = [EN + "one", EN + "two", None, "", EN + "four five six", EN + "two", "a@b.cd " + EN, EN + "ONE", None]
OPERATORS = {
    "op1": lambda s, d: simhash.near_duplicates(d),
    "op2": lambda s, d: toxicity.score(d, toxicity.fit(["vile x", "w y"] * 10, __import__("numpy").array([1, 0] * 10), langid.train(d))),
    "op3": lambda s, d: pii.find_personal_data(d),
    "op3 sanitise": lambda s, d: pii.sanitise(d),
    "op4": lambda s, d: langid.identify(d, langid.train(d)),
    "op6": lambda s, d: exact_dedup.exact_dedup(d),
    "op7": lambda s, d: pieces.encode_pieces(d, pieces.default_model()),
    "op7 decode": lambda s, d: pieces.decode_pieces(pieces.encode_pieces(d, pieces.default_model()), pieces.default_model()),
    "op8": lambda s, d: sharding.shard_documents(d),
    "op9": lambda s, d: decontaminate.find_leaks(d, s.createDataFrame([(None, EN + "four")], "item_id long, text string")),
}


@pytest.fixture
def mixed(docs):
    return docs(*zip(IDS, TEXTS), extra=["row", "key", "kept", "unclear", "t", "stays", "n", "pii", "fp"]).coalesce(1)


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_ids(spark, mixed, name):
    assert Counter(r.doc_id for r in OPERATORS[name](spark, mixed).collect()) == Counter(IDS)


def test_token_files_keep_ids(spark, mixed, tmp_path):
    rans.write_token_files(mixed, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "f"), files=2)
    rows = sorted(rans.read_token_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(IDS, key=lambda i: (i is not None, i or 0))


def test_pages_keep_ids(spark):
    pages = spark.createDataFrame([(i, "http://h.example/", "<p>text</p>") for i in IDS], "page_id long, url string, html string").coalesce(1)
    assert Counter(r.page_id for r in html_extract.extract_pages(pages).collect()) == Counter(IDS)


def test_pages_of_hosts_beyond_the_broadcast(spark):
    rows = [(i, f"http://h{i % 7}.example/", f"<body><div class=c{i % 7}><p>text {i}</p></div></body>") for i in range(60)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(html_extract.extract_pages(pages).collect(), key=str)
    assert sorted(html_extract.extract_pages(pages, broadcast_hosts=2).collect(), key=str) == want and len(want) == 61


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_duplicates_with_null_and_repeated_ids(mixed):
    kept = exact_dedup.drop_exact_duplicates(mixed)
    assert kept.columns == mixed.columns
    # Of equal texts the largest id stays, nulls rank lowest, of equal rows one stays.
    assert sorted(((r.doc_id, low(r.text)) for r in kept.collect()), key=str) == sorted(
        [(BIG + 5, low(EN) + "one"), (None, low(EN) + "two"), (BIG + 3, ""), (7, low(EN) + "four five six"), (-BIG - 1, "a@b.cd " + low(EN))], key=str)


def near_by_brute_force(rows):
    """Rows that stay by the stated rule: per group the smallest id (nulls last), then the smallest fingerprint."""
    fp = [simhash.fingerprint(low(t)) for _, t in rows]
    signed = [f - 2**64 if f >= 2**63 else f for f in fp]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if bin(fp[a] ^ fp[b]).count("1") <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    out = Counter()
    for g in set(group):
        best = min(((rows[k][0] is None, rows[k][0] or 0, signed[k]), k) for k in range(len(rows)) if group[k] == g)[1]
        out[rows[best][0], simhash.fingerprint(low(rows[best][1]))] += 1
    return out


def test_near_duplicates_with_null_and_repeated_ids(docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(6)]
    rows = []
    for _ in range(60):
        text = rng.choice(base) + rng.choice(["", "", " tail", " w1 w2"])
        rows.append((rng.choice([None, None, 1, 2, BIG + 1, BIG + 3, rng.randrange(100, 130)]), text))
    rows += [(900, None), (901, ""), (None, "alone without an id"), (950, "alone"), (950, "also alone but repeated")]
    table = docs(*rows, extra=["row", "key", "kept", "t"])
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert Counter((r.doc_id, simhash.fingerprint(low(r.text))) for r in kept.collect()) == near_by_brute_force(rows)


def test_stages_keep_ids_and_clashing_columns(spark, sf, mixed):
    docs = mixed
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        have = Counter((r.doc_id, r.text) for r in docs.collect())
        rows = out.collect()
        assert all(have[k] >= n for k, n in Counter((r.doc_id, r.text) for r in rows).items()), name
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in last) == Counter(IDS)


def test_hot_fingerprint_is_settled_in_place(docs, monkeypatch):
    """Rows of a fingerprint over the share are joined by broadcast; results do not depend on the share."""
    table = docs(*["hot words of boilerplate"] * 200, *[f"other words number {i} of {i * i}" for i in range(100)])
    want = Counter(map(tuple, simhash.near_duplicates(table).collect()))
    monkeypatch.setattr(simhash, "HEAVY", 4)
    assert Counter(map(tuple, simhash.near_duplicates(table).collect())) == want


def test_long_digit_runs():
    for text in ["0" * 5000 + ".1.1.1", "1" * 20_000 + ".1.1.1", "4" * 30_000, "+" + "1" * 20_000, "9" * 20_000 + "@a.b", "0" * 4400 + "12.0.0.256 1.2.3.4.5.6.7.8"]:
        naive = []
        for kind, pattern in pii.PATTERNS.items():
            if kind == "ip" and len(text) > 10_000:
                continue  # the stated pattern itself takes quadratic time here
            naive += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if pii._valid(kind, m[0])]
        got = [x for x in pii.base_spans(text) if len(text) <= 10_000 or x[2] != "ip"]
        assert sorted(got) == sorted(naive), text[:20]
    assert (0, 5006, "ip") in pii.base_spans("0" * 5000 + ".1.1.1") and pii.base_spans("7" * 300_000) == []


def test_one_broadcast_at_a_time(spark, docs, monkeypatch):
    """A benchmark and a term list of three blocks give what one block gives, and earlier blocks are released."""
    from pyspark.core.broadcast import Broadcast

    released = []
    destroy = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (released.append(1), destroy(self, *a)))
    items = spark.createDataFrame([(k, f"item number {k} says that " + EN * 2) for k in range(6)], "item_id long, text string")
    table = docs(EN * 3, "nothing here", None, *[f"x item number {k} says that {EN * 2}" for k in range(6)])
    one = decontaminate.find_leaks(table, items).collect()
    assert not released
    many = decontaminate.find_leaks(table, items, block_chars=400).collect()
    assert len(released) == 2
    for a, b in zip(sorted(one, key=lambda r: r.doc_id), sorted(many, key=lambda r: r.doc_id)):
        assert [(x.item_id, x.edits) for x in a.leaks] == [(x.item_id, x.edits) for x in sorted(b.leaks, key=lambda x: x.item_id)]
    terms = spark.createDataFrame([(w, 1.0, "remove", "email") for w in ("quick", "brown", "item")], "term string, disclosure double, action string, reveals string")
    whole = {r.doc_id: r.pii for r in pii.find_personal_data(table, terms).collect()}
    assert {r.doc_id: r.pii for r in pii.find_personal_data(table, terms, block_terms=1).collect()} == whole and whole[0]
    counts = {r.term: r.n_t for r in pii.term_counts(table, terms.select("term"), size=1).collect()}
    assert counts == {"quick": 7, "brown": 7, "item": 6}


def test_shared_passages_are_searched_once():
    """Items that repeat one passage share its windows; every one of them is still reported."""
    passage = " ".join(f"word{i}" for i in range(60))
    items = [(k, f"question {k} about {k * 7}: {passage} answer {k}") for k in range(50)] + [(99, passage), (None, passage[:100])]
    index = decontaminate.build_index(items)
    assert sum(map(len, index[0].stretches)) < 50 * 250 + 700 < sum(len(t) for _, t in items)
    found = decontaminate.search(index, ["before it " + passage + " after it", f"question 7 about 49: {passage[:70]}"])
    assert {r[0] for r in found[0]} == {k for k, _ in items} and 7 in {r[0] for r in found[1]}


def test_passages_and_members_hold_every_link(spark, docs):
    """Passages of a document, expanded by their members, are its items; one passage in many items stays one entry a document."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, other = say(40), say(30)
    items = [(k, f"{say(12)} {shared} {say(12)}") for k in range(40)] + [(k, f"{other} {say(20)} {shared[:90]}") for k in range(40, 60)]
    items += [(70, "tiny thing"), (71, "tiny thing"), (None, shared), (72, None), (73, ""), (74, "abcdefghijklmnopqrstu"), (76, other), (75, say(3))]
    texts = [f"{say(20)} {shared} {say(20)}", f"{say(9)} {other}", f"{shared} and {other}", "a Tiny  thing", "see abcdefghijXlmnopqrstu here", items[3][1], items[41][1][40:], "nothing", "", None] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs(*texts, extra=["passages", "n_items"])
    want = {r.doc_id: sorted({x.item_id for x in r.leaks}, key=lambda i: (i is None, i)) for r in decontaminate.find_leaks(table, bench).collect()}
    least = {r.doc_id: min((x.edits for x in r.leaks), default=None) for r in decontaminate.find_leaks(table, bench).collect()}
    for block in (decontaminate.BLOCK_CHARS, 2_000):
        members = {}
        for r in decontaminate.passage_members(bench, block).collect():
            members.setdefault(r.passage, []).append(r.item_id)
        assert sorted(members) == list(range(len(members)))
        found = decontaminate.find_passages(table, bench, block_chars=block).collect()
        for r in found:
            linked = {i for p in r.passages for i in members[p.passage]}
            assert sorted(linked, key=lambda i: (i is None, i)) == want[r.doc_id], r.doc_id
            assert all(p.item_id == members[p.passage][0] for p in r.passages)
            assert min((p.edits for p in r.passages), default=None) == least[r.doc_id]
            assert r.n_items == len(linked)
    whole = {r.doc_id: r for r in decontaminate.find_passages(table, bench).collect()}
    assert len(want[0]) > 55 and len(whole[0].passages) < 10


def test_passages_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.passage_members(none).count() == 0
    assert [(r.passages, r.n_items) for r in decontaminate.find_passages(docs("a", None), none).collect()] == [([], 0)] * 2
    blank = spark.createDataFrame([(1, None), (2, " ")], "item_id long, text string")
    assert decontaminate.passage_members(blank).count() == 0


def test_many_postings_in_groups(monkeypatch):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta"]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) + items[3][1] for _ in range(4)]
    index = decontaminate.build_index(items)
    want = decontaminate.search(index, texts)
    monkeypatch.setattr(decontaminate, "MAX_PAIRS", 500)
    assert decontaminate.search(index, texts) == want and want[0]


def test_stages_keep_columns_of_any_name(spark, docs):
    """Dots, quotes and names that the stages use themselves."""
    odd = docs(*zip(IDS, TEXTS), extra=["row"]).withColumns({"a.b": F.lit("dot"), "c`d": F.lit("quote"), "x": F.lit("x")})
    bench = spark.createDataFrame([(1, EN + "four")], "item_id long, text string")
    model = langid.train(odd)
    stages = (langid.keep_identified, exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, lambda d: decontaminate.drop_leaks(d, bench), pii.sanitise)
    for stage in stages:
        out = stage(odd)
        assert out.columns == odd.columns and {r["a.b"] for r in out.collect()} <= {"dot"}
    assert model.languages == ["en"]


def test_numerals_are_no_letters(docs):
    model = langid.train(docs(EN, EN))
    assert langid.classify(model, ["½ ² ① Ⅷ", "123", "́", "ª", "a"])[0].tolist() == [-1, -1, -1, 0, 0]


HOT = [(5, f"w{k % 3}") for k in range(1400)] + [(None, "same text")] * 1400 + [(1000 + k, f"t{k}") for k in range(1400)]


def test_hot_ids_are_dealt_to_many_slots(docs, monkeypatch):
    """A third of the rows under one id, and a third without one."""
    monkeypatch.setattr(sharding, "HOT_ROWS", 100)
    rows = sharding.shard_documents(docs(*HOT).repartition(3)).collect()
    assert max(Counter(r.virtual_slot for r in rows).values()) < 60
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values())
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(t) + 1) for i, t in HOT)


def test_hot_ids_are_dealt_to_many_files(spark, docs, tmp_path):
    path = str(tmp_path / "f")
    rans.write_token_files(docs(*HOT).repartition(3), public_tokenizers.path("byte_bpe_50k.json"), path, files=12)
    files = spark.read.parquet(f"{path}/segments").select("file_no", F.size("doc_ids").alias("n")).groupBy("file_no").agg(F.sum("n").alias("n")).collect()
    assert len(files) >= 12 and max(r.n for r in files) < 700
    rows = sorted(rans.read_token_files(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted((i for i, _ in HOT), key=lambda i: (i is not None, i or 0)) and Counter(ids) == Counter(i for i, _ in HOT)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:])) and rows[0].start == 0
