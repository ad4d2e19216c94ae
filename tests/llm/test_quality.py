"""Quality rules: counts against plain Python, the order of the cascade, labelled texts."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    repeat = len({i + d for i, x in enumerate(windows) if x in often for d in range(3)})
    counts = len(w), len("".join(w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    letter = re.compile(r"[A-Za-z]|[^\x00-\x7F]")
    bad = (10 * counts[2] > len(w), sum("A" <= c <= "Z" for c in text) > sum("a" <= c <= "z" for c in text), 5 * text.count("!") > len(w),
           5 * sum("0" <= c <= "9" for c in text) > counts[1], not 2 * len(w) <= counts[1] <= 12 * len(w), 2 * counts[3] > len(lines),
           5 * sum(not letter.search(x) for x in w) > len(w))
    return (*counts, failed, not failed and not any(bad))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB1#é€ \n\t\v!\u0085"), max_size=120), st.integers(1, 20))
def test_counts_equal_plain_python(text, split):
    before, quality.SPLIT_BYTES = quality.SPLIT_BYTES, split
    try:
        t = quality.Text(text.encode())
        got = t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words
    finally:
        quality.SPLIT_BYTES = before
    want = plain(text)
    assert got == want[:5]
    assert want[5] == any(quality.RULES[r](t) for r in quality.BASE)
    assert want[6] == quality.passes(t, list(quality.RULES))


def test_many_different_words():
    words = [f"{k}" for k in range(1 << 21)] + ["a", "b", "c", "d", "a", "b", "c"]
    assert quality.Text(" ".join(words).encode()).n_repeat_words == 6


GOOD = "The river ran past {} old mills and the people of the valley worked there until the last one closed its doors in spring "


def good(k):
    return " ".join(f"{w}{'abcdefgh'[(k * 7 + i) % 8]}{'ijklmnop'[(i * 5) % 8]}" for i, w in enumerate((GOOD * 3).split()))


def test_edge_rows(docs):
    rows = [(1, None), (1, None), (None, ""), (2, " \n\t"), (3, good(1)), (3, good(2)), (None, good(3)), (4, "word " * 40_000), (5, good(4).upper()),
            (6, good(5) + " #" * 40), (7, "x" * 300_000), (8, "!" * 60), (9, "7 " * 60)]
    table = docs(*rows, extra=["n_words", "kept", "a.b", "x"])
    got = sorted((tuple(r) for r in quality.measure(table).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in rows if plain(t)[6]), key=str)
    assert quality.measure(table.limit(0)).count() == 0 == quality.keep_good(table.limit(0)).count()


def test_order_is_by_rejections_per_cost(docs):
    table = docs(*[(k, "SHOUT " * 60) for k in range(30)], *[(k, good(k)) for k in range(30, 60)])
    found = quality.estimates(table)
    assert set(found) == set(quality.RULES) and all(n == 60 for n, _, _ in found.values())
    assert found["capitals"][1] == 30 and found["short"][1] == 0 and all(ns > 0 for _, _, ns in found.values())
    order = quality.cascade(found)
    rates = [found[r][1] / found[r][2] for r in order]
    assert rates == sorted(rates, reverse=True) and set(order) == set(quality.RULES)
    assert quality.cascade({"b": (9, 3, 10), "a": (9, 6, 100), "c": (9, 0, 1)}, ["a", "c", "b", "d"]) == ["b", "a", "c", "d"]


def test_later_rules_are_not_asked(monkeypatch):
    asked = []
    for name in ("one", "two", "three"):
        monkeypatch.setitem(quality.RULES, name, lambda t, name=name: asked.append(name) or name == "two")
    assert not quality.passes(quality.Text(b""), ["one", "two", "three"]) and asked == ["one", "two"]


@pytest.mark.parametrize("order", [list(quality.RULES), list(quality.RULES)[::-1]])
def test_labelled_texts(spark, sf, order):
    """Most bad texts go, and good ones of 50 words or more stay, in any order."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("text", "quality").collect()
    texts = [(quality.Text((r.text or "").encode()), r.quality) for r in rows]
    good = [quality.passes(t, order) for t, q in texts if q == 1 and t.n_words >= 50]
    bad = [quality.passes(t, order) for t, q in texts if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)
