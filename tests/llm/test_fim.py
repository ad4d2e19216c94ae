"""Fill-in-middle: frames against plain string cutting, restoring, edge cases."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The contract on a plain string."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        form, out = "plain", text
    elif h4 % 100 < 80:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, n, form, *sizes, sha(out), sha(text))


TEXTS = st.text(st.sampled_from(" \t\n\v\rabé€𝄞<PSM> \u0085"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9), st.data())
def test_frames_equal_plain_cutting(text, frame_bytes, data):
    frames, n, chars = fim.pack(text.encode(), frame_bytes)
    units = UNIT.findall(text)
    assert (n, chars) == (len(units), len(text)) and b"".join(fim.stream([f["frame"] for f in frames])) == text.encode()
    a, b = sorted((data.draw(st.integers(0, n)), data.draw(st.integers(0, n))))
    parts = fim.split(frames, n, chars, a, b)
    want = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    assert [b"".join(fim.stream(p.frames)).decode() for p in parts] == list(want)
    assert [p.chars for p in parts] == [len(w) for w in want]
    if not any(m in text for m in ("<P>", "<S>", "<M>")):
        for form in ("plain", "psm", "spm"):
            assert b"".join(fim.restore(form, fim.output_frames(form, parts))).decode() == text


def test_marks_across_frames():
    frames = [fim.pack(x.encode())[0][0]["frame"] for x in ("ab<", "S", ">x<P", ">y<M>")]
    assert fim.find_marks(frames) == {b"<S>": 2, b"<P>": 6, b"<M>": 10}


@pytest.mark.parametrize("frame_bytes", [5, fim.FRAME_BYTES])
def test_query_equals_plain_cutting(spark, docs, frame_bytes):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(" \nab€<M>") for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(7, None), (None, "a b c"), (None, None), (8, ""), (9, "  "), (10, "<P> a"), (11, "word " * 50_000), (11, "word " * 50_000), (12, "x" * 700_000)]
    stored = fim.store_frames(docs(*rows, extra=["frames", "n", "output", "a.b"]), frame_bytes if frame_bytes > 5 else 4099)
    got = fim.with_digests(fim.transform_frames(stored)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain(*r) for r in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_output_texts_and_empty_table(spark, docs):
    d = docs((1, "one two three"), (3, "four five"), (5, "six seven eight nine"), (4, "ten eleven"))
    out = fim.output_texts(fim.transform_frames(fim.store_frames(d)))
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == plain(r.doc_id, t)[5] for r in out.collect() for i, t in ((x.doc_id, x.text) for x in d.collect()) if i == r.doc_id)
    assert fim.fill_in_middle(d.limit(0)).count() == 0
