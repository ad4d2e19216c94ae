import numpy as np

import corpus_pipeline
from test_dedup import plain_simhash


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(text):
    """Latin letters in lower case and white space as single spaces, trimmed."""
    out = ""
    for c in text:
        c = " " if c in " \t\n\v\f\r\xa0" else chr(ord(c) + 32) if "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c
        out += "" if c == " " and out.endswith(" ") else c
    return out.strip(" ")


def edits_within(window, doc):
    """Least edits with which the window occurs anywhere in the document."""
    d = np.frombuffer(doc.encode("utf-32-le"), np.uint32)
    cost, steps = np.zeros(len(d) + 1, np.int64), np.arange(len(d) + 1)
    for i, c in enumerate(window, 1):
        step = np.concatenate([[i], np.minimum(cost[:-1] + (d != ord(c)), cost[1:] + 1)])
        cost = np.minimum.accumulate(step - steps) + steps
    return int(cost.min())


def leaks(items, doc):
    """By pigeonhole: a window with k edits shares one of k + 1 pieces with the document; only such windows are aligned."""
    doc, pieces = plain(doc), {}
    for item in items:
        w = min(len(item), 80)
        k = w // 20
        size = w // (k + 1)
        if size not in pieces:
            pieces[size] = {doc[i:i + size] for i in range(len(doc) - size + 1)}
        for s in range(len(item) - w + 1):
            window = item[s:s + w]
            if any(window[j * size:(j + 1) * size] in pieces[size] for j in range(k + 1)) and edits_within(window, doc) <= k:
                return True
    return False


def brute(rows, benchmark):
    """The pipeline's rules on plain lists, with nothing of the library; every language here is clear, so only texts without letters are rejected."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {}
    for i, t in rows:
        last[low(t)] = max(i, last.get(low(t), i))
    rows = [(i, t) for i, t in rows if i in last.values()]
    fp = {i: plain_simhash(low(t)) for i, t in rows}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    items = [p for _, t in benchmark if t and (p := plain(t))]
    return [(i, t) for i, t in rows if find(i) == i and not leaks(items, t)]


def test_pipeline_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, sf).collect()
    want = brute(rows, bench)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in want) and len(want) < len(rows)
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got)


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
