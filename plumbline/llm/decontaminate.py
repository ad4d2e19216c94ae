"""Benchmark decontamination: q-gram lemma filter on diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, checkpointed, documents, table, unused_name
from .langid import chunks

Q = 12
#: Length of q-grams for items whose edit budget 12-grams cannot promise: those of 20 to 23 characters.
SHORT_Q = 8
#: A leak is a window of this many characters of an item (or a whole shorter item) ...
WINDOW = 80
#: ... found in a document with at most this share of edits.
EDIT_RATE = 0.05
#: Items are searched in blocks of so many characters, so the broadcast index stays bounded.
BLOCK_CHARS = 4_000_000
#: Pairs of document and item q-grams that are held at once.
MAX_PAIRS = 4_000_000
FILTER_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points with letters of Basic Latin and Latin-1 in lower case and white-space runs as one space,
    trimmed, and the position of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    upper = ((codes >= 65) & (codes <= 90)) | ((codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7))
    codes[upper] += 32
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0)
    codes[space] = 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    codes = codes[at]
    a, b = (1 if len(codes) and codes[0] == 32 else 0), (len(codes) - 1 if len(codes) > 1 and codes[-1] == 32 else len(codes))
    return codes[a:b], at[a:b]


def qgram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the 12 (or 8) code points from each position, by doubling: 2, 4, 8, then 8 and 4."""
    with np.errstate(over="ignore"):
        b1 = _BASE
        b2, b4 = b1 * b1, b1 * b1 * b1 * b1
        h1 = codes.astype(np.uint64) + np.uint64(1)
        h2 = h1[:-1] * b1 + h1[1:]
        h4 = h2[:-2] * b2 + h2[2:]
        h8 = h4[:-4] * b4 + h4[4:]
        h = h8 if q == SHORT_Q else h8[:-4] * b4 + h4[8:]
        return (h ^ (h >> np.uint64(31))) * _BASE


def window_keys(codes: np.ndarray) -> np.ndarray:
    """Two independent hashes of the 80 code points from each position, by doubling up to 64, then 64 and 16."""
    keys = np.zeros((max(0, len(codes) - WINDOW + 1), 2), np.uint64)
    for column, base in enumerate((_BASE, np.uint64(0xC2B2AE3D27D4EB4F))):
        with np.errstate(over="ignore"):
            power, h, size, by_size = base, codes.astype(np.uint64) + np.uint64(1), 1, {}
            while size < 64:
                h, size, power = h[:-size] * power + h[size:], 2 * size, power * power
                by_size[size] = h, power
            keys[:, column] = by_size[64][0][:len(keys)] * by_size[16][1] + by_size[16][0][64:]
    return keys


@dataclass
class Index:
    """A block of items. Windows with equal text form one class, and every class is searched once: its first
    occurrence stands in a stretch, a run of windows that no earlier item has. ``hashes`` are the sorted q-grams
    of the stretches with their postings, ``present`` is a bit filter before them. Windows of one stretch that the
    same items hold form a passage; ``passage_of`` tells it by class, ``members`` lists the items of each. A benchmark
    that repeats one passage in very many items is thus searched for it once, and a document with it notes it once."""

    ids: list
    short: list[tuple[np.ndarray, int]]
    stretches: list[np.ndarray]
    classes: list[np.ndarray]
    passage_of: np.ndarray
    member_first: np.ndarray
    members: np.ndarray
    base: int
    hashes: np.ndarray
    first: np.ndarray
    post_item: np.ndarray
    post_at: np.ndarray
    present: np.ndarray
    window: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    q: int

    @property
    def passages(self) -> int:
        return len(self.member_first) - 1

    def items_of(self, passage: int) -> np.ndarray:
        return self.members[self.member_first[passage]:self.member_first[passage + 1]]


def promise(length: int, q: int) -> int:
    """Common q-grams that the lemma promises of a window of an item of this length, with all edits it allows."""
    w = min(length, WINDOW)
    return w - q + 1 - int(w * EDIT_RATE) * q


def build_index(rows: list[tuple[int | None, str]], base: int = 0) -> list[Index]:
    """Indexes of ``(item_id, text)`` rows. Items without text are left out; passages are numbered from ``base``.

    With a window of ``w`` characters and ``k`` edits the q-gram lemma promises ``w - q + 1 - k * q`` common
    q-grams. Items of which 12-grams promise none though they allow an edit are kept in an index of 8-grams; items
    under 20 characters allow no edit, and those under ``Q`` characters are sought as they are.
    """
    items = [(i, normalise(t)[0]) for i, t in rows if t]
    items = [(i, c) for i, c in items if len(c)]
    small = [len(c) >= Q and promise(len(c), Q) < 1 for _, c in items]
    out = []
    for short, q in ((False, Q), (True, SHORT_Q)):
        if short in small or not short:
            out.append(_index([x for x, s in zip(items, small) if s == short], q, base))
            base += out[-1].passages
    return out


def _passages(classes: list[np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passage of each class, and the items of each passage (where each begins, items) from ``pairs`` of class and item.

    Two sums of 64-bit hashes stand for a set of items.
    """
    if not classes:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    key = np.zeros((int(pairs[-1, 0]) + 1, 3), np.uint64)
    key[np.concatenate(classes), 0] = np.repeat(np.arange(len(classes)), [len(c) for c in classes])
    begin = np.searchsorted(pairs[:, 0], np.arange(len(key) + 1))
    with np.errstate(over="ignore"):
        for column, seed in ((1, _BASE), (2, np.uint64(0xC2B2AE3D27D4EB4F))):
            h = (pairs[:, 1].astype(np.uint64) + np.uint64(1)) * seed
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            key[:, column] = np.add.reduceat(h ^ (h >> np.uint64(32)), begin[:-1])
    _, one, passage_of = np.unique(key.view("V24").reshape(-1), return_index=True, return_inverse=True)
    sizes = begin[one + 1] - begin[one]
    first = np.concatenate([[0], np.cumsum(sizes)])
    return passage_of.reshape(-1), first, pairs[np.arange(first[-1]) + np.repeat(begin[one] - first[:-1], sizes), 1]


def _index(items: list[tuple[int | None, np.ndarray]], q: int, base: int) -> Index:
    whole: dict[bytes, list[int]] = {}  # items of at most one window, by their text
    long = []
    for n, (_, c) in enumerate(items):
        if len(c) > WINDOW:
            long.append(n)
        else:
            whole.setdefault(c.tobytes(), []).append(n)
    short, stretches, classes, class_of, item_of = [], [], [], [], []
    for raw, ns in whole.items():
        codes = np.frombuffer(raw, np.uint32)
        if len(codes) < q:
            short.append((codes, ns))
            continue
        classes.append(np.array([len(stretches)]))
        stretches.append(codes)
        class_of.append(np.full(len(ns), len(stretches) - 1))
        item_of.append(np.array(ns))
    if long:
        keys = [window_keys(items[n][1]) for n in long]
        _, at_first, number = np.unique(np.concatenate(keys).view("V16").reshape(-1), return_index=True, return_inverse=True)
        number = number.reshape(-1) + len(stretches)
        fresh = np.zeros(len(number), bool)
        fresh[at_first] = True
        begin = 0
        for n, k in zip(long, keys):
            own, new = number[begin:begin + len(k)], np.flatnonzero(fresh[begin:begin + len(k)])
            begin += len(k)
            class_of.append(own)
            item_of.append(np.full(len(own), n))
            for run in np.split(new, np.flatnonzero(np.diff(new) > 1) + 1) if len(new) else ():
                stretches.append(items[n][1][run[0]:run[-1] + WINDOW])
                classes.append(own[run])
    pairs = np.unique(np.stack([np.concatenate(class_of), np.concatenate(item_of)], axis=1), axis=0) if class_of else np.zeros((0, 2), np.int64)
    passage_of, member_first, members = _passages(classes, pairs)
    begin = len(member_first) - 1
    member_first = np.concatenate([member_first, member_first[-1] + np.cumsum([len(ns) for _, ns in short], dtype=np.int64)])
    members = np.concatenate([members, *(np.array(ns, np.int64) for _, ns in short)])
    short = [(codes, begin + k) for k, (codes, _) in enumerate(short)]
    window = np.array([min(len(c), WINDOW) for c in stretches], np.int64)
    budget = (window * EDIT_RATE).astype(np.int64)
    grams = [qgram_hashes(c, q) for c in stretches]
    every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(stretches), dtype=np.int32), [len(g) for g in grams])
    at = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
    order = np.argsort(every, kind="stable")
    hashes, first = np.unique(every[order], return_index=True)
    present = np.zeros(1 << FILTER_BITS, bool)
    present[every >> np.uint64(64 - FILTER_BITS)] = True
    return Index([i for i, _ in items], short, stretches, classes, passage_of, member_first, members, base,
                 hashes, np.append(first, len(every)), item[order], at[order], present, window, budget, window - q + 1 - budget * q, q)


def banded_edits(item: np.ndarray, starts: np.ndarray, w: int, doc: np.ndarray, diagonal: int, width: int) -> np.ndarray:
    """Least edits with which each window ``item[s:s+w]`` occurs in ``doc`` within ``width`` diagonals.

    All windows advance together, one item character per step; the start and end in the document are free.
    """
    steps = np.arange(width)
    padded = np.concatenate([np.zeros(w + width + len(item), np.uint32), doc, np.zeros(w + width + len(item), np.uint32)])
    base = starts[:, None] + diagonal + steps[None, :] + (w + width + len(item))
    cost = np.zeros((len(starts), width), np.int32)
    for i in range(w):
        letter = item[starts + i][:, None]
        step = cost + (padded[np.clip(base + i, 0, len(padded) - 1)] != letter)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - steps, axis=1) + steps
    return cost.min(1)


def _postings(index: Index, spot: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(position in spot, posting)``, the stretches dealt into as many groups as keep a group's pairs in bounds."""
    many = index.first[place + 1] - index.first[place]
    groups = -(-int(many.sum()) // MAX_PAIRS)
    ends = np.cumsum(many)
    for g in range(groups):
        backs, posts = [], []
        for a in range(0, groups):
            lo, hi = np.searchsorted(ends, [a * MAX_PAIRS, (a + 1) * MAX_PAIRS])
            part = many[lo:hi]
            back = np.repeat(np.arange(lo, hi), part)
            post = np.arange(len(back)) - np.repeat(np.cumsum(part) - part, part) + np.repeat(index.first[place[lo:hi]], part)
            if groups > 1:
                mine = index.post_item[post] % groups == g
                back, post = back[mine], post[mine]
            backs.append(back)
            posts.append(post)
        yield np.concatenate(backs), np.concatenate(posts)


Leak = tuple[int | None, int, int, int]
Spot = tuple[int, int, int]


def search(indexes: list[Index], texts: list[str]) -> list[list[Leak]]:
    """For each text its leaks ``(item_id, start, end, edits)``; start and end in code points of the text."""
    whole = [normalise(t) for t in texts]
    out: list[list[Leak]] = [[] for _ in texts]
    for index in indexes:
        for leaks, (_, at), found in zip(out, whole, _search(index, whole)):
            by_item: dict[int, Spot] = {}
            for passage, spot in found.items():
                for n in index.items_of(passage).tolist():
                    by_item[n] = min(by_item.get(n, spot), spot)
            leaks += [(index.ids[n], *_place(at, spot)) for n, spot in by_item.items()]
    return [sorted(leaks, key=_order) for leaks in out]


def search_passages(indexes: list[Index], texts: list[str]) -> list[tuple[list[tuple[int, int | None, int, int, int]], int]]:
    """For each text its passages ``(passage, item_id, start, end, edits)``, where the item is the first that holds the
    passage, and how many items hold one of them.

    The ends of a passage, with a few letters of one item beyond it, are passages too: one whose items all hold
    others that are told with no more edits is left out, so that a passage of many items is one entry.
    """
    whole = [normalise(t) for t in texts]
    passages: list[list] = [[] for _ in texts]
    items = [0] * len(texts)
    for index in indexes:
        for d, found in enumerate(_search(index, whole)):
            linked = np.zeros(len(index.ids) if found else 0, bool)
            for p in sorted(found, key=lambda p: (found[p][0], -len(index.items_of(p)), p)):
                own = index.items_of(p)
                if not linked[own].all():
                    linked[own] = True
                    passages[d].append((index.base + p, index.ids[own[0]], *_place(whole[d][1], found[p])))
            items[d] += int(linked.sum())
    return [(sorted(x, key=lambda p: p[0]), n) for x, n in zip(passages, items)]


def _order(leak: Leak) -> tuple:
    return leak[0] is None, leak[0] or 0, leak[1:]


def _place(at: np.ndarray, spot: Spot) -> Spot:
    """Start and end in code points of the text, and edits."""
    edits, a, b = spot
    return int(at[a]), int(at[b - 1]) + 1, edits


def _search(index: Index, whole: list[tuple[np.ndarray, np.ndarray]]) -> list[dict[int, Spot]]:
    """For each text the best ``(edits, start, end)`` by passage, in normalised code points."""
    q = index.q
    best: list[dict[int, Spot]] = [{} for _ in whole]
    for d, (codes, at) in enumerate(whole if index.short else ()):
        raw = codes.tobytes()
        for word, passage in index.short:
            hit = raw.find(word.tobytes())
            while hit >= 0 and hit % 4:
                hit = raw.find(word.tobytes(), hit + 1)
            if hit >= 0:
                best[d][passage] = (0, hit // 4, hit // 4 + len(word))
    lengths = np.array([len(c) for c, _ in whole])
    if len(index.hashes) and lengths.sum() >= q:
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        hashes = qgram_hashes(np.concatenate([c for c, _ in whole]), q)
        spot = np.flatnonzero(index.present[hashes >> np.uint64(64 - FILTER_BITS)])
        place = np.searchsorted(index.hashes, hashes[spot])
        place[place == len(index.hashes)] = 0
        true = index.hashes[place] == hashes[spot]
        spot, place = spot[true], place[true]
        doc = np.searchsorted(begin + lengths, spot, side="right")
        inside = spot + q <= begin[doc] + lengths[doc]
        spot, place, doc = spot[inside], place[inside], doc[inside]
        for back, post in _postings(index, spot, place):
            for (d, n), (edits, start, end) in _regions(index, whole, doc[back], spot[back] - begin[doc[back]], post).items():
                _note(index, best[d], index.classes[n], index.budget[n], edits, start, end)
    return best


def _regions(index: Index, whole: list, doc: np.ndarray, at_doc: np.ndarray, post: np.ndarray) -> dict:
    """By text and stretch: the least edits of each window within diagonal bands that hold enough q-grams, and where."""
    item, at_item = index.post_item[post].astype(np.int64), index.post_at[post].astype(np.int64)
    shift = 2 * max((len(c) for c, _ in whole), default=0) + 2 * max(map(len, index.stretches), default=0)
    step = index.budget[item] + 1  # bands of two steps overlap by one, so a match lies whole in one band
    band = (at_doc - at_item + shift) // step
    item, doc, at_doc, at_item, step = (np.concatenate([x, x]) for x in (item, doc, at_doc, at_item, step))
    band = np.concatenate([band, band - 1])
    order = np.lexsort((at_doc, band, item, doc))
    item, doc, at_doc, at_item, band, step = (x[order] for x in (item, doc, at_doc, at_item, band, step))
    last = np.arange(len(item)) + index.need[item] - 1
    fits = last < len(item)
    to = np.minimum(last, len(item) - 1)
    fits &= (item[to] == item) & (doc[to] == doc) & (band[to] == band)
    fits &= at_doc[to] - at_doc <= index.window[item] - index.q + index.budget[item]
    fit = np.flatnonzero(fits)
    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    if not len(fit):
        return found
    apart = (np.diff(doc[fit]) != 0) | (np.diff(item[fit]) != 0) | (np.diff(band[fit]) != 0)
    for hits in np.split(fit, np.flatnonzero(apart) + 1):
        i = int(hits[0])
        d, n, w = int(doc[i]), int(item[i]), int(index.window[item[i]])
        low = max(0, int(at_item[hits].min()) - w)
        high = min(len(index.stretches[n]) - w, int(at_item[hits].max()))
        size = len(index.classes[n])
        edits, start, end = found.setdefault((d, n), (np.full(size, w, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)))
        if not edits[low:high + 1].any():
            continue
        new = banded_edits(index.stretches[n], np.arange(low, high + 1), w, whole[d][0], int(band[i] * step[i] - shift), int(2 * step[i]))
        better = low + np.flatnonzero(new < edits[low:high + 1])
        edits[better], start[better], end[better] = new[better - low], at_doc[i], at_doc[last[hits[-1]]] + index.q
    return found


def _note(index: Index, best: dict[int, Spot], classes: np.ndarray, budget: int, edits: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Enter the windows within the budget into ``best``, by passage."""
    window = np.flatnonzero(edits <= budget)
    passage = index.passage_of[classes[window]]
    order = np.lexsort((start[window], edits[window], passage))
    passage, window = passage[order], window[order]
    for k in np.flatnonzero(np.diff(passage, prepend=-1)).tolist():
        p, w = int(passage[k]), window[k]
        spot = (int(edits[w]), int(start[w]), int(end[w]))
        best[p] = min(best.get(p, spot), spot)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of bounded size and in the order of its ids and texts, streamed to the driver one partition at a time."""
    block, size = [], 0
    rows = benchmark.select("item_id", "text").filter("text <> ''").distinct().orderBy(F.asc_nulls_last("item_id"), "text")
    for row in checkpointed(rows).toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCHES = "array<struct<item_id: long, start: int, end: int, edits: int>>"
NAMES = ("item_id", "start", "end", "edits")
PASSAGES = "array<struct<passage: long, item_id: long, start: int, end: int, edits: int>>"


def indexes(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[Index]]:
    """The indexes of each block; passages are numbered through, alike in every run over the same benchmark."""
    base = 0
    for block in item_blocks(benchmark, block_chars):
        index = build_index(block, base)
        yield index
        base = index[-1].base + index[-1].passages


def _by_blocks(docs: DataFrame, benchmark: DataFrame, names: dict[str, str], job: Callable, block_chars: int) -> DataFrame:
    """``docs`` with columns ``names`` (name and type), which ``job(indexes, texts, *old)`` extends block by block. Each
    further block is one more job over the written result of the last, so that executors hold one index at a time."""
    spark, keep = docs.sparkSession, docs.columns
    before = {name: unused_name(docs) + name for name in names}
    out, shared = docs.withColumns({name: F.expr(f"cast({'array()' if kind.startswith('array') else 0} as {kind})") for name, kind in names.items()}), None
    for index in indexes(benchmark, block_chars):
        if shared is not None:
            out = checkpointed(out)
            shared.destroy()
        shared = spark.sparkContext.broadcast(index)

        def run(texts: list[str | None], *old: list, shared=shared) -> tuple:
            texts = [t or "" for t in texts]
            return job(shared.value, texts, *old)

        out = add_columns(out.withColumnsRenamed(before), ["text", *before.values()], run, ", ".join(f"`{name}` {kind}" for name, kind in names.items()), keep=keep)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of ``docs`` and ``column``, an array of ``(item_id, start, end, edits)``, per row.

    A leak is a window of 80 characters of an item (the whole item if shorter) that occurs in the text with
    at most 5 % edits, compared without case and with white space normalised. Every benchmark item is used, those
    without an id too. Null and empty texts, and an empty benchmark, give empty arrays; of several occurrences of
    one item the one with the fewest edits is reported, of equally good ones the first. Repeated rows and null
    document ids are searched like any other. A column already of that name is replaced, as by ``withColumn``.
    The benchmark is broadcast as an index of at most ``block_chars`` characters (and one item), one block at a time.
    Every item is listed, so where many items hold one passage ``find_passages`` is the form for large tables.
    """
    def run(index: list[Index], texts: list[str], old: list[list[dict]]) -> tuple[list]:
        found = [x for a, b in chunks(texts) for x in search(index, texts[a:b])]
        return ([before + [dict(zip(NAMES, x)) for x in new] for before, new in zip(old, found)],)

    return _by_blocks(docs.drop(column), benchmark, {column: MATCHES}, run, block_chars)


def find_passages(docs: DataFrame, benchmark: DataFrame, column: str = "passages", count: str = "n_items", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of ``docs``, the passages of the benchmark in each text, and the number of items that hold one of them.

    Leaks as in ``find_leaks``, but told by passage: ``(passage, item_id, start, end, edits)``, where windows that the
    same items hold are one passage and ``item_id`` is the first item of it. Passages are told with the fewest edits
    first, as long as they add an item. ``passage_members`` lists the items of every passage, so documents and items meet
    through passages and never as pairs. Columns of those names are replaced.
    A passage that items of several blocks hold is one passage a block.
    """
    names = ("passage", *NAMES)

    def run(index: list[Index], texts: list[str], old: list[list[dict]], n: list[int]) -> tuple[list, list]:
        found = [x for a, b in chunks(texts) for x in search_passages(index, texts[a:b])]
        return [before + [dict(zip(names, x)) for x in new] for before, (new, _) in zip(old, found)], [k + more for k, (_, more) in zip(n, found)]

    return _by_blocks(docs.drop(column, count), benchmark, {column: PASSAGES, count: "long"}, run, block_chars)


def passage_members(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``passage, item_id``: the items of every passage, numbered as by ``find_passages`` with the same ``block_chars``.

    Items without text have none; an item whose text stands twice under one id is listed once. An empty benchmark gives
    no rows. The rows are made in tasks from the broadcast index of a block and written before the next block."""
    spark, schema = benchmark.sparkSession, "passage long, item_id long"
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for passage in batch.column(0).to_pylist():
                    own = next(x for x in reversed(shared.value) if x.base <= passage)
                    ids = [own.ids[n] for n in own.items_of(passage - own.base).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([passage] * len(ids), pa.int64()), pa.array(ids, pa.int64())], ["passage", "item_id"])

        rows = spark.range(index[0].base, index[-1].base + index[-1].passages).mapInArrow(run, schema)
        out = out.unionByName(checkpointed(rows))
        shared.destroy()
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns kept whatever their names, without the rows that hold a passage of the benchmark."""
    found = unused_name(docs)
    count = found + "n"
    return find_passages(docs, benchmark, found, count).filter(F.col(count) == 0).drop(found, count)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``passages`` are its passage classes, ``item_ids`` the first item of each, ``n_items`` counts
    all items that hold one of them, ``edits`` is the least number of edits."""
    found = find_passages(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    joined = lambda field: F.array_join(F.transform("passages", lambda x: x[field].cast("string")), ",")
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", joined("passage").alias("passage_ids"),
                        F.array_join(F.array_distinct(F.transform("passages", lambda x: x["item_id"].cast("string"))), ",").alias("item_ids"),
                        F.array_min(F.transform("passages", lambda x: x["edits"])).alias("edits"))


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the passages that ``op9_decontamination`` names."""
    return passage_members(table(spark, sf_dir, "benchmark"))
