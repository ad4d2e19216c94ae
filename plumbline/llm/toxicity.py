"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import add_columns, checkpointed, documents, held_out, shared_folder, table

#: The evaluation fold of the registered query: crc32 of the id modulo 5 is 0.
FOLD = (5, 0)
#: Labelled documents and characters of a shard, about: a task trains on a shard, and the shards' networks are averaged.
SHARD_DOCS, SHARD_CHARS = 6000, 40_000_000
#: Logits are told apart at so many steps of one when thresholds are sought.
STEPS = 1 << 12
#: Numbers of a network that are added up in one group.
BLOCK = 1 << 16
FEATURE_BITS, DIM, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
PREFIXES = (3, 4, 5)
EPOCHS, BATCH, RATE = 2, 64, 0.05
#: Documents that the class shares count for when the odds of a feature are estimated.
PRIOR_STRENGTH = 25.0
#: Parts of the training rows for calibration; each is scored by a network trained on the others.
FOLDS = 5
#: Texts of the rarer class at which a language's own threshold weighs as much as the common one.
SHRINK = 10
RECALL_WEIGHT = 2
CHUNK_CHARS = 500_000
WORD = re.compile(r"\w+")
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


def features(words: list[str]) -> np.ndarray:
    """Hashed rows of the embedding for each word: the word itself and its first three, four and five letters.

    Polynomial hashes come from one running sum of codes times powers of an odd base, whose inverse powers take
    each word back to its own start.
    """
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        power, inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(codes), base, np.uint64))) for base in (_BASE, _INVERSE))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:-1])])
        out = []
        for n in (None, *PREFIXES):
            to = ends if n is None else np.minimum(ends, starts + n)
            h = (total[to] - total[starts]) * inverse[starts] + np.uint64(n or 0)
            out.append(((h ^ (h >> np.uint64(31))) * _MIX >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))
    return np.stack(out, axis=1)


class Batch:
    """Texts as positions in a table of their different words; every text ends with a padding word 0."""

    def __init__(self, texts: list[str]) -> None:
        index: defaultdict[str, int] = defaultdict(count().__next__, {"": 0})
        next(index.default_factory.__self__)
        at, self.starts, pad = [], [], [0] * max(WIDTHS)
        for t in texts:
            self.starts.append(len(at))
            at += map(index.__getitem__, WORD.findall(t.lower()))
            at += pad
        self.at = np.array(at, np.int32)
        self.words = features(list(index))

    def part(self, rows: np.ndarray) -> Batch:
        """The same for some of the texts."""
        out, ends = object.__new__(Batch), [*self.starts[1:], len(self.at)]
        pieces = [self.at[self.starts[k]:ends[k]] for k in rows.tolist()]
        used, out.at = np.unique(np.concatenate(pieces), return_inverse=True)  # word 0 is in every text, so it stays first
        out.words = self.words[used]
        out.starts = [0, *np.cumsum([len(p) for p in pieces])[:-1].tolist()]
        return out

    def positions(self, width: int) -> np.ndarray:
        """Word numbers of every window of ``width`` words, as ``width`` rows; windows may reach into the padding."""
        tail = np.concatenate([self.at, np.zeros(width - 1, np.int32)])
        return np.stack([tail[j:j + len(self.at)] for j in range(width)])


@dataclass
class Network:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    output: np.ndarray
    offset: float = 0.0
    memory: dict = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        return cls(rng.normal(0, 0.1, (1 << FEATURE_BITS, DIM)).astype(np.float32), filters,
                   {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32))

    def pooled(self, batch: Batch) -> tuple[np.ndarray, dict]:
        """Largest response of each filter in each text, rectified, and the window that gave it."""
        vectors = self.embedding[batch.words].mean(1)
        vectors[0] = 0
        out, where = [], {}
        starts = np.asarray(batch.starts)
        last = np.array([*batch.starts[1:], len(batch.at)]) - 1
        for w in WIDTHS:
            rows = batch.positions(w)
            response = sum((vectors @ self.filters[w][j])[rows[j]] for j in range(w))
            for back in range(w - 1):  # windows that would reach into the next text count as padding
                response[last - back] = 0
            peak = np.maximum.reduceat(response, starts, axis=0)
            where[w] = (rows, response, peak)
            out.append(np.maximum(peak + self.bias[w], 0))
        return np.concatenate(out, axis=1), where

    def logits(self, batch: Batch) -> np.ndarray:
        return self.pooled(batch)[0] @ self.output + self.offset

    def _step(self, name: str, target: np.ndarray, grad: np.ndarray) -> None:
        memory = self.memory.setdefault(name, np.full(target.shape, 1e-6, np.float32))
        memory += grad * grad
        target -= RATE * grad / np.sqrt(memory)

    def learn(self, batch: Batch, labels: np.ndarray, weight: np.ndarray) -> None:
        """One step of adaptive gradient descent on the weighted log loss; only the peak windows carry gradient."""
        hidden, where = self.pooled(batch)
        logit = hidden @ self.output + self.offset
        error = (weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels)).astype(np.float32) / len(labels)
        back = np.outer(error, self.output) * (hidden > 0)
        vectors = self.embedding[batch.words].mean(1)
        vectors[0] = 0
        d_vectors = np.zeros_like(vectors)
        ends = [*batch.starts[1:], len(batch.at)]
        gradients = {}
        for k, w in enumerate(WIDTHS):
            rows, response, peak = where[w]
            grad = back[:, k * FILTERS:(k + 1) * FILTERS]
            d_filter = np.zeros_like(self.filters[w])
            at = np.array([a + response[a:b].argmax(0) for a, b in zip(batch.starts, ends)])
            for j in range(w):
                word = rows[j][at]
                d_filter[j] = np.einsum("nfd,nf->df", vectors[word], grad)
                np.add.at(d_vectors, word, grad[:, :, None] * self.filters[w][j].T[None])
            gradients[w] = d_filter, grad.sum(0)
        self._step("output", self.output, hidden.T @ error)
        for w, (d_filter, d_bias) in gradients.items():
            self._step(f"filter{w}", self.filters[w], d_filter)
            self._step(f"bias{w}", self.bias[w], d_bias)
        self.offset -= RATE * float(error.sum()) * 4
        d_vectors[0] = 0
        used = np.flatnonzero(np.abs(d_vectors).sum(1))
        rows, grad = batch.words[used].reshape(-1), np.repeat(d_vectors[used] / batch.words.shape[1], batch.words.shape[1], axis=0)
        memory = self.memory.setdefault("embedding", np.full(self.embedding.shape, 1e-6, np.float32))
        np.add.at(memory, rows, grad * grad)
        np.add.at(self.embedding, rows, -RATE * grad / np.sqrt(memory[rows]))


@dataclass
class Classifier:
    network: Network | None
    languages: langid.Model
    thresholds: dict[int, float]
    common: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability-like score; 0.5 is the calibrated threshold of the language that the text appears to have."""
        if self.network is None:
            return np.zeros(len(texts))
        logit = np.zeros(len(texts))
        for a, b in langid.chunks(texts, CHUNK_CHARS):
            logit[a:b] = self.network.logits(Batch(texts[a:b]))
        best, _ = langid.classify(self.languages, texts)
        logit -= [self.thresholds.get(int(k), self.common) for k in best]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _threshold(z: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """The cut with the best F-measure, in the middle of its gap; recall weighs ``RECALL_WEIGHT`` times precision. ``z`` are
    different logits, ``n`` the texts that have them, ``hits`` those of label 1."""
    order = np.argsort(-z, kind="stable")
    z, found, seen = z[order], np.cumsum(hits[order]), np.cumsum(n[order])
    k = int((found / (seen + RECALL_WEIGHT * hits.sum())).argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k]) - 0.5


@dataclass
class Shard:
    """Labelled texts of one task: network 0 learns from all of them, network f from those outside fold f."""

    every: Batch
    size: list[int]
    labels: np.ndarray
    fold: np.ndarray

    @classmethod
    def of(cls, texts: list[str], labels: np.ndarray) -> Shard:
        # Folds by place within each class, so every fold has its share of both.
        fold = np.zeros(len(texts), np.int64)
        for y in (0, 1):
            own = np.random.default_rng(5).permutation(np.flatnonzero(labels == y))
            fold[own] = np.arange(len(own)) % FOLDS + 1
        return cls(Batch(texts), [len(t) for t in texts], labels, fold)

    def counts(self) -> np.ndarray:
        """Texts by fold and class, in column 0, and those that have each feature."""
        out = np.zeros((FOLDS, 2, 1 + (1 << FEATURE_BITS)), np.float32)
        ends = [*self.every.starts[1:], len(self.every.at)]
        for k, (f, y) in enumerate(zip(self.fold.tolist(), self.labels.tolist())):
            words = np.unique(self.every.at[self.every.starts[k]:ends[k]])[1:]  # without the padding
            out[f - 1, y, 0] += 1
            out[f - 1, y, 1 + np.unique(self.every.words[words])] += 1
        return out

    def learn(self, network: Network, number: int, share: float, epoch: int) -> Network:
        """One more epoch, both classes of equal total weight."""
        train = np.flatnonzero(self.fold != number)
        if not len(train):
            return network
        weight = np.where(self.labels == 1, 0.5 / share, 0.5 / (1 - share))
        rng = np.random.default_rng(3)
        mixed = [rng.permutation(train) for _ in range(epoch + 1)][-1]
        for a in range(0, len(mixed), BATCH):
            part = mixed[a:a + BATCH]
            for lo, hi in langid.ranges([self.size[k] for k in part], 4 * CHUNK_CHARS):
                rows = part[lo:hi]
                network.learn(self.every.part(rows), self.labels[rows], weight[rows])
        return network

    def unseen(self, network: Network, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the fold that the network has not seen, and their logits."""
        rows = np.flatnonzero(self.fold == number)
        parts = [network.logits(self.every.part(rows[a:b])) for a, b in langid.ranges([self.size[k] for k in rows], CHUNK_CHARS)]
        return rows, np.concatenate(parts) if parts else np.zeros(0)


def _begin(counts: np.ndarray, number: int) -> tuple[Network, float] | None:
    """Network ``number`` before its first epoch and the share of label 1 in what it learns from; None if that is one class.

    The first embedding dimension starts from the log odds of each feature in all labelled texts, and one filter reads it.
    """
    seen = counts[np.arange(1, FOLDS + 1) != number].sum(0, dtype=np.float64)
    if not seen[:, 0].all():
        return None
    share = float(seen[1, 0] / seen[:, 0].sum())
    odds = seen[:, 1:] + PRIOR_STRENGTH * np.array([[1 - share], [share]])
    network = Network.start()
    network.embedding[:, 0] = np.log(odds[1] / odds[0]) - np.log(share / (1 - share))
    network.filters[1][0][:, 0] = np.eye(DIM, dtype=np.float32)[0]
    network.output[0], network.bias[1][0] = 1.0, -1.0
    return network, share


def _calibrated(network: Network, languages: langid.Model, cells: pd.DataFrame) -> Classifier:
    """Thresholds from ``lang, step, hits, n``: the best cut over all texts and over those of each language, whose own cut
    counts against the common one by its number of texts of the rarer class."""
    def best(part: pd.DataFrame) -> float:
        part = part.groupby("step", as_index=False)[["hits", "n"]].sum()
        return _threshold(part["step"].to_numpy(float) / STEPS, part["hits"].to_numpy(float), part["n"].to_numpy(float))

    common, thresholds = best(cells), {}
    for k, own in cells.groupby("lang"):
        n = min(own["hits"].sum(), (own["n"] - own["hits"]).sum())
        if n:
            thresholds[int(k)] = float((n * best(own) + SHRINK * common) / (n + SHRINK))
    return Classifier(network, languages, thresholds, common)


def _cells(shard: Shard, networks: list[Network], best: np.ndarray) -> pd.DataFrame:
    """Texts and those of label 1 by language and step of the logit that a network which has not seen them gives."""
    logit = np.zeros(len(shard.size))
    for f in range(1, FOLDS + 1):
        rows, logit[shard.fold == f] = shard.unseen(networks[f], f)
    step = np.floor(logit * STEPS + 0.5).astype(np.int64)
    return pd.DataFrame({"lang": best.astype(np.int64), "step": step, "hits": shard.labels, "n": 1}).groupby(["lang", "step"], as_index=False).sum()


def fit(texts: list[str], labels: np.ndarray, languages: langid.Model) -> Classifier:
    """As :func:`train`, on texts of one shard that are at hand. Without examples of both classes every score is 0."""
    if len(set(labels.tolist())) < 2:
        return Classifier(None, languages, {})
    shard = Shard.of(texts, labels)
    counts = shard.counts()
    states = [_begin(counts, f) or _begin(counts, 0) for f in range(FOLDS + 1)]
    for f, (network, share) in enumerate(states):
        for epoch in range(EPOCHS):
            shard.learn(network, f, share, epoch)
        network.memory = {}
    return _calibrated(states[0][0], languages, _cells(shard, [n for n, _ in states], langid.classify(languages, texts)[0]))


def _added(shards: DataFrame, run: Callable[[Shard], Iterator[tuple[str, np.ndarray]]]) -> DataFrame:
    """Arrays by name, each the sum over all shards: blocks of them are added up in groups of their own and written."""
    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(name, k // BLOCK, values[k:k + BLOCK].tobytes()) for name, values in run(_shard(pdf)) for k in range(0, len(values), BLOCK)]
        return pd.DataFrame(rows, columns=["name", "block", "bytes"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in pdf["bytes"])
        return pd.DataFrame({"name": [key[0]], "block": [key[1]], "bytes": [total.astype(np.float32).tobytes()]})

    schema, spark = "name string, block int, bytes binary", shards.sparkSession
    path = shared_folder(spark, f"toxicity-{uuid.uuid4().hex}")
    shards.groupBy("shard").applyInPandas(blocks, schema).groupBy("name", "block").applyInPandas(add, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _arrays(added: DataFrame, prefix: str) -> dict[str, np.ndarray]:
    """The arrays whose names begin so, a network's at most, on the driver."""
    out: defaultdict[str, list] = defaultdict(list)
    for r in added.filter(F.col("name").startswith(prefix)).orderBy("name", "block").collect():
        out[r.name].append(np.frombuffer(r.bytes, np.float32))
    return {name: np.concatenate(parts) for name, parts in out.items()}


def _shard(pdf: pd.DataFrame) -> Shard:
    pdf = pdf.sort_values(["doc_id", "toxic"], kind="stable")
    return Shard.of(pdf["text"].tolist(), pdf["toxic"].to_numpy(np.int64))


def _numbers(network: Network) -> dict[str, np.ndarray]:
    out = {"embedding": network.embedding, "output": network.output, "offset": np.array([network.offset], np.float32)}
    return out | {f"{kind}{w}": values[w] for kind, values in (("filter", network.filters), ("bias", network.bias)) for w in WIDTHS}


def _changes(before: Network, after: Network, number: int) -> Iterator[tuple[str, np.ndarray]]:
    old, memory = _numbers(before), after.memory.get("embedding")
    for name, values in _numbers(after).items():
        yield f"{number} {name}", (values - old[name]).ravel().astype(np.float32)
    yield f"{number} touched", np.zeros(len(after.embedding), np.float32) if memory is None else (memory > 1e-6).any(1).astype(np.float32)
    yield f"{number} shards", np.ones(1, np.float32)


def _averaged(network: Network, sums: dict[str, np.ndarray], number: int) -> Network:
    """The network with the mean change of all shards; a row of the embedding with that of the shards that have it."""
    rows, shards = np.maximum(sums[f"{number} touched"], 1)[:, None], sums[f"{number} shards"]
    new = {name: (values + sums[f"{number} {name}"].reshape(values.shape) / (rows if name == "embedding" else shards)).astype(np.float32) for name, values in _numbers(network).items()}
    return Network(new["embedding"], {w: new[f"filter{w}"] for w in WIDTHS}, {w: new[f"bias{w}"] for w in WIDTHS}, new["output"], float(new["offset"][0]))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Train on all labelled rows of ``docs`` (null ids, texts and labels left out, equal texts once,
    of an id on several rows the first text in order). Without rows of both classes every score is 0.

    Tasks train on shards of the rows, a hash of the id tells which, all from feature counts of all rows, and Spark averages what
    they changed; one shard is trained on as :func:`fit` does. Thresholds are calibrated out of fold: every text is scored by a network that has not
    seen it. The driver gets sums of networks, feature counts and counts of logits, whose size does not depend on the number of rows; the
    language model behind the thresholds counts all documents that labels may be learned from.
    """
    spark = docs.sparkSession
    languages = langid.train(docs, None)
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").distinct()
    texts = docs.select("doc_id", "text").dropna().join(marked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = checkpointed(texts.groupBy("text").agg(F.min(F.struct("doc_id", "toxic")).alias("first")).select("first.*", "text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    tasks = max(1, -(-n // SHARD_DOCS), -(-chars // SHARD_CHARS))
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(tasks)))
    counts = _arrays(_added(shards, lambda shard: iter([("counts", shard.counts().ravel())])), "counts").get("counts", np.zeros(0)).reshape(-1, 2, 1 + (1 << FEATURE_BITS))
    if not len(counts) or not _begin(counts, 0):
        return Classifier(None, languages, {})
    begun = lambda seen, f: _begin(seen, f) or _begin(seen, 0)
    first = spark.sparkContext.broadcast(counts)

    def learn(shard: Shard) -> Iterator[tuple[str, np.ndarray]]:
        for f in range(FOLDS + 1):
            network, share = begun(first.value, f)
            own = deepcopy(network)
            for epoch in range(EPOCHS):
                shard.learn(own, f, share, epoch)
            yield from _changes(network, own, f)

    sums = _added(shards, learn)
    networks = [_averaged(begun(counts, f)[0], _arrays(sums, f"{f} "), f) for f in range(FOLDS + 1)]
    shared = spark.sparkContext.broadcast((networks, languages))

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "toxic"], kind="stable")
        trained, known = shared.value
        return _cells(_shard(pdf), trained, langid.classify(known, pdf["text"].tolist())[0])

    found = shards.groupBy("shard").applyInPandas(cells, "lang long, step long, hits long, n long").groupBy("lang", "step").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return _calibrated(networks[0], languages, found.orderBy("lang", "step").toPandas())


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, score`` for every row, from the whole text alone; null texts are scored as empty ones.

    Equal texts get equal scores, so ties and repeated rows change nothing; ids may be null or repeated. An empty
    table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    return add_columns(docs, ["text"], lambda texts: (shared.value.scores([t or "" for t in texts]),), "score double", keep=["doc_id"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, outside = documents(spark, sf_dir), ~held_out(*FOLD)
    classifier = train(docs.filter(outside), table(spark, sf_dir, "labels").filter(outside))
    return score(docs, classifier).select("doc_id", held_out(*FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
