"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (3 to 5 letters, with marks for
its ends) and itself; each bucket has a vector.  The vectors of a window of
``WINDOW`` words are averaged and go through a linear softmax; vectors and weights
are trained together, in numpy.  A text's score is that of its worst window, so a few toxic
words count in a text of any length, and a misspelt word shares most of its
n-grams with the word meant.

Training knows a label for a whole text only: in each round every training text
stands for its worst window so far (at first, for all of its words).  Words count once in a window, so
that mere repetition is no sign.  At most
``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents are learned from, those with the
smallest hashes of doc_id; of these, as many as ``MAX_TRAIN_WORDS`` hold for each label, and one
that is too long for what is left is passed over.  Scoring is linear in the buckets, so each distinct word's
share of the logit is kept in a bounded table.

Texts without words (null, too) are judged by what stands in every window; without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import mix64, slices, texts_of, worker_state

MAX_TOXIC = 1_000
MAX_CLEAN = 2_000
MAX_TRAIN_WORDS = 1_500_000  # of the training documents of each label, in the order of their hashes
BUCKETS = 1 << 16
DIM = 8
WINDOW = 8
STRIDE = 1
THRESHOLD = 0.7
CACHE_WORDS = 400_000
#: Stands in every window, so that a few words alone don't decide; no text holds it as a word.
PAD = "\0" * 12
_WORD = re.compile(r"\w+")
_U = np.uint64


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words: list[str], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, number of features of each word); words one after another.

    A part of the words at a time: what is made in between is many times as large as the result.
    """
    made = [_features(words[lo : lo + part]) for lo in range(0, len(words), part)]
    return np.concatenate([x for x, _ in made]), np.concatenate([n for _, n in made])


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(ends, lens) - np.arange(len(flat))  # letters from here to the word's end
    buckets, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, 6):
        h = h * _U(0x9E3779B97F4A7C15)
        h[: len(flat) - n + 1] += flat[n - 1 :] + _U(1)
        if n >= 3:
            at = np.flatnonzero(left >= n)
            buckets.append(mix64(h[at] + _U(n)))
            owners.append(owner[at])
    whole = np.add.reduceat(flat * mix64(np.arange(len(flat), dtype=np.uint64) - np.repeat((ends - lens), lens).astype(np.uint64)), ends - lens)
    buckets.append(mix64(whole))
    owners.append(np.arange(len(words)))
    bucket, who = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return (bucket[order] % _U(BUCKETS)).astype(np.int32), np.bincount(who, minlength=len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Bucket vectors and softmax weights; only the difference of the two classes' logits counts."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: float):
        self.vectors, self.weights, self.bias = vectors, weights, bias
        self.share = vectors @ (weights[1] - weights[0])  # of each bucket in the logit

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of shares, number of features) of each word."""
        bucket, n = features(words)
        return np.add.reduceat(self.share[bucket], np.cumsum(n) - n), n

    def worst(self, words: np.ndarray, shares: np.ndarray, sizes: np.ndarray) -> float:
        """Logit of the worst window of a text; ``words`` are numbers of words, shares and sizes by number."""
        return float(window_means(words, shares, sizes)[2].max()) + self.bias


def previous(words: np.ndarray) -> np.ndarray:
    """Where each word stood last before; -1: nowhere."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), -1)
    same = words[order[1:]] == words[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def window_means(words: np.ndarray, shares: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, mean share of a feature) of each window; a word counts once in a window.  Word 0 is PAD.

    A place counts in the windows that hold it and not the word's previous place.
    """
    n = len(words)
    lo, hi = window_edges(n)
    at = np.arange(n)
    first = np.maximum(np.maximum(previous(words) + 1, at - WINDOW + 1), 0)  # of the windows in which the place counts

    def sums(of_word: np.ndarray) -> np.ndarray:
        x = of_word[words].astype(float)
        step = np.bincount(first, x, n + 1).astype(float)  # whole numbers where there are no words
        step[1:] -= x
        return np.cumsum(step)[lo]

    return lo, hi, (sums(shares) + shares[0]) / (sums(sizes) + sizes[0])


def window_edges(n: int) -> tuple[np.ndarray, np.ndarray]:
    lo = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    hi = np.minimum(lo + WINDOW, n)
    return np.maximum(0, hi - WINDOW), hi


def train(texts: list[str], labels: np.ndarray, rounds: int = 4, epochs: int = 6, seed: int = 3) -> Model:
    """Vectors and softmax jointly, by Adagrad on the texts' worst windows."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights = np.zeros((2, DIM))
    weights[1], weights[0] = rng.normal(0, 0.5, DIM), 0
    bias = 0.0
    index: dict[str, int] = {PAD: 0}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(x)], np.int32) for x in texts]
    some = np.array([len(d) > 0 for d in docs], bool)
    docs, labels = [d for d in docs if len(d)], labels[some].astype(float)
    if not len(docs) or labels.min() == labels.max():
        return Model(np.zeros((BUCKETS, DIM)), np.zeros((2, DIM)), -60.0)
    bucket, n = features(list(index))
    first = np.cumsum(n) - n
    importance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    gv, gw, gb = np.full(BUCKETS, 1e-6), np.full((2, DIM), 1e-6), 1e-6
    for turn in range(rounds):
        chosen = []
        if turn:
            share = vectors @ (weights[1] - weights[0])
            shares = np.add.reduceat(share[bucket], first)
        for d in docs:
            if turn == 0:
                chosen.append(np.unique(np.append(d, 0)))
                continue
            lo, hi, mean = window_means(d, shares, n)
            best = int(mean.argmax())
            chosen.append(np.unique(np.append(d[lo[best] : hi[best]], 0)))
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for lo in range(0, len(order), 64):
                part = order[lo : lo + 64]
                words = np.concatenate([chosen[i] for i in part])
                size = n[words]
                ends = np.cumsum(size)
                rows = bucket[np.repeat(first[words] - (ends - size), size) + np.arange(ends[-1])]
                per = np.add.reduceat(size, np.cumsum([0] + [len(chosen[i]) for i in part[:-1]]))
                who = np.repeat(np.arange(len(part)), per)
                heads = np.cumsum(per) - per
                mean = np.add.reduceat(vectors[rows], heads) / per[:, None]
                logit = mean @ weights.T
                p = _sigmoid(logit[:, 1] - logit[:, 0] + bias)
                g = (p - labels[part]) * importance[part] / len(part)
                dw = np.stack([-g @ mean, g @ mean])
                dv = (g / per)[:, None] * (weights[1] - weights[0])
                used, back = np.unique(rows, return_inverse=True)
                step = np.stack([np.bincount(back, dv[who, k], len(used)) for k in range(DIM)], 1)
                gv[used] += (step**2).mean(1)
                vectors[used] -= 0.5 * step / np.sqrt(gv[used])[:, None]
                gw += dw**2
                weights -= 0.2 * dw / np.sqrt(gw)
                gb += g.sum() ** 2
                bias -= 0.1 * g.sum() / np.sqrt(gb)
    return Model(vectors, weights, bias)


class Scorer:
    """Scores texts through a bounded table of words."""

    def __init__(self, model: Model, size: int = CACHE_WORDS):
        self.model, self.size = model, size
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {PAD: 0}
        self.shares, self.sizes = np.zeros(1 << 12), np.zeros(1 << 12, np.int64)
        self.shares[:1], self.sizes[:1] = self.model.of_words([PAD])

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > self.size:
            self._clear()
        index, had = self.index, len(self.index)
        words = [words_of(x) for x in texts]
        for ws in words:
            for w in set(ws):
                if w not in index:
                    index[w] = len(index)
        if len(index) > had:
            while len(self.shares) < len(index):
                self.shares, self.sizes = np.tile(self.shares, 2), np.tile(self.sizes, 2)
            self.shares[had : len(index)], self.sizes[had : len(index)] = self.model.of_words(list(index)[had:])
        out = np.empty(len(texts))
        for i, ws in enumerate(words):
            at = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
            out[i] = self.model.worst(at, self.shares, self.sizes)
        return _sigmoid(out)


def within_budget(rows: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The (doc_id, toxic, text) rows that MAX_TRAIN_WORDS words of each label hold, taken as they come; in order of doc_id."""
    kept, left = [], {}
    for doc, toxic, text in rows:
        n = sum(1 for _ in _WORD.finditer(text.lower()))  # as words_of counts
        if n <= left.setdefault(toxic, MAX_TRAIN_WORDS):
            kept.append((doc, toxic, text))
            left[toxic] -= n
    return sorted(kept)


def fit(labelled: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Learn from (doc_id, text, toxic) rows; at most so many of each label, in one task.  The driver sees the model only."""
    keyed = labelled.where("toxic IS NOT NULL").select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    chosen = None
    for toxic, most in ((1, max_toxic), (0, max_clean)):
        part = keyed.where(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = labelled.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").where("toxic IS NOT NULL")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text", F.xxhash64(F.lit("order"), "doc_id").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = within_budget(x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b), strict=True))
        model = train([x[2] for x in kept], np.array([x[1] for x in kept], int))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps((model.vectors, model.weights, model.bias))]})

    found = rows.repartition(1).sortWithinPartitions("place", "toxic", "text").mapInArrow(run, "model binary").collect()  # one row
    return Model(*pickle.loads(found[0].model)) if found else train([], np.zeros(0, int))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """``docs`` with score and predicted; text is the only column that counts."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.vectors, model.weights, model.bias)))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(key, lambda: Scorer(Model(*pickle.loads(shared.value))))
        for whole in batches:
            texts = texts_of(whole)
            for lo, hi in slices(texts):
                got = scorer(texts[lo:hi])
                b = whole.slice(lo, hi - lo)
                columns = [c for n, c in zip(b.schema.names, b.columns, strict=True) if keep_text or n != "text"]
                names = [n for n in b.schema.names if keep_text or n != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    own = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own if keep_text or f.name != "text") + ", score double, predicted int"
    return docs.select(*[f"`{f.name}`" for f in own]).mapInArrow(run, ddl)
