"""Language identification by segmentation-marginalised unigrams.

Over the pieces of a fixed public vocabulary each language has a probability for
each piece.  A word's likelihood is the sum over all of its segmentations into
pieces, which a forward pass gives; a text's is the product over its words.  The
probabilities are fitted by expectation maximisation (forward and backward) on
the counts of all words of about ``MAX_DOCS`` labelled documents a language, each language in a task of its own.

Words are runs of letters in lower case, of any length, after a mark for the word's start.  Words
of more than ``LONG`` letters are read one by one with logarithms of the last few states only; the sums are the same.  Letters outside the vocabulary have a
small fixed probability, the same for all languages.

``lang_pred`` is 'und' (score 0) for null texts, texts without letters, and
where no labelled text was there to learn from; ties go to the language that sorts first.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import mix64, slices, texts_of, worker_state

MAX_DOCS = 800  # labelled documents to learn from, about, for each language
ROUNDS = 3
LONG = 64
CELLS = 200_000  # letters of the words that are looked at together
CACHE_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"
_U = np.uint64
_A = _U(0x9E3779B97F4A7C15)
_UNKNOWN = 1e-7
_SCALE = 256.0  # per letter, keeps products near 1


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def vocabulary(path: str) -> list[str]:
    """Pieces of letters in lower case, with or without the start mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    kept = {p for p in pieces if re.fullmatch(rf"{_START}?[^\W\d_]*", p) and p == p.lower() and p}
    return sorted(kept | {_START})


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words after their start mark, zero-filled, and their lengths."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer((_START + _START.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(words), int(lens.max())), np.uint32)
    out[np.arange(out.shape[1])[None, :] < lens[:, None]] = flat
    return out, lens


class Lattice:
    """All pieces in some words: for each end and length the words that have one there."""

    def __init__(self, pieces: list[str]):
        m, lens = _matrix([p[1:] if p.startswith(_START) else p for p in pieces])
        marked = np.array([p.startswith(_START) for p in pieces])
        keys = np.zeros(len(pieces), np.uint64)
        for t in range(m.shape[1]):
            live = (t < lens) & ((t > 0) | marked)
            keys[live] = keys[live] * _A + m[live, t].astype(np.uint64)
        keys = mix64(keys + (lens - ~marked).astype(np.uint64) * _U(0xA0761D6478BD642F))
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order
        self.longest = int((lens - ~marked).max()) if len(pieces) else 1
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(keys >> _U(42)).astype(np.int64)] = True

    def edges(self, words: list[str]) -> tuple[list[list[tuple[int, np.ndarray, np.ndarray]]], np.ndarray]:
        """For each end position the (length, words, pieces; -1: an unknown letter) there."""
        m, lens = _matrix(words)
        m = m.astype(np.uint64)
        out = []
        for t in range(m.shape[1]):
            here = []
            live = np.flatnonzero(lens > t)
            h = np.zeros(len(live), np.uint64)
            for size in range(1, min(self.longest, t + 1) + 1):
                h = h + m[live, t - size + 1] * _U(pow(int(_A), size - 1, 2**64))
                key = mix64(h + _U(size * 0xA0761D6478BD642F % 2**64))
                maybe = np.flatnonzero(self.seen[(key >> _U(42)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
                same = self.keys[at] == key[maybe]
                rows, ids = maybe[same], self.numbers[at[same]]
                if len(rows):
                    here.append((size, live[rows], ids))
                if size == 1 and len(rows) < len(live):
                    other = np.ones(len(live), bool)
                    other[rows] = False
                    here.append((1, live[other], np.full(int(other.sum()), -1)))
            out.append(here)
        return out, lens

    def steps(self, word: str, block: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each end position in one word, however long, the lengths and pieces (-1: an unknown letter) there."""
        flat = np.frombuffer((_START + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for lo in range(0, len(flat), block):
            back = min(lo, self.longest - 1)
            m = flat[lo - back : lo + block]
            n = len(m) - back
            h = np.zeros(n, np.uint64)
            found = []
            for size in range(1, self.longest + 1):
                first = max(0, size - 1 - back)  # earlier ones would begin before the word
                if first >= n:
                    break
                h[first:] += m[back + first - size + 1 : back + n - size + 1] * _U(pow(int(_A), size - 1, 2**64))
                key = mix64(h[first:] + _U(size * 0xA0761D6478BD642F % 2**64))
                maybe = np.flatnonzero(self.seen[(key >> _U(42)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
                same = self.keys[at] == key[maybe]
                ends, ids = maybe[same] + first, self.numbers[at[same]]
                if size == 1:
                    other = np.setdiff1d(np.arange(n), ends)
                    ends, ids = np.concatenate([ends, other]), np.concatenate([ids, np.full(len(other), -1)])
                found.append((ends, np.full(len(ends), size), ids))
            ends, sizes, ids = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(ends, kind="stable")
            sizes, ids = sizes[order], ids[order]
            edges = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
            for i, j in zip(edges, edges[1:], strict=False):
                yield sizes[i:j], ids[i:j]


def log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp(x) over the rows."""
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def batches_of(words: list[str]) -> Iterator[np.ndarray]:
    """Numbers of the words of up to LONG letters, those of like length together, about CELLS letters at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    order = order[: np.searchsorted(sizes[order], LONG, "right")]
    while len(order):
        n = max(1, CELLS // (int(sizes[order[min(len(order), 4000) - 1]]) + 1))
        yield order[: min(n, 4000)]
        order = order[min(n, 4000) :]


def forward(edges, lens: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[word, letters read, language], each letter scaled by _SCALE; ``prob``'s last row: unknown."""
    alpha = np.zeros((len(edges) + 1, len(lens), prob.shape[1]))
    alpha[0] = 1.0
    for t, here in enumerate(edges):
        for size, rows, ids in here:
            alpha[t + 1, rows] += alpha[t + 1 - size, rows] * (prob[ids] * _SCALE**size)
    return alpha


def fit_one(lattice: Lattice, n_pieces: int, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over all segmentations."""
    prob = np.full((n_pieces + 1, 1), 1.0 / n_pieces)
    prob[-1] = _UNKNOWN
    groups = [(*lattice.edges([words[i] for i in part]), counts[part]) for part in batches_of(words)]
    long = [(w, n) for w, n in zip(words, counts.tolist(), strict=True) if len(w) > LONG]
    for _ in range(rounds):
        total = np.zeros(n_pieces + 1)
        for edges, lens, n in groups:
            alpha = forward(edges, lens, prob)[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[lens, np.arange(len(lens))] = 1.0
            whole = alpha[lens, np.arange(len(lens))]
            seen, shares = [], []
            for t in range(len(edges) - 1, -1, -1):
                for size, rows, ids in edges[t]:
                    step = beta[t + 1, rows] * prob[ids, 0] * _SCALE**size
                    shares.append(alpha[t + 1 - size, rows] * step * n[rows] / whole[rows])
                    seen.append(ids)
                    beta[t + 1 - size, rows] += step
            total += np.bincount(np.concatenate(seen) % (n_pieces + 1), np.concatenate(shares), n_pieces + 1)
        for word, n in long:
            total += n * expected(lattice, word, np.log(prob[:, 0]))
        total = total[:-1] + 0.01
        prob[:-1, 0] = total / total.sum()
    return prob[:, 0]


def expected(lattice: Lattice, word: str, log_prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of one word (last: unknown letters)."""
    steps = list(lattice.steps(word))
    alpha, beta = np.full(len(steps) + 1, -np.inf), np.full(len(steps) + 1, -np.inf)
    alpha[0] = beta[-1] = 0.0
    for t, (sizes, ids) in enumerate(steps, 1):
        alpha[t] = log_sum(alpha[t - sizes] + log_prob[ids])
    out = np.zeros(len(log_prob))
    for t in range(len(steps), 0, -1):
        sizes, ids = steps[t - 1]
        step = beta[t] + log_prob[ids]
        out[ids] += np.exp(alpha[t - sizes] + step - alpha[-1])  # a piece ends at a position once
        beta[t - sizes] = np.logaddexp(beta[t - sizes], step)  # so does each length
    return out


class Model:
    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray):
        self.langs, self.pieces, self.prob = langs, pieces, prob
        self.lattice = Lattice(pieces)
        self.log = np.log(prob)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        out = np.empty((len(words), len(self.langs)))
        for part in batches_of(words):
            edges, lens = self.lattice.edges([words[i] for i in part])
            alpha = forward(edges, lens, self.prob)
            out[part] = np.log(alpha[lens, np.arange(len(lens))]) - lens[:, None] * np.log(_SCALE)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.score_long(w)
        return out

    def score_long(self, word: str) -> np.ndarray:
        """As ``score_words``, for one word: a ring of as many states as the longest piece has letters."""
        size = self.lattice.longest + 1
        ring = np.full((size, len(self.langs)), -np.inf)
        ring[0] = 0.0
        t = 0
        for sizes, ids in self.lattice.steps(word):
            t += 1
            ring[t % size] = log_sum(ring[(t - sizes) % size] + self.log[ids])
        return ring[t % size]


class Scorer:
    """Scores texts through a bounded table of words."""

    def __init__(self, model: Model, size: int = CACHE_WORDS):
        self.model, self.size = model, size
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.model.langs)))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.index) > self.size:
            self._clear()
        every = [words_of(x) for x in texts]
        long = [[w for w in ws if len(w) > LONG] for ws in every]  # aren't kept
        words = [[w for w in ws if len(w) <= LONG] if some else ws for ws, some in zip(every, long, strict=True)]
        index = self.index
        had = len(index)
        for ws in words:
            for w in set(ws):
                if w not in index:
                    index[w] = len(index)
        if len(index) > had:
            while len(self.table) < len(index):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            new = list(index)[had:]
            self.table[had : len(index)] = self.model.score_words(new)
        langs, scores = [], []
        for ws, some in zip(words, long, strict=True):
            if not (ws or some) or not self.model.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0)
            for w, n in Counter(some).items():
                total = total + n * self.model.score_long(w)
            best = int(total.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores


def fit(labelled: DataFrame, vocabulary_path: str, max_docs: int = MAX_DOCS) -> Model:
    """Learn from (text, lang) rows: all words of about ``max_docs`` documents of each language."""
    counted = {r.lang: r["count"] for r in labelled.where("lang IS NOT NULL").groupBy("lang").count().collect()}
    langs = sorted(counted)
    if not langs:
        return Model([], [_START], np.ones((2, 0)))
    share = {k: min(1.0, max_docs / n) for k, n in counted.items()}
    sample = labelled.select("lang", "text").sampleBy("lang", share, seed=11)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(seen, pa.string()), "words": pa.array(map(list, seen.values()), pa.list_(pa.string())), "n": pa.array([list(x.values()) for x in seen.values()], pa.list_(pa.int64()))})

    pieces = vocabulary(vocabulary_path)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        seen: Counter = Counter()
        for words, n in zip(rows["words"], rows["n"], strict=True):
            for w, k in zip(words, n, strict=True):
                seen[w] += int(k)
        words = sorted(seen)
        prob = fit_one(Lattice(pieces), len(pieces), words, np.array([seen[w] for w in words], float)) if words else np.full(len(pieces) + 1, 1.0 / len(pieces))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "prob": [prob.tobytes()]})

    # a task's words of a language are one row, and a language's rows hold the sampled documents' words
    counts = sample.mapInArrow(tally, "lang string, words array<string>, n array<bigint>")
    found = {r.lang: np.frombuffer(r.prob) for r in counts.groupBy("lang").applyInPandas(learn, "lang string, prob binary").collect()}  # a row for each language
    uniform = np.full(len(pieces) + 1, 1.0 / len(pieces))  # no document of a language was drawn
    prob = np.stack([found.get(k, uniform) for k in langs], 1)
    mean = prob[:-1].mean(1, keepdims=True)
    prob[:-1] = 0.98 * prob[:-1] + 0.02 * mean  # no piece is impossible in a language
    prob[-1] = _UNKNOWN
    return Model(langs, pieces, prob)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; text is the only column that counts."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.langs, model.pieces, model.prob)))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = worker_state(key, lambda: Scorer(Model(*pickle.loads(shared.value))))
        for whole in batches:
            texts = texts_of(whole)
            at = whole.schema.get_field_index("text")
            for lo, hi in slices(texts):
                langs, scores = score(texts[lo:hi])
                b = whole.slice(lo, hi - lo)
                columns = [c for i, c in enumerate(b.columns) if i != at] + [pa.array(langs), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n in b.schema.names if n != "text"] + ["lang_pred", "score"])

    own = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", lang_pred string, score double"
    return docs.select(*[f"`{f.name}`" for f in own], "text").mapInArrow(run, ddl)
