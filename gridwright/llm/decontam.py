"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

Words are runs of 0-9, a-z and bytes above 0x7F after A-Z became a-z.  A window is
``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is
one window.  A document's words are streamed through the automaton of all items
(states, suffix links and transitions over word numbers), which keeps the longest
length that matches up to each word; where it reaches a window, the window's words
are hit and the items that hold it are noted.

Two exact filters keep most words from the automaton: words that no item has, and
pairs of neighbours that no item has side by side.  Only runs of such pairs as
long as the shortest window are streamed.

The benchmark is read in shards of at most ``SHARD_WORDS`` words; a shard's
automaton is broadcast, so its size is bounded, and further shards take further
passes over the documents.

Null text has no words; repeated rows are judged one by one; items of equal
item_id count once; a null item_id is written as ''.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import bytes_of, materialize, scan_words, slices

WINDOW = 13
SHARD_WORDS = 1_000_000
MAX_COVERAGE = 20  # contaminated: at least one word in so many is hit


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.len, self.link, self.next = [0], [-1], [{}]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items: dict[int, set[str]] = {}  # of states that stand for a full window
        self.short: dict[int, list[tuple[int, str]]] = {}  # length and item of shorter ones
        for name, words in items:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.next[state][w]
                if n >= window:
                    self.items.setdefault(self.above(state, window), set()).add(name)
            if 0 < len(words) < window:
                self.short.setdefault(self.above(state, len(words)), []).append((len(words), name))
        #: the nearest state with a short item, from each state on up the suffix links
        self.up = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            if s:
                self.up[s] = s if s in self.short else self.up[self.link[s]]

    def above(self, state: int, n: int) -> int:
        """The state that holds the last ``n`` words of what ``state`` stands for."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # the words so far are known from another item
            q = self.next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        new = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges (first word, end) in ``words``, ascending, and the items hit."""
        state = size = 0
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for at, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.len[state]
            if w not in self.next[state]:
                state = size = 0
                continue
            state, size = self.next[state][w], size + 1
            longest = 0
            if size >= self.window:
                longest = self.window
                found |= self.items[self.above(state, self.window)]
            s = self.up[state]
            while s > 0:
                for n, name in self.short[s]:
                    if n <= size:
                        longest = max(longest, n)
                        found.add(name)
                s = self.up[self.link[s]]
            if longest:
                first = at - longest
                while spans and first <= spans[-1][1]:
                    first = min(first, spans.pop()[0])
                spans.append((first, at))
        return spans, found


class Matcher:
    """The automaton behind its two filters."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        starts, ends, hashes, offsets, raw = scan_words([text for _, text in items])
        words = [raw[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        number: dict[bytes, int] = {}
        for w in words:
            number.setdefault(w, len(number))
        ids = [number[w] for w in words]
        by_item = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.words = list(number)
        first = {number[w]: h for w, h in reversed(list(zip(words, hashes.tolist(), strict=True)))}
        keys = np.array([first[i] for i in range(len(number))], np.uint64)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order.astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> np.uint64(44)).astype(np.int64)] = True
        pairs = {a * len(number) + b for x in by_item for a, b in zip(x, x[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.shortest = min([window, *(len(x) for x in by_item if x)])
        self.automaton = Automaton([(name, x) for (name, _), x in zip(items, by_item, strict=True)], window)

    def match(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]]:
        """For each text: words, hit word ranges, items hit, the same ranges in bytes."""
        starts, ends, hashes, offsets, raw = scan_words(texts)
        out = [(int(n), [], set(), []) for n in np.diff(offsets)]
        if not len(self.keys) or not len(starts):
            return out
        number = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[at] == hashes[maybe]
        number[maybe[same]] = self.numbers[at[same]]
        known = number >= 0
        if self.shortest > 1:
            pair = np.where(known[:-1] & known[1:], number[:-1] * len(self.words) + number[1:], -1)
            cuts = offsets[1:-1]
            pair[cuts[(cuts > 0) & (cuts < len(hashes))] - 1] = -1
            where = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
            linked = self.pairs[where] == pair if len(self.pairs) else np.zeros(len(pair), bool)
            edge = np.flatnonzero(np.diff(linked.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            runs = [(a, b + 1) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= self.shortest - 1]
        else:  # windows of one word: every known word is streamed, text by text
            edge = np.flatnonzero(np.diff(known.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            cuts = offsets[1:-1].tolist()
            runs = []
            for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                inner = [c for c in cuts[np.searchsorted(cuts, a, "right") :][: np.searchsorted(cuts, b) + 1] if a < c < b] if cuts else []
                runs += list(zip([a, *inner], [*inner, b], strict=True))
        for a, b in runs:
            ids = [
                i if raw[s:e].lower() == self.words[i] else -1
                for i, s, e in zip(number[a:b].tolist(), starts[a:b].tolist(), ends[a:b].tolist(), strict=True)
            ]
            spans, found = self.automaton.stream(ids)
            if spans:
                doc = int(np.searchsorted(offsets, a, "right")) - 1
                base = sum(len(x) + 1 for x in texts[:doc])
                for lo, hi in spans:
                    out[doc][1].append((a + lo - int(offsets[doc]), a + hi - int(offsets[doc])))
                    out[doc][3].append((int(starts[a + lo]) - base, int(ends[a + hi - 1]) - base))
                out[doc][2].update(found)
        return out


def shards(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items of at most ``limit`` words together; an item is never cut."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        text = (row.text or "").encode()
        words = len(scan_words([text])[0])
        if held and size + words > limit:
            yield held
            held, size = [], 0
        held.append((row.item_id or "", text))
        size += words
    if held:
        yield held


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPAN_DDL = "array<struct<start: bigint, end: bigint>>"


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with n_words, hit_words (ranges of words), hit_bytes (the same in UTF-8 bytes) and items."""
    spark = docs.sparkSession
    own = [f for f in docs.schema.fields if f.name not in ("n_words", "hit_words", "hit_bytes", "items")]
    df = docs.select(*[f"`{f.name}`" for f in own])
    df = df.selectExpr("*", "0L AS n_words", f"CAST(array() AS {_SPAN_DDL}) AS hit_words", f"CAST(array() AS {_SPAN_DDL}) AS hit_bytes", "CAST(array() AS array<string>) AS items")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    todo = shards(benchmark, shard_words)
    items, nth = next(todo, []), 0
    while items is not None:
        after = next(todo, None)  # the driver holds one automaton and two shards' texts, however large the benchmark
        shared = spark.sparkContext.broadcast(pickle.dumps(Matcher(items, window)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, nth=nth) -> Iterator[pa.RecordBatch]:
            matcher = pickle.loads(shared.value)
            for whole in batches:
                sizes = bytes_of(whole)
                for lo, hi in slices(sizes):
                    b = whole.slice(lo, hi - lo)
                    got = matcher.match(sizes[lo:hi])
                    names = b.schema.names
                    before = {k: b.column(names.index(k)).to_pylist() for k in ("hit_words", "hit_bytes", "items")} if nth else None
                    made = {"n_words": pa.array([x[0] for x in got], pa.int64())}
                    for name, k in (("hit_words", 1), ("hit_bytes", 3)):
                        spans = [x[k] for x in got]
                        if before:
                            spans = [_union(x + [(y["start"], y["end"]) for y in old]) for x, old in zip(spans, before[name], strict=True)]
                        made[name] = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPAN)
                    items = [x[2] | set(old) for x, old in zip(got, before["items"], strict=True)] if before else [x[2] for x in got]
                    made["items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([made.get(n, c) for n, c in zip(names, b.columns, strict=True)], names=names)

        df = df.mapInArrow(run, ddl)
        if after is not None:
            df = materialize(df, "hits")
            shared.destroy()
        items, nth = after, nth + 1
    return df


def judge(hits: DataFrame, coverage: int = MAX_COVERAGE) -> DataFrame:
    """``hits`` with n_hit and contaminated."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", F.expr(f"n_hit > 0 AND {coverage} * n_hit >= n_words"))


def cut_spans(hits: DataFrame) -> DataFrame:
    """``hits`` with column ``clean_text``: the text without its hit spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(bytes_of(b), b.column(b.schema.get_field_index("hit_bytes")).to_pylist(), strict=True):
                at, kept = 0, []
                for x in spans:
                    kept.append(text[at : x["start"]])
                    at = x["end"]
                out.append(b"".join([*kept, text[at:]]).decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "clean_text"])

    own = hits.drop("clean_text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{ddl}, clean_text string")


def digest(judged: DataFrame) -> DataFrame:
    items = F.array_join(F.array_sort("items"), ",")
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(items, "UTF-8"), 256).alias("items_sha256"),
        "contaminated",
    )


def sha256_of(items: list[str]) -> str:
    """What ``digest`` gives for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
