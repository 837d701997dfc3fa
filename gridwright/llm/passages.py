"""Repeated passages: all that is covered by a string of ``length`` units that starts more than once.

Units are bytes (``BYTES``: strings of 400) or words (``WORDS``: strings of 51, that is more than 50;
a word is a run of other than ASCII white space, as it stands, and is told from others by 64 bits).
Below, K and length are counted in units.

Sorting the suffixes of all positions is not needed.  Of each string of ``length`` units one
*anchor* is looked at: the position in it whose ``k`` units have the smallest hash
(leftmost of equals).  Equal strings have their anchors at equal offsets, so two
occurrences always meet at a pair of anchors with equal k units.  About one
position in 185 bytes or 22 words is an anchor.

1. Anchors of every text: hash of the k units, and hash of the context (the units
   of all strings that have this very position as their anchor; they start side by side).
   Each string belongs to one anchor.
2. Anchors whose k units occur once are dropped.  Where all contexts are equal
   every string around them repeats.  Only contexts that differ are compared.
3. The contexts of a group are put in suffix-array order by deep-shallow sorting:
   multikey quicksort down to ``SHALLOW`` bytes, then a blind trie for what still
   agrees; both give the longest common prefixes (LCPs) of neighbours.  The
   reversed left contexts are ordered alike.  A string that starts ``a`` units before the anchor
   repeats if another member shares its run of LCP >= length - a on the right and
   >= a on the left.
4. Groups of more than ``GROUP`` different contexts are not gathered: a hash of each string around
   the anchors is counted over all tasks instead, with the same result.

Null text is empty.  Rows are told apart by doc_id and a hash of the text, so equal
rows are occurrences of their own, each.  Input columns are carried along whatever their names,
but for those that have the name of a column made here: these give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import bytes_of, fresh, materialize, mix64, release, scan_words, slices, written


class Unit(NamedTuple):
    """What passages are counted in."""

    length: int  # units of the shortest passage
    k: int  # units whose hash chooses the anchors; a power of two
    width: int  # bytes of a unit where passages are sorted


BYTES = Unit(400, 32, 1)
WORDS = Unit(51, 8, 8)
SHALLOW = 96
GROUP = 2_000
SEGMENT = 1_000_000
_U = np.uint64
_POS = _U((1 << 24) - 1)
_VALUES = np.random.default_rng(4711).integers(1, 2**63, 256, dtype=np.uint64)


# ------------------------------------------------------------------ anchors
def coded(texts: list[bytes], unit: Unit) -> list[bytes]:
    """The units of each text, ``unit.width`` bytes each."""
    if unit.width == 1:
        return texts
    out = []
    for lo, hi in slices(texts):
        _, _, h, offsets, _ = scan_words(texts[lo:hi], by_space=True)
        raw, ends = h.tobytes(), (offsets * 8).tolist()
        out += [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return out


def _segment_anchors(values: np.ndarray, ends: np.ndarray, starts: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(position, 64-bit hash, fewest and most units before it) of the anchors in ``values``, texts at starts:ends."""
    length = unit.length
    if len(values) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, step = values, 1
    while step < unit.k:
        h = h[:-step] * _U(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    h = mix64(h)
    width = length - unit.k + 1
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-(len(key) + width) // width) * width, _U(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(values) - length + 1
    best = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & _POS).astype(np.int64)
    inside = np.zeros(len(values) + 1, np.int64)
    ok = ends - starts >= length
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, ends[ok] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:n]))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = best[start]
    # the strings with one anchor start side by side, and anchors never go back
    first = np.flatnonzero(np.diff(best, prepend=-1))
    last = np.append(first[1:], len(best)) - 1
    pos = best[first]
    return pos, h[pos], pos - start[last], pos - start[first]


def anchors(texts: list[bytes], unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """(text, position, hash, context hash, fewest, most units of a string before the anchor) of every anchor; ``texts`` are coded."""
    rows = []
    digest = xxhash.xxh3_64_intdigest
    w, length = unit.width, unit.length
    values = (lambda raw: _VALUES[np.frombuffer(raw, np.uint8)]) if w == 1 else lambda raw: np.frombuffer(raw, np.uint64)
    for lo, hi in slices(texts, SEGMENT * w):
        part = texts[lo:hi]
        if hi - lo == 1 and len(part[0]) > 2 * SEGMENT * w:
            # strings that start in different segments may share an anchor: it is listed for each
            raw, starts, ends, found = part[0], np.array([0]), np.array([len(part[0]) // w]), []
            for at in range(0, len(raw) // w, SEGMENT):
                piece = raw[at * w : (at + SEGMENT + length - 1) * w]
                pos, *more = _segment_anchors(values(piece), np.array([len(piece) // w]), np.array([0]), unit)
                found.append((pos + at, *more))
            pos, h, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            raw = b"".join(part)
            sizes = np.fromiter(map(len, part), np.int64, len(part)) // w
            ends = np.cumsum(sizes)
            starts = ends - sizes
            pos, h, low, high = _segment_anchors(values(raw), ends, starts, unit)
        if not len(pos):
            continue
        who = np.searchsorted(ends, pos, "right")
        around = zip(((pos - high) * w).tolist(), ((pos - low + length) * w).tolist(), high.tolist(), strict=True)
        c = np.fromiter((digest(raw[x:y], a) for x, y, a in around), np.uint64, len(pos))
        rows.append((who + lo, pos - starts[who], h, c, low, high))
    if not rows:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*rows, strict=True))


# ------------------------------------------------------------------ deep-shallow sorting
def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """A compacted trie that keeps branching positions and characters only; full strings are compared once an insert."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [len(strings[first]), {}, [first]]  # [depth, children by byte, leaves that end here]

    def insert(self, i: int) -> None:
        s, path, node = self.strings[i], [], self.root
        while True:  # blind descent, by the branching bytes alone
            path.append(node)
            below = node[1].get(s[node[0]]) if len(s) > node[0] else None
            if below is None:
                below = next(iter(node[1].values()), None) if not node[2] else None
                if below is None:
                    break
            node = below
        while not node[2]:
            node = next(iter(node[1].values()))
        other = self.strings[node[2][0]]
        depth = common(s, other)
        above = None
        for node in path:  # the last of them holds a whole string, so one is deep enough
            if node[0] >= depth:
                break
            above = node
        if node[0] == depth:
            if len(s) == depth:
                node[2].append(i)
            else:
                node[1][s[depth]] = [len(s), {}, [i]]
            return
        fork: list = [depth, {other[depth]: node}, []]
        if len(s) == depth:
            fork[2].append(i)
        else:
            fork[1][s[depth]] = [len(s), {}, [i]]
        if above is None:
            self.root = fork
        else:
            above[1][s[above[0]]] = fork

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, LCP with the one before it) in order; the first has LCP -1."""
        stack: list[tuple[list, int]] = [(self.root, -1)]
        while stack:
            node, lcp = stack.pop()
            for i in node[2]:
                yield i, lcp
                lcp = node[0]
            todo = []
            for byte in sorted(node[1]):
                todo.append((node[1][byte], lcp))
                lcp = node[0]
            stack.extend(reversed(todo))


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, LCP of each string in order with the one before; 0 for the first)."""
    order, lcps = [], []
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, 0)]
    while stack:
        own, depth, lcp = stack.pop()  # ``lcp``: of the first of these with what comes before
        if not own:
            continue
        if len(own) == 1:
            order.append(own[0])
            lcps.append(lcp)
            continue
        texts = [strings[i] for i in own]
        depth = common(min(texts), max(texts), depth)  # all of them agree so far
        if depth >= shallow:
            trie = BlindTrie(strings, own[0])
            for i in own[1:]:
                trie.insert(i)
            for i, x in trie.ordered():
                order.append(i)
                lcps.append(lcp if x < 0 else x)
            continue
        at = [s[depth] if len(s) > depth else -1 for s in texts]
        pivot = sorted(at[:: max(1, len(at) // 9)])[len(at[:: max(1, len(at) // 9)]) // 2]
        less, same, more = ([i for i, x in zip(own, at, strict=True) if (x > pivot) - (x < pivot) == side] for side in (-1, 0, 1))
        if pivot < 0:  # these have ended: equal strings
            stack.append((more, depth, depth if same or less else lcp))
            for n, i in enumerate(same):
                order.append(i)
                lcps.append(depth if n else lcp)
            continue
        stack.append((more, depth, depth if same or less else lcp))
        stack.append((same, depth + 1, depth if less else lcp))
        stack.append((less, depth, lcp))
    return np.array(order, np.int64), np.array(lcps, np.int64)


def repeats(lefts: list[bytes], rights: list[bytes], unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest ``a`` (units before the anchor) of a string that another member has, too; -1: none.

    ``lefts`` are read backwards from the anchor.  Both end where the member's strings end.
    """
    n, length = len(lefts), unit.length
    low, high = np.full(n, -1), np.full(n, -1)
    orders = [(order, lcp // unit.width) for order, lcp in map(deep_shallow, (rights, lefts))]
    (by_right, right), (by_left, left) = orders
    if n <= 48:
        share = []
        for order, lcp in orders:
            m = np.zeros((n, n), np.int64)
            for i in range(n - 1):
                m[order[i], order[i + 1 :]] = m[order[i + 1 :], order[i]] = np.minimum.accumulate(lcp[i + 1 :])
            share.append(m)
        r, a = share
        ok = (a + r >= length) & ~np.eye(n, dtype=bool)
        some = ok.any(1)
        low[some] = np.where(ok, length - r, length).min(1)[some]
        high[some] = np.where(ok, a, -1).max(1)[some]
        return low, high
    for a in range(length - max(map(len, rights)) // unit.width, max(map(len, lefts)) // unit.width + 1):
        group = np.empty(n, np.int64)
        group[by_right] = np.cumsum(right < length - a)
        own = np.empty(n, np.int64)
        own[by_left] = np.cumsum(left < a)
        key = group * (n + 1) + own
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(n, bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        low[hit & (low < 0)] = a
        high[hit] = a
    return low, high


# ------------------------------------------------------------------ in Spark
_ANCHOR = "doc_id long, tk long, h long, c long, low int, high int, pos array<bigint>"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchor_rows(docs: DataFrame, unit: Unit) -> DataFrame:
    """Anchors of every text; those of a text that agree in hash and context are one row, with all positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, pos, h, c, low, high = anchors(coded(bytes_of(b), unit), unit)
            if not len(who):
                continue
            order = np.lexsort((pos, c, h, who))
            who, pos, h, c, low, high = (x[order] for x in (who, pos, h, c, low, high))
            fresh = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
            at = pa.array(who[fresh])
            places = pa.ListArray.from_arrays(pa.array(np.append(fresh, len(pos)).astype(np.int32)), pa.array(pos))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), _signed(h[fresh]), _signed(c[fresh]), pa.array(low[fresh].astype(np.int32)), pa.array(high[fresh].astype(np.int32)), places],
                names=["doc_id", "tk", "h", "c", "low", "high", "pos"],
            )

    return docs.select("doc_id", "tk", "text").mapInArrow(run, _ANCHOR)


def _contexts(docs: DataFrame, reps: DataFrame, unit: Unit) -> DataFrame:
    """(h, c, n, large, high, context): the units of all strings around each representative."""
    w, length = unit.width, unit.length
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("large", pa.bool_()), ("high", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, at in zip(coded(bytes_of(b), unit), b.column(b.schema.get_field_index("at")).to_pylist(), strict=True):
                for x in at:
                    p = x["p"]
                    out.append((x["h"], x["c"], x["n"], x["large"], x["high"], text[(p - x["high"]) * w : (p - x["low"] + length) * w]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    by_doc = reps.groupBy("rep.doc_id", "rep.tk").agg(F.collect_list(F.struct(F.col("rep.p").alias("p"), "h", "c", "n", "large", "low", "high")).alias("at"))
    on = [docs["doc_id"].eqNullSafe(by_doc["doc_id"]), docs["tk"] == by_doc["tk"]]
    return docs.join(by_doc, on).select(by_doc["at"], docs["text"]).mapInArrow(run, "h long, c long, n long, large boolean, high int, context binary")


_RESULT = "h long, c long, low int, high int"


def _compare(contexts: DataFrame, unit: Unit) -> DataFrame:
    """(h, c, low, high) of contexts that occur once and share a string with another of their group."""

    def judge(group: dict[int, tuple]) -> list[tuple]:
        rows = list(group.values())
        if len(rows) < 2 or all(x[2] > 1 for x in rows):
            return []
        before = [x[3] * unit.width for x in rows]  # bytes before the anchor
        lefts, rights = [x[4][:a][::-1] for x, a in zip(rows, before, strict=True)], [x[4][a:] for x, a in zip(rows, before, strict=True)]
        low, high = repeats(lefts, rights, unit)
        return [(x[0], x[1], int(a), int(b)) for x, a, b in zip(rows, low, high, strict=True) if a >= 0 and x[2] == 1]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["h", "c", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, {}, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if row[0] != now:
                    out += judge(group)
                    now, group = row[0], {}
                group[row[1]] = row  # a repeated row has its representative more than once
            if len(out) > 5000:
                yield made(out)
                out = []
        out += judge(group)
        if out:
            yield made(out)

    return contexts.select("h", "c", "n", "high", "context").repartition("h").sortWithinPartitions("h").mapInArrow(run, _RESULT)


def _count_strings(contexts: DataFrame, unit: Unit) -> DataFrame:
    """As ``_compare``, for groups of any size: counts a 128-bit hash of every string around the anchors.

    A string has one anchor, so there is a row for each string and none for a pair.
    """
    w, length = unit.width, unit.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, c, n, a, s = [], [], [], [], []
            for i, j, k, high, context in zip(*(b.column(x).to_pylist() for x in range(5)), strict=True):
                many = len(context) // w - length + 1
                h += [i] * many
                c += [j] * many
                n += [k] * many
                a += range(high, high - many, -1)
                s += [xxhash.xxh3_128_digest(context[x * w : (x + length) * w]) for x in range(many)]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int32()), pa.array(s, pa.binary())], names=["h", "c", "n", "a", "s"])

    own = contexts.dropDuplicates(["h", "c"]).select("h", "c", "n", "high", "context")
    rows = materialize(own.mapInArrow(run, "h long, c long, n long, a int, s binary"), "strings")
    often = materialize(rows.groupBy("s").agg(F.sum("n").alias("k")).where("k > 1").select("s"), "often")
    hit = rows.where("n = 1").join(often, "s")
    return hit.groupBy("h", "c").agg(F.min("a").cast("int").alias("low"), F.max("a").cast("int").alias("high"))


def repeated_spans(docs: DataFrame, unit: Unit = BYTES, group: int = GROUP) -> DataFrame:
    """(doc_id, tk, spans): the repeated strings, as ranges of units; texts without any are left out.

    What is joined back is stored first, so that both sides of each join are plain
    shuffles, whose hot partitions Spark can split.
    """
    found = materialize(_anchor_rows(docs, unit), "anchors")
    by_h = found.groupBy("h").agg(F.sum(F.size("pos")).alias("n"), (F.min("c") != F.max("c")).alias("differ")).where("n > 1")
    kept = materialize(found.join(materialize(by_h.select("h", "differ"), "hashes"), "h"), "shared")
    differ = kept.where("differ")
    classes = materialize(
        differ.groupBy("h", "c").agg(
            F.sum(F.size("pos")).alias("n"),
            F.min(F.struct("doc_id", "tk", F.col("pos")[0].alias("p"))).alias("rep"),
            F.first("low").alias("low"),
            F.first("high").alias("high"),
        ),
        "classes",
    )
    large = materialize(classes.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > group).select("h", F.lit(True).alias("large")), "large")
    reps = classes.join(large, "h", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    contexts = materialize(_contexts(docs, reps, unit), "contexts")
    judged = _compare(contexts.where("NOT large"), unit)
    if large.limit(1).count():
        judged = judged.unionByName(_count_strings(contexts.where("large"), unit))
    judged = materialize(judged.unionByName(classes.where("n > 1").select("h", "c", "low", "high")), "judged")
    # all contexts equal: every string around the anchor repeats
    alike = kept.where("NOT differ").select("doc_id", "tk", "pos", "low", "high")
    other = differ.drop("low", "high").join(judged, ["h", "c"]).select("doc_id", "tk", "pos", "low", "high")
    spans = F.transform("pos", lambda p: F.struct((p - F.col("high")).alias("start"), (p - F.col("low") + unit.length).alias("end")))
    every = alike.unionByName(other).select("doc_id", "tk", spans.alias("spans"))
    return every.groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def union_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans or [], key=lambda x: x["start"]):
        if out and x["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["end"]))
        else:
            out.append((x["start"], x["end"]))
    return out


def in_bytes(text: bytes, runs: list[tuple[int, int]], unit: Unit) -> list[tuple[int, int]]:
    """Runs of units as runs of bytes; white space after a run of words belongs to it."""
    if unit.width == 1 or not runs:
        return runs
    starts = [*scan_words([text], by_space=True)[0].tolist(), len(text)]
    return [(starts[lo], starts[hi]) for lo, hi in runs]


def remove_repeats(docs: DataFrame, unit: Unit = BYTES, keep_text: bool = False, group: int = GROUP, count_words: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept_sha256; with ``keep_text`` its text is what is left (null stays null).

    What is left is cut at bytes; characters that a cut goes through are dropped from the text.  ``count_words`` adds
    n_repeated_words: the words in passages of more than 50 words that occur again, which are found
    by a pass of their own and removed only so far as ``unit`` says so.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_repeated_words"] * count_words
    spark = docs.sparkSession
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in names])
    own = docs.schema.fields
    tk, found_in, words_in = fresh(docs, "tk", "spans", "word_spans")
    docs = docs.withColumn(tk, F.xxhash64("text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(tk).alias("tk"), "text")

    def on(spans: DataFrame) -> list[Column]:
        return [docs["doc_id"].cast("long").eqNullSafe(spans["doc_id"]), docs[tk] == spans["tk"]]

    if count_words:
        mark = written()
        by_word = materialize(repeated_spans(keyed, WORDS, group), "word-spans")
        release(spark, mark, keep=1)
    spans = repeated_spans(keyed, unit, group)
    both, found = docs.join(spans, on(spans), "left"), [spans["spans"].alias(found_in)]
    if count_words:
        both, found = both.join(by_word, on(by_word), "left"), [*found, by_word["spans"].alias(words_in)]
    both = both.select(*[docs[f"`{f.name}`"] for f in own], *found)
    out = [f for f in own if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = {k: [] for k in (*names, "text")}
            whole = b.column(b.schema.get_field_index("text"))
            for text, none, found in zip(bytes_of(b), whole.is_null().to_pylist(), b.column(b.schema.get_field_index(found_in)).to_pylist(), strict=True):
                runs = in_bytes(text, union_spans(found), unit)
                at, kept = 0, []
                for lo, hi in runs:
                    kept.append(text[at:lo])
                    at = hi
                left = b"".join([*kept, text[at:]])
                made["n_bytes"].append(len(text))
                made["n_removed"].append(len(text) - len(left))
                made["n_spans"].append(len(runs))
                made["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    made["text"].append(None if none else left.decode("utf-8", "ignore"))
            if count_words:
                made["n_repeated_words"] = [sum(hi - lo for lo, hi in union_spans(x)) for x in b.column(b.schema.get_field_index(words_in)).to_pylist()]
            columns = [pa.array(made["text"], pa.string()) if f.name == "text" else b.column(b.schema.get_field_index(f.name)) for f in out]
            columns += [pa.array(made[k], pa.string() if k == "kept_sha256" else pa.int64()) for k in names]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in out), *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated_words long" * count_words
    return both.mapInArrow(run, ddl)
