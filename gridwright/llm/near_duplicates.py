"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of shingles (``SHINGLE`` words; a text with fewer words, but not
none, is one shingle); linked are those with a Jaccard index of at least ``THRESHOLD``.

1. Texts of equal words collapse into one *node* (with its number of documents).
   A node has ``HASHES`` MinHash values of 16 bits, four to a band.
2. Nodes that agree in a band are candidates.  A band's members are compared in
   blocks of about ``BLOCK`` (by hash), MinHash values ``STEP`` at a time; a pair is dropped as soon as the
   posterior probability that its index reaches the threshold (uniform prior)
   falls below ``TOLERANCE``.  What is kept is not listed: each block only says
   which nodes hang together.
3. Within each connected class the pairs are pruned in the same way and the rest
   are verified exactly, on 64-bit hashes of all shingles.  Counts of links and a
   spanning forest of the verified pairs leave a task, never the pairs.
4. The components of the verified pairs are the classes.

At the threshold itself a pair misses all bands with probability 3e-6 (lost only if nothing
else holds the two in one class) and is pruned with less than 1e-6.  Verification grows with the square of the
number of *different* near-identical texts in one class, since links are counted one by one; it is
dealt out by pairs of blocks.

Null texts and texts without words have no shingles, so no links; equal rows are
documents of their own and link to each other.  class_id is the smallest doc_id of the class
(null only where all of them are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import as_signed, bytes_of, fresh, materialize, mix64, powers, scan_words, slices
from gridwright.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-10
BLOCK = 256
_U = np.uint64
_RNG = np.random.default_rng(9)
_MULT = (_RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_MIX = _RNG.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) | _U(1)


# ------------------------------------------------------------------ sketches
def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit shingles of all texts, offset of each text's, words of each text, fingerprint of its words)."""
    _, _, h, offsets, _ = scan_words(texts)
    words = np.diff(offsets)
    many = np.where(words >= SHINGLE, words - SHINGLE + 1, (words > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(many)])
    rows = np.arange(starts[-1]) - np.repeat(starts[:-1], many) + np.repeat(offsets[:-1], many)
    out = np.zeros(len(rows), np.uint64)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    room = np.repeat(offsets[1:], many) - rows
    for k in range(SHINGLE):
        out += np.where(room > k, padded[rows + k], _U(0)) * _MIX[k]
    out = mix64(out + np.minimum(room, SHINGLE).astype(np.uint64) * _MIX[SHINGLE])
    mark = np.zeros(len(texts), np.uint64)
    if len(h):
        pw, inv = powers(len(h))
        full = np.flatnonzero(words)
        mark[full] = np.add.reduceat(mix64(h) * pw, offsets[:-1][full]) * inv[offsets[:-1][full]]
        mark = mix64(mark + words.astype(np.uint64))
    return out, starts, words, mark


def sketch(shingle: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of 16 bits, a row for each text; zero for a text without shingles."""
    n = len(starts) - 1
    out = np.zeros((n, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        x = (shingle >> _U(32)).astype(np.uint32)
        heads = starts[:-1][full]
        for j, a in enumerate(_MULT):
            low = np.minimum.reduceat(x * a, heads)
            out[full, j] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """The values of each band side by side, as one 64-bit number."""
    return np.ascontiguousarray(sig).view(np.int64)


# ------------------------------------------------------------------ Bayesian pruning
def least_matches(hashes: int = HASHES, step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After step, 2 * step, ... hashes: the least number of matches that keeps a pair.

    With a uniform prior, P(index >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    from math import comb

    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


_LEAST = least_matches()


def prune(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of ``sig``) that stay likely enough while more and more hashes are compared."""
    matches = np.zeros(len(left), np.int16)
    for k, least in enumerate(_LEAST):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (sig[left, part] == sig[right, part]).sum(1, dtype=np.int16)
        keep = matches >= least
        left, right, matches = left[keep], right[keep], matches[keep]
        if not len(left):
            break
    return left, right


def _pairs(n: int, cut: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows below ``n``: all (cut 0) or those across ``cut``; a few ten thousand at a time."""
    rows = max(1, 65_536 // max(1, n))
    for lo in range(0, cut or n, rows):
        i = np.arange(lo, min(lo + rows, cut or n))
        left, right = np.repeat(i, n), np.tile(np.arange(n), len(i))
        keep = right >= cut if cut else right > left
        yield left[keep], right[keep]


class Forest:
    """Union-find over the rows of one task's block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(i, self.find(i)) for i in range(len(self.up)) if self.find(i) != i]


# ------------------------------------------------------------------ in Spark
def _sketches(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("node", pa.int64()), ("words", pa.int64()), ("sig", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = bytes_of(whole)
            for lo, hi in slices(texts, 2_000_000):
                shingle, starts, words, mark = shingles(texts[lo:hi])
                sig = bands(sketch(shingle, starts))
                b = whole.slice(lo, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(as_signed(mark)), pa.array(words.astype(np.int64)), lists], schema=schema)

    return docs.select("doc_id", "tk", "text").mapInArrow(run, "doc_id long, tk long, node long, words long, sig array<bigint>")


def _blocked(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of keys with two rows or more, with (ba, bb): the pairs of blocks that a row takes part in.

    A row's block is a hash of its node, so no key's rows have to meet to be numbered: sizes are counts that are
    combined before they move, and are stored, so that both sides of the join are plain shuffles whose hot partitions Spark can split.
    """
    sizes = materialize(rows.groupBy(key).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    rows = rows.join(sizes.withColumnRenamed(key, "k"), F.col(key) == F.col("k"))
    blocks = F.ceil(F.col("size") / block)
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), blocks).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda o: F.struct(F.least("own", o).alias("ba"), F.greatest("own", o).alias("bb")))
    return rows.withColumn("meet", F.explode(meet)).select("*", "meet.ba", "meet.bb").drop("meet", "size", "k")


_EDGE = "a long, b long"


def _candidate_edges(nodes: DataFrame, block: int) -> DataFrame:
    """Edges (a, b) that hold together what banding and pruning leave as candidates."""
    keyed = nodes.select("node", F.posexplode("sig").alias("band", "value"))
    keyed = keyed.select("node", F.xxhash64("band", "value").alias("key"))
    members = _blocked(keyed, "key", block).join(nodes.select("node", "sig"), "node")

    def judge(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        rows.sort(key=lambda x: (x[0], x[1]))  # block, node
        cut = next((i for i, x in enumerate(rows) if x[0] != rows[0][0]), 0)
        if rows[0][3] and not cut:  # only one of two blocks: nothing across
            return []
        sig = np.array([x[2] for x in rows], np.int64).view(np.uint16).reshape(len(rows), HASHES)
        forest = Forest(len(rows))
        for left, right in _pairs(len(rows), cut):
            forest.join(*prune(sig, left, right))
        return [(rows[i][1], rows[j][1]) for i, j in forest.edges()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(6)]
            for key, ba, bb, own, node, sig in zip(*columns, strict=True):
                if (key, ba, bb) != now:
                    out += judge(held)
                    now, held = (key, ba, bb), []
                held.append((own, node, sig, ba != bb))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        out += judge(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    dealt = members.select("key", "ba", "bb", "own", "node", "sig").repartition("key", "ba", "bb").sortWithinPartitions("key", "ba", "bb")
    return dealt.mapInArrow(run, _EDGE)


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of shingles."""
    n = len(sets)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1
    who, number = who[shared], number[shared]
    out = np.zeros((n, n), np.float64)
    if len(number):
        number = np.cumsum(np.concatenate([[True], number[1:] != number[:-1]])) - 1
        for lo in range(0, int(number[-1]) + 1, columns):
            a, b = np.searchsorted(number, [lo, lo + columns])
            m = np.zeros((n, columns), np.float32)
            m[who[a:b], number[a:b] - lo] = 1
            out += m @ m.T
    return out


def _verify(rows: list[tuple]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(spanning edges, (node, documents linked)) of one pair of blocks; rows: block, node, documents, text, two blocks?"""
    rows.sort(key=lambda x: (x[0], x[1]))
    rows = [x for i, x in enumerate(rows) if not i or x[1] != rows[i - 1][1]]  # a repeated row comes more than once
    cut = next((i for i, x in enumerate(rows) if x[0] != rows[0][0]), 0)
    if len(rows) < 2 or (rows[0][4] and not cut):
        return [], []
    shingle, starts, _, _ = shingles([x[3] or b"" for x in rows])
    sig = sketch(shingle, starts)
    left, right = [], []
    for i, j in _pairs(len(rows), cut):
        i, j = prune(sig, i, j)
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return [], []
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(len(rows), np.int64)
    place[used] = np.arange(len(used))
    sets = [np.unique(shingle[starts[k] : starts[k + 1]]) for k in used.tolist()]
    size = np.array([len(x) for x in sets], np.float64)
    both = intersections(sets)[place[i], place[j]]
    # index >= 4 / 5, in whole numbers: 5 * both >= 4 * union
    linked = both * 5 >= 4 * (size[place[i]] + size[place[j]] - both)
    i, j = i[linked], j[linked]
    many = np.array([x[2] for x in rows], np.int64)
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, i, many[j])
    np.add.at(links, j, many[i])
    forest = Forest(len(rows))
    forest.join(i, j)
    return [(rows[a][1], rows[b][1]) for a, b in forest.edges()], [(rows[k][1], int(links[k])) for k in np.flatnonzero(links).tolist()]


def _verified(docs: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(a, b, n): spanning edges (n null) and numbers of linked documents (b null) of the classes in ``members``."""
    on = [docs["doc_id"].eqNullSafe(members["doc_id"]), docs["tk"] == members["tk"]]
    rows = docs.join(members, on).select(members["root"], members["ba"], members["bb"], members["own"], members["node"], members["many"], docs["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(6)]
            for root, ba, bb, own, node, many, text in zip(*columns, bytes_of(b), strict=True):
                if (root, ba, bb) != now:
                    yield from made(held)
                    now, held = (root, ba, bb), []
                held.append((own, node, many, text, ba != bb))
        yield from made(held)

    def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        edges, links = _verify(held) if len(held) > 1 else ([], [])
        if edges or links:
            a, b, n = [x for x, _ in edges + links], [x for _, x in edges] + [None] * len(links), [None] * len(edges) + [x for _, x in links]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    return rows.repartition("root", "ba", "bb").sortWithinPartitions("root", "ba", "bb").mapInArrow(run, "a long, b long, n long")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, tk, class_id, n_links, kept) of every row of ``docs``; tk: xxhash64 of the text.

    ``kept`` marks the rows of one document of each class: the smallest (doc_id, tk), a null doc_id last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    rows = materialize(_sketches(docs), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    nodes = rows.where("words > 0").groupBy("node").agg(F.count("*").alias("many"), F.min(rank).alias("rep"), F.first("sig").alias("sig"))
    nodes = materialize(nodes, "nodes")
    candidates = components(_candidate_edges(nodes, block))
    members = _blocked(candidates.join(nodes.select("node", "many", "rep"), "node"), "root", block)
    members = members.select("root", "ba", "bb", "own", "node", "many", "rep.doc_id", "rep.tk")
    checked = materialize(_verified(docs, members, block), "verified")
    root = components(checked.where("b IS NOT NULL").select("a", "b"))
    links = checked.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    full = nodes.select("node", "many", "rep").join(root, "node", "left").join(links, "node", "left")
    full = full.withColumn("root", F.coalesce("root", "node"))
    first = full.groupBy("root").agg(F.min("rep").alias("first"))
    full = full.join(first, "root").select("node", "first", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tk") == F.col("first.tk"))
    out = rows.where("words > 0").join(full, "node").select("doc_id", "tk", F.col("first.doc_id").alias("class_id"), "n_links", kept.alias("kept"))
    alone = rows.where("words = 0").select("doc_id", "tk", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each class; of rows equal in doc_id and text one stays, too."""
    found = near_duplicates(docs.select("doc_id", "text"), block).where("kept")
    keys = found.groupBy("doc_id", "tk").agg(F.count("*").alias("rows"))
    keys = materialize(keys.withColumnsRenamed({"doc_id": "kd", "tk": "kt"}), "kept")
    own, (n,) = [f"`{c}`" for c in docs.columns], fresh(docs, "rows")
    out = docs.join(keys, [docs["doc_id"].cast("long").eqNullSafe(keys["kd"]), F.xxhash64(docs["text"]) == keys["kt"]])
    out = out.select(*[docs[c] for c in own], keys["rows"].alias(n))
    if keys.where("rows > 1").limit(1).count():
        once = out.where(F.col(n) == 1).select(*own)
        again = out.where(F.col(n) > 1).select(*own)
        return once.unionByName(again.dropDuplicates(["doc_id", "text"]))
    return out.select(*own)
