"""Document fingerprints by order MinHash.

Every k-mer of a text (``K`` code points) gets the number of its earlier
occurrences.  For each of ``TUPLES`` hash functions the ``KEEP`` smallest numbered
k-mers are chosen, put back in text order and hashed together, so a fingerprint
follows the order of the text as edit distance does, not only its k-mer set.

A text shorter than K is one k-mer; one with fewer k-mers than KEEP keeps all of
them; the empty text (also null) has the fingerprint of no k-mer.  Likeness is the share of
equal tuples to the power 1 / KEEP, an estimate of the weighted Jaccard index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import mix64, texts_of

K = 8  # a power of two: hashes of 2, 4, 8 code points are put together
KEEP = 2
TUPLES = 32
_U = np.uint64
_ODD = (np.random.default_rng(77).integers(0, 2**31, TUPLES, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_POS = _U((1 << 24) - 1)
_LOWEST = -(2**63)


def _kmers(text: str) -> np.ndarray:
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (h + _U(1)) * _U(0xD6E8FEB86659FD93)
    step = 1
    while step < K and len(h) > step:
        h = h[:-step] * _U(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    return mix64(h) if step == K else mix64(np.add.reduce(h * (np.arange(len(h), dtype=np.uint64) * _U(2) + _U(3)), keepdims=True) + _U(len(text)))


def _numbered(kmer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer, position, 32-bit hash of k-mer and occurrence number), in any order."""
    n = len(kmer)
    kmer = kmer & ~_POS  # whatever the text's length, so that all texts have the same hashes
    if n <= int(_POS):
        key = np.sort(kmer | np.arange(n, dtype=np.uint64))
        pos, kmer = (key & _POS).astype(np.int64), key & ~_POS
    else:
        pos = np.argsort(kmer, kind="stable")
        kmer = kmer[pos]
    at = np.arange(n)
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(kmer[1:], kmer[:-1], out=head[1:])
    number = at - np.maximum.accumulate(np.where(head, at, 0))
    mixed = kmer + number.astype(np.uint64) * _U(0xA0761D6478BD642F)
    mixed ^= mixed >> _U(29)
    return kmer, pos, ((mixed * _U(0xBF58476D1CE4E5B9)) >> _U(32)).astype(np.uint32)


def _smallest(x: np.ndarray, pos: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the ``keep`` smallest of each hash function: TUPLES rows."""
    n = len(x)
    bound = min(1.0, 20.0 / n)
    while True:
        limit = np.uint32(min(2**32 - 1, int(bound * 2**32)))
        rows, cols, vals = [], [], []
        for lo in range(0, n, 8192):
            h = x[None, lo : lo + 8192] * _ODD[:, None]
            r, c = np.divmod(np.flatnonzero((h <= limit).reshape(-1)), h.shape[1])
            rows.append(r)
            cols.append(c + lo)
            vals.append(h[r, c])
        r, c, v = (np.concatenate(y) for y in (rows, cols, vals))
        if np.bincount(r, minlength=TUPLES).min() >= min(keep, n) or limit == 2**32 - 1:
            break
        bound = min(1.0, bound * 4)
    if n > 8192:
        back = np.argsort(r, kind="stable")
        r, c, v = r[back], c[back], v[back]
    key = (v.astype(np.uint64) << _U(32)) | np.arange(len(v), dtype=np.uint64)  # candidates are in a fixed order for a text
    heads = np.searchsorted(r, np.arange(TUPLES))
    out = np.empty((TUPLES, keep), np.int64)
    for k in range(keep):
        best = (np.minimum.reduceat(key, heads) & _U(0xFFFFFFFF)).astype(np.int64)
        out[:, k] = c[best]
        key[best] = _U(2**64 - 1)
    return out


def signature(text: str) -> np.ndarray:
    """TUPLES 32-bit tuple hashes."""
    if not text:
        return np.zeros(TUPLES, np.uint32)
    kmer, pos, x = _numbered(_kmers(text))
    keep = min(KEEP, len(x))
    at = _smallest(x, pos, keep)
    at = np.take_along_axis(at, np.argsort(pos[at], axis=1), axis=1)
    h = np.full(TUPLES, keep, np.uint64)
    for k in range(keep):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + kmer[at[:, k]])
    return (h >> _U(32)).astype(np.uint32)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b) ** (1.0 / KEEP))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (with a text column) and column ``fingerprint``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [as_text(signature(x)) for x in texts_of(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, "fingerprint"])

    own = docs.drop("fingerprint")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{ddl}, fingerprint string")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, nth, tail, doc_id, text): parts hold ranges of doc_id, in descending order within.

    Each part also gets a copy (``tail``) of the row that follows its last one:
    the first row of the next part, or of the first part after the last.  Null
    doc_ids come last, equal doc_ids in the order of their texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = F.coalesce("doc_id", F.lit(_LOWEST))
    edges = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.002) if parts > 1 else []
    edges = np.unique(np.array(edges, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(np.int64), "right").astype(np.int32))

    placed = docs.withColumn("at", at).withColumn("part", part_of("at"))
    first = {r.part: r.at for r in placed.groupBy("part").agg(F.max("at").alias("at")).collect()}  # a row for each part
    held = sorted(first)
    copied = np.array([first[p] for p in held], np.int64)  # ascending, as parts are
    target = np.array([*held[1:], *held[:1]], np.int32)

    @F.pandas_udf("int")
    def copy_to(x: pd.Series) -> pd.Series:
        ids = x.to_numpy(np.int64)
        nth = np.minimum(np.searchsorted(copied, ids), len(copied) - 1)
        return pd.Series(np.where(copied[nth] == ids, target[nth], -1).astype(np.int32))

    rows = placed.withColumn("to", copy_to("at"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    copy = F.struct(F.col("to").alias("part"), F.lit(True).alias("tail"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("to") >= 0, F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select("place.part", "place.tail", "at", "doc_id", "text")
    return rows.repartitionById(len(edges) + 1, "part").sortWithinPartitions("part", "tail", F.desc("at"), "text")


def compare_edited(docs: DataFrame, parts: int) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last half (rounded down) of the code points replaced by
    the first as many of the next document in descending order of doc_id.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def row(doc, text: str, sig: np.ndarray, after: str, after_sig: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        esig = sig if edited == text else signature(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(text), sha, as_text(sig), as_text(esig), likeness(sig, esig), likeness(sig, after_sig)

    def made(out: list[tuple]) -> pa.RecordBatch:
        ids, *rest = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, rest)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, False
        out: list[tuple] = []
        for b in batches:
            for tail, doc, text in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), texts_of(b), strict=True):
                if done:  # further rows that tie with the tail
                    continue
                sig = signature(text)
                if last is not None:
                    out.append(row(*last, text, sig))
                last, done = (doc, text, sig), tail
                if len(out) >= 500:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, parts).mapInArrow(run, ddl)
