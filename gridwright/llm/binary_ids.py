"""Token ids on disk: canonical length-limited Huffman code, independent blocks, bit-offset checkpoints.

1. ``encode`` turns texts into ids (two bytes each where the vocabulary allows).
   Pre-tokens are encoded once per worker and kept in a bounded cache.
2. The encoded documents are dealt out by ranges of doc_id, sorted, and stored
   (``ids``): that is also the only shuffle.
3. Counts of ids are summed over all documents (at most one row for each id and
   task), code lengths come from package-merge with the limit ``MAX_BITS``.
4. ``write`` packs blocks of about ``BLOCK_IDS`` ids.  A block is one row of a
   Parquet file and needs nothing but the codebook to be read: doc_ids and lengths of its
   documents, the global index of its first id, a bit offset for each
   ``CHECKPOINT`` ids and the bits.  Files and rows are in ascending doc_id order
   (null first; equal doc_ids in the order of their ids).
5. ``read`` decodes all checkpoints of a block side by side by table look-up.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import Cache, materialize, texts_of, worker_state

MAX_BITS = 18
BLOCK_IDS = 65_536
CHECKPOINT = 128
CACHE_SIZE = 800_000

# ------------------------------------------------------------------ text to ids
#: A run of white space and what follows it: nothing is merged across its ends.
_UNIT = re.compile(r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+")
#: White space beyond ASCII, or taken for it by some: such texts go to the library whole.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")


def _ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings of the vocabulary by id, if ids stand in the order of the merges."""
    import json

    from tokenizers.pre_tokenizers import ByteLevel

    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(vocab.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)) or len(ByteLevel.alphabet()) != 256:
        return None
    byte = {c: bytes([i]) for i, c in _byte_letters().items()}
    return {b"".join(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges) and all(c in byte for c in t)}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it can be seen, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in seen]
    return {i: chr(i) for i in seen} | {i: chr(256 + n) for n, i in enumerate(rest)}


#: Where none of these stands, white space is a single space or line break, or two breaks before a word.
_IRREGULAR = ["  ", " \n", "\n ", "\n\n\n", "\t", "\r", "\v", "\f"]


class Encoder:
    """Ids of texts as the library gives them, pre-token by pre-token through a bounded cache.

    Where the vocabulary's ids stand in merge order, pre-tokens that the cache does
    not hold go to the byte-pair merger of tiktoken with the same vocabulary, which
    is faster for short strings; tests hold it against the library.
    """

    def __init__(self, path: str, size: int = CACHE_SIZE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 65_536 else np.dtype("<u4")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if ranks := _ranks(path):
            import public_tokenizers
            import tiktoken

            merger = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            make = lambda u: array(code, merger.encode_ordinary(u)).tobytes()
        else:
            make = self.whole
        code = "H" if self.kind.itemsize == 2 else "I"
        # keys: 'x' stands for a space and x, '\nx' for itself, '\0x' for x without a space
        self.known = Cache(lambda k: make(k[1:] if k[:1] == "\0" else k if k[:1] == "\n" else " " + k), size)
        self.units = Cache(make, size)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def one(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if any(x in text for x in _IRREGULAR) or text.endswith("\n\n") or "\0" in text:
            return b"".join(map(self.units.__getitem__, _UNIT.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.known["\0" + first] if first else b"") + b"".join(map(self.known.__getitem__, rest))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.one(x) for x in texts]


def _encoder(path: str) -> Encoder:
    return worker_state(("ids", path), lambda: Encoder(path))


def kind_of(tokenizer: str) -> str:
    """How ids are held before they are packed: '<u2' or '<u4'."""
    return _encoder(tokenizer).kind.str


def encode(docs: DataFrame, tokenizer: str, end_id: int, parts: int) -> DataFrame:
    """(part, doc_id, n, ids) stored in ascending doc_id order: part, then doc_id, then ids."""
    kind = _encoder(tokenizer).kind
    end = np.array([end_id], kind).tobytes()
    edges = docs.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.002) if parts > 1 else []
    edges = np.unique(np.array(edges, np.float64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                x = b.slice(lo, 200)
                ids = [y + end for y in enc(texts_of(x))]
                doc = x.column(0)
                part = np.searchsorted(edges, doc.fill_null(-(2**63)).to_numpy(), "right").astype(np.int32)
                n = [len(y) // kind.itemsize for y in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), doc, pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "n", "ids"]
                )

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part int, doc_id long, n long, ids binary")
    dealt = made.repartitionById(len(edges) + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    return materialize(dealt, "ids")


# ------------------------------------------------------------------ code
def id_counts(staged: DataFrame, kind: str) -> DataFrame:
    """(id, count) over all documents; each task sends a row for each id it has met."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), kind)
            n = np.bincount(raw, minlength=len(total))
            n[: len(total)] += total
            total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids].astype(np.int64))], names=["id", "n"])

    return staged.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); one symbol alone gets one bit."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.uint8)
    if n == 1:
        return np.ones(1, np.uint8)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, flags = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        flags.append(at < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(flags):
        leaf = leaf[:take]
        own = int(leaf.sum())
        lengths[:own] += 1
        take = 2 * (len(leaf) - own)
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


def canonical(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, codes), both by (length, symbol)."""
    at = np.lexsort((symbols, lengths))
    lens = lengths[at].astype(np.int64)
    codes, code, last = np.zeros(len(at), np.uint64), 0, 0
    # codes of one length are consecutive, so a step is needed for each length only
    for length in np.unique(lens):
        code <<= int(length) - last
        own = np.flatnonzero(lens == length)
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, last = code + len(own), int(length)
    return at, codes


class Codebook:
    """Tables of both directions, made from (symbol, length) pairs."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        at, codes = canonical(symbols, lengths)
        sym, lens = symbols[at].astype(np.int64), lengths[at].astype(np.int64)
        size = int(sym.max()) + 1 if len(sym) else 0
        self.code, self.len = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.code[sym], self.len[sym] = codes, lens.astype(np.uint64)
        self.bits = int(lens.max()) if len(lens) else 1
        self.table = np.repeat((sym.astype(np.uint64) << np.uint64(6)) | lens.astype(np.uint64), 1 << (self.bits - lens))
        self.table = np.concatenate([self.table, np.ones((1 << self.bits) - len(self.table), np.uint64)])

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every CHECKPOINTth id)."""
        u = np.uint64
        size = self.len[ids]
        ends = np.cumsum(size, dtype=np.uint64)
        off = ends - size
        out = np.zeros((int(ends[-1]) >> 6) + 2 if len(ids) else 1, np.uint64)
        if len(ids):
            word, room = (off >> u(6)).astype(np.int64), u(64) - (off & u(63))
            code = self.code[ids]
            fits = size <= room
            over = np.where(fits, u(0), size - room)
            first = np.where(fits, code << np.where(fits, room - size, u(0)), code >> over)
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[heads]] += np.add.reduceat(first, heads)
            cross = np.flatnonzero(~fits)
            out[word[cross] + 1] += code[cross] << (u(64) - over[cross])
        return out.astype(">u8").tobytes(), off[::CHECKPOINT].astype(np.uint32)

    def unpack(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        u = np.uint64
        words = np.concatenate([np.frombuffer(bits, ">u8").astype(np.uint64), np.zeros(1 + CHECKPOINT * self.bits // 64, np.uint64)])
        pos = offsets.astype(np.uint64)
        out = np.empty((CHECKPOINT, len(pos)), np.uint32)
        last = u(len(words) - 2)
        for step in range(CHECKPOINT):
            w, s = np.minimum(pos >> u(6), last).astype(np.int64), pos & u(63)
            window = (words[w] << s) | ((words[w + 1] >> u(1)) >> (u(63) - s))
            entry = self.table[(window >> u(64 - self.bits)).astype(np.int64)]
            out[step] = entry >> u(6)
            pos = pos + (entry & u(63))
        return out.T.reshape(-1)[:n]


# ------------------------------------------------------------------ files
BLOCK = "part int, first long, n long, doc_ids array<bigint>, doc_lens array<bigint>, offsets binary, bits binary"


def write(staged: DataFrame, path: str, kind: str, limit: int = MAX_BITS) -> None:
    """Write ``path``/blocks and ``path``/codebook from what ``encode`` stored."""
    spark = staged.sparkSession
    counts = id_counts(staged, kind).orderBy("id").toPandas()  # at most a row for each id of the vocabulary
    symbols = counts["id"].to_numpy(np.int64)
    lengths = code_lengths(counts["n"].to_numpy(np.int64), limit)
    spark.createDataFrame(pa.table({"id": symbols, "bits": lengths.astype(np.int32)})).coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((symbols, lengths))
    sums = {r.part: r.n for r in staged.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each part
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(*shared.value)
        first: dict[int, int] = {}
        held: list[tuple] = []

        def block(part: int) -> pa.RecordBatch:
            raw = b"".join(x[1] for x in held)
            ids = np.frombuffer(raw, kind)
            bits, offsets = book.pack(ids)
            at = first.get(part, before[part])
            first[part] = at + len(ids)
            row = {"part": part, "first": at, "n": len(ids), "doc_ids": [x[0] for x in held], "doc_lens": [len(x[1]) // itemsize for x in held]}
            row |= {"offsets": offsets.tobytes(), "bits": bits}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        size, now = 0, None
        for b in batches:
            for part, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and (part != now or size >= BLOCK_IDS * itemsize):
                    yield block(now)
                    held.clear()
                    size = 0
                held.append((doc, ids))
                size, now = size + len(ids), part
        if held:
            yield block(now)

    itemsize = np.dtype(kind).itemsize
    schema = pa.schema(
        [("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("offsets", pa.binary()), ("bits", pa.binary())]
    )
    # a part's rows may reach several scan tasks, so they meet again (they are small by now: ids, not texts)
    again = staged.select("part", "doc_id", "ids").repartitionById(max(1, len(sums)), "part")
    ordered = again.sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    ordered.mapInArrow(run, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; ids little-endian, four bytes each."""
    pairs = spark.read.parquet(f"{path}/codebook").toPandas()  # at most a row for each id of the vocabulary
    shared = spark.sparkContext.broadcast((pairs["id"].to_numpy(np.int64), pairs["bits"].to_numpy(np.uint8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(*shared.value)
        for b in batches:
            for row in b.to_pylist():
                ids = book.unpack(row["bits"], np.frombuffer(row["offsets"], np.uint32), row["n"]).astype("<u4")
                lens = np.array(row["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                raw = ids.tobytes()
                each = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["first"] + ends - lens),
                        pa.array(lens),
                        pa.array([zlib.crc32(x) for x in each], pa.int64()),
                        pa.array(each, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
