"""Byte-pair encoding and decoding through a table of distinct words.

White space ends every merge of the vocabularies this serves, so a text's ids
are those of its words one after another.

1. Texts are split into words where they are scanned.  Each chunk of documents
   (about ``CHUNK_CHARS`` characters) becomes one row of word numbers, most frequent
   word first, and one row of words for each bucket of the words' hash.
2. Buckets are dealt out.  All chunks' rows of a bucket meet in one task, which
   encodes each distinct word once (of more than ``KNOWN`` of them the oldest are let go, and encoded again if they
   come again), and answers every chunk with ids in the order asked.
3. The ids that a chunk's answers use meet the id-to-piece table in a join (as many rows
   for a chunk as the vocabulary has pieces, at most; none for an occurrence).
4. A chunk, its answers and its pieces meet (chunks are stored in buckets, so only the answers
   are shuffled); ids take the places of word numbers.  Decoding puts the pieces joined in place of ids
   and joins them by spaces, as a tokenizer without a decoder does.

What is dealt out is a chunk's distinct words, never a row for each occurrence,
so no frequent word makes a large group.

Null text is empty (no ids; empty decoded text); null and repeated doc_ids are
kept, a row each.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import fresh, materialize, materialize_bucketed, texts_of, worker_state

CHUNK_CHARS = 8_000_000
KNOWN = 500_000
#: Python takes these for white space, the tokenizers library doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")


def split_words(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


class Splitter:
    """Words of a text, alike ones made equal where the tokenizer makes no difference either.

    If it lower-cases, A-Z become a-z first (unless that would make up one of its
    special strings); if it ends words between a letter and a full stop or comma,
    these become words of their own.
    """

    def __init__(self, tok):
        same = lambda a, b: [x.ids for x in tok.encode_batch(a, add_special_tokens=False)] == [x.ids for x in tok.encode_batch(b, add_special_tokens=False)]
        self.special = [t.content.lower() for t in tok.get_added_tokens_decoder().values()]
        self.lower = same(["ABC xYz", "Z9'S"], ["abc xyz", "z9's"])
        ends = [f"{w}{p}" for w in ("a", "word", "it's", "\u00e9t\u00e9", "\u65e5") for p in ".,"]
        self.stops = same(ends, [f"{x[:-1]} {x[-1]}" for x in ends])

    def __call__(self, text: str) -> list[str]:
        if self.lower:
            low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            if not any(s in low for s in self.special):
                text = low
        words = split_words(text)
        if not self.stops:
            return words
        out = []
        for w in words:
            if w[-1] in ".," and len(w) > 1 and w[-2].isalpha():
                out.append(w[:-1])
                out.append(w[-1])
            else:
                out.append(w)
        return out


class Index(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _squeeze(x: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x)


def _expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(x)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers of up to 32 bits, compressed with bytes of equal significance together; up to 16 bits, as they are."""
    if not len(x) or x.max() < 1 << 16:
        return b"2" + _squeeze(x.astype("<u2").tobytes(), 9)
    return b"4" + _squeeze(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(raw: bytes) -> np.ndarray:
    flat = _expand(raw[1:])
    if raw[:1] == b"2":
        return np.frombuffer(flat, "<u2").astype(np.uint32)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


PART = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("data", pa.binary()), ("more", pa.binary()), ("kind", pa.string())])
_PART_DDL = "chunk string, bucket int, doc_ids array<bigint>, words array<bigint>, data binary, more binary, kind string"


def _chunk_rows(doc_ids: list, lens: list[int], numbers: list[np.ndarray], index: Index, buckets: int) -> pa.RecordBatch:
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
    rank = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")
    place = np.empty(len(rank), np.uint32)
    place[rank] = np.arange(len(rank), dtype=np.uint32)
    names = list(index)
    words = [names[i] for i in rank]
    bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.uint32, len(words))
    chunk = uuid.uuid4().hex
    rows = [{"chunk": chunk, "bucket": -1, "doc_ids": doc_ids, "words": lens, "data": pack_numbers(place[flat]), "more": pack_numbers(bucket), "kind": "docs"}]
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets), "right")
    for b, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
        if hi > lo:
            rows.append({"chunk": chunk, "bucket": b, "data": _squeeze("\n".join(words[i] for i in order[lo:hi]).encode(), 12), "kind": "words"})
    return pa.RecordBatch.from_pylist(rows, schema=PART)


def split(docs: DataFrame, tokenizer: str, buckets: int, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Stored rows of chunks: kind 'docs' (word numbers) and kind 'words' (distinct words of a bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Splitter(_vocabulary(tokenizer)[0])
        doc_ids, lens, numbers, index, size = [], [], [], Index(), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                words = words_of(text)
                numbers.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                doc_ids.append(doc)
                lens.append(len(words))
                size += len(text)
                if size >= chunk_chars:
                    yield _chunk_rows(doc_ids, lens, numbers, index, buckets)
                    doc_ids, lens, numbers, index, size = [], [], [], Index(), 0
        if doc_ids:
            yield _chunk_rows(doc_ids, lens, numbers, index, buckets)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PART_DDL)
    return materialize_bucketed(made, "words", "kind", buckets, "chunk")


def _vocabulary(path: str) -> tuple[object, list[str]]:
    """The tokenizer and its pieces by id, read once in each Python worker."""
    return worker_state(("bpe", path), lambda: _read(path))


def _read(path: str) -> tuple[object, list[str]]:
    # on the task's own thread: more threads than the task has cores only take memory
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    if tok.decoder is not None:
        raise ValueError("decoding joins pieces by spaces, which is right only for a tokenizer without a decoder")
    size = max(tok.get_vocab().values()) + 1
    return tok, [tok.id_to_token(i) or "" for i in range(size)]


ANSWER = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("used", pa.list_(pa.int32()))])


def encode_words(parts: DataFrame, tokenizer: str, buckets: int, known_size: int = KNOWN) -> DataFrame:
    """Answers to the 'words' rows: the ids (data), the number of ids of each word (more), and which ids occur (used)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _ = _vocabulary(tokenizer)
        known: dict[str, bytes] = {}
        old: dict[str, bytes] = {}
        for b in batches:
            for row in b.to_pylist():
                words = _expand(row["data"]).decode().split("\n")
                got = [known.get(w) or old.get(w) for w in words]
                new = [i for i, x in enumerate(got) if x is None]
                for lo in range(0, len(new), 2_000):
                    part = new[lo : lo + 2_000]
                    for i, e in zip(part, tok.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                        got[i] = np.array(e.ids, np.uint32).tobytes()
                if len(known) + len(words) > known_size:
                    old, known = known, {}
                known.update(zip(words, got, strict=True))
                n = np.fromiter((len(x) // 4 for x in got), np.uint32, len(got))
                ids = np.frombuffer(b"".join(got), np.uint32)
                answer = {"chunk": row["chunk"], "bucket": row["bucket"], "data": pack_numbers(ids), "more": pack_numbers(n), "used": np.unique(ids).tolist()}
                yield pa.RecordBatch.from_pylist([answer], schema=ANSWER)

    words = parts.where("kind = 'words'").select("chunk", "bucket", "data")
    return words.repartitionById(buckets, "bucket").mapInArrow(run, "chunk string, bucket int, data binary, more binary, used array<int>")


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece): as many rows as the vocabulary has, read where they are needed; the driver doesn't load the tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, pieces = _vocabulary(tokenizer)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array(pieces, pa.string())], names=["id", "piece"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "id int, piece string")


def pieces_of(answers: DataFrame, table: DataFrame) -> DataFrame:
    """(chunk, pieces): id and piece of every id that a chunk's answers use, by a join."""
    used = answers.groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used"))
    named = used.select("chunk", F.explode("used").alias("id")).join(F.broadcast(table), "id")
    return named.groupBy("chunk").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))


def encode(docs: DataFrame, tokenizer: str, buckets: int, texts: bool = True, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, with ``texts``, (ids, decoded).

    ids_sha256 is that of the decimal ids joined by spaces, decoded_sha256 that of
    the decoded text in UTF-8.
    """
    parts = split(docs, tokenizer, buckets, chunk_chars)
    answers = materialize(encode_words(parts, tokenizer, buckets), "answers")  # read twice: for their ids, and to be joined back
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if texts:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def finish(head: dict, got: list[dict], pieces: dict[int, str]) -> Iterator[pa.RecordBatch]:
        bucket = unpack_numbers(head["more"])
        order = np.argsort(bucket, kind="stable")
        ids_of, text_of, many = [""] * len(order), [""] * len(order), np.zeros(len(order), np.int64)
        at = 0
        for x in sorted(got, key=lambda x: x["bucket"]):
            n, flat = unpack_numbers(x["more"]), unpack_numbers(x["data"]).tolist()
            places, lo = order[at : at + len(n)], 0
            if (bucket[places] != x["bucket"]).any():
                raise RuntimeError("a chunk's answers are not those asked for")
            many[places] = n
            at += len(n)
            for place, k in zip(places.tolist(), n.tolist(), strict=True):
                own = flat[lo : lo + k]
                ids_of[place], text_of[place] = " ".join(map(str, own)), " ".join([pieces[i] for i in own])
                lo += k
        if at != len(order):
            raise RuntimeError("a chunk's answers are not complete")
        numbers = unpack_numbers(head["data"])
        lo, rows = 0, []
        for doc, size in zip(head["doc_ids"], head["words"], strict=True):
            mine = numbers[lo : lo + size]
            lo += size
            places = [i for i in mine.tolist() if ids_of[i]]
            ids, decoded = " ".join([ids_of[i] for i in places]), " ".join([text_of[i] for i in places])
            row = {"doc_id": doc, "n_tokens": int(many[mine].sum()), "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
            if texts:
                row |= {"ids": [int(x) for x in ids.split()], "decoded": decoded}
            rows.append(row)
            if len(rows) >= 500:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                yield from finish(row, row["got"] or [], {x["id"]: x["piece"] for x in row["pieces"] or []})

    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data", "more")).alias("got"))
    # the chunks lie in buckets already, so only the answers move
    chunks = parts.where("kind = 'docs'").select("chunk", "doc_ids", "words", "data", "more")
    pieces = pieces_of(answers, piece_table(docs.sparkSession, tokenizer))
    both = chunks.join(by_chunk, "chunk", "left").join(pieces, "chunk", "left").select("doc_ids", "words", "data", "more", "got", "pieces")
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return both.mapInArrow(run, ddl)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with column ``decoded``: pieces of the column ``ids``, in order, joined by spaces.

    A row for each id meets the id-to-piece table, which is as large as the vocabulary and so broadcast; rows
    come together again by number and position.
    """
    key, at, ident, words = fresh(encoded, "row", "at", "id", "decoded_words")
    numbered = materialize(encoded.drop("decoded").withColumn(key, F.monotonically_increasing_id()), "encoded")  # so that the numbers stay
    table = piece_table(encoded.sparkSession, tokenizer).withColumnsRenamed({"id": ident})
    each = numbered.select(key, F.posexplode("ids").alias(at, ident)).join(F.broadcast(table), ident)
    texts = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, "piece"))).alias(words))
    text = F.array_join(F.transform(words, lambda x: x["piece"]), " ")
    own = [f"`{c}`" for c in encoded.columns if c.lower() != "decoded"]
    return numbered.join(texts, key, "left").select(*own, F.coalesce(text, F.lit("")).alias("decoded"))
