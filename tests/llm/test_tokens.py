"""Token operators against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from gridwright.llm import binary_ids, bpe, token_count

ALPHABET = ["a", "the", " ", "  ", "\n", "\n\n", "é", "▁", "<s>", "\t", "\r\n", "1", ".", " x", "'s", "\xa0", "　", "日本", "\x1c", "\x85", "<|endoftext|>", "I'll", "́", "ß", "\x00"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(path("byte_bpe_50k.json"))


# ------------------------------------------------------------------ counts
def test_lengths_are_the_librarys():
    sp = token_count.load(path("piece_bpe_32k.model"))
    assert token_count.splittable(sp)
    lengths = token_count.Lengths(sp, {}, size=50)  # small: forgets all the time
    for x in random_texts(5000):
        assert (sum(lengths[k] for k in token_count.pre_tokens(x)) if x else 0) == len(sp.encode(x)), x


def test_count_tokens(spark, docs, no_docs):
    sp = token_count.load(path("piece_bpe_32k.model"))
    got = token_count.count_tokens(docs, path("piece_bpe_32k.model"), sample_rows=5, table_size=20)
    assert {"lang", "score", "rows"} <= set(got.columns)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_count.count_tokens(no_docs, path("piece_bpe_32k.model")).count() == 0


# ------------------------------------------------------------------ encoding and decoding
@pytest.mark.parametrize("chunk", [500, 10_000_000])
def test_bpe_round_trip(spark, docs, word_bpe, chunk):
    got = bpe.encode(docs, path("word_bpe_49k.json"), 4, chunk_chars=chunk).collect()
    want = []
    for r in docs.collect():
        ids = word_bpe.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), ids, word_bpe.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == sorted(want)
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() and r.n_tokens == len(r.ids)


def test_bpe_odd_texts_and_decode(spark, word_bpe, no_docs):
    texts = random_texts(2000, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.decode(bpe.encode(df, path("word_bpe_49k.json"), 3).drop("decoded"), path("word_bpe_49k.json")).collect()
    for r in got:
        ids = word_bpe.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == word_bpe.decode(ids, skip_special_tokens=False), texts[r.doc_id]
    assert len(got) == len(texts) and bpe.encode(no_docs, path("word_bpe_49k.json"), 2).count() == 0


def test_bpe_joins_and_bounds(spark, docs, word_bpe):
    """Few words are kept by a worker, and pieces come from the id-to-piece table."""
    parts = bpe.split(docs, path("word_bpe_49k.json"), 3, chunk_chars=300)
    answers = bpe.encode_words(parts, path("word_bpe_49k.json"), 3, known_size=2).collect()
    whole = bpe.encode_words(parts, path("word_bpe_49k.json"), 3).collect()
    assert {(r.chunk, r.bucket, bytes(r.data), bytes(r.more)) for r in answers} == {(r.chunk, r.bucket, bytes(r.data), bytes(r.more)) for r in whole}
    found = bpe.pieces_of(spark.createDataFrame(whole), bpe.piece_table(spark, path("word_bpe_49k.json"))).collect()
    used = {r.chunk: {i for x in whole if x.chunk == r.chunk for i in x.used} for r in found}
    assert {r.chunk: {p.id: p.piece for p in r.pieces} for r in found} == {c: {i: word_bpe.id_to_token(i) for i in ids} for c, ids in used.items()}
    plan = bpe.encode(docs, path("word_bpe_49k.json"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(used" in plan and "Join Inner, (id#" in plan


@pytest.mark.parametrize("x", [[], [0], [2**32 - 2], [5] * 9, list(range(70_000))])
def test_packed_numbers(x):
    assert bpe.unpack_numbers(bpe.pack_numbers(np.array(x, np.uint32))).tolist() == x


# ------------------------------------------------------------------ files of ids
def test_encoder_is_the_library(byte_bpe):
    encoder = binary_ids.Encoder(path("byte_bpe_50k.json"), size=60)
    for x in random_texts(5000, 2):
        assert np.frombuffer(encoder([x])[0], encoder.kind).tolist() == byte_bpe.encode(x, add_special_tokens=False).ids, x


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 5), (2, 5), (3, 2), (40, 6), (700, 11)):
        counts = np.sort(rng.pareto(0.6, n) * 10).astype(np.int64) + 1
        rng.shuffle(counts)
        lengths = binary_ids.code_lengths(counts, limit)
        assert lengths.max() <= limit and (n < 2 or sum(2.0 ** -int(x) for x in lengths) == 1)
        assert n < 2 or all(lengths[i] <= lengths[j] for i in range(n) for j in range(n) if counts[i] > counts[j]) or n > 60
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert sorted(binary_ids.code_lengths(fib, 20).tolist()) == [1, 2, 3, 4, 5, 6, 7, 7]
    assert binary_ids.code_lengths(fib, 4).max() == 4


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 127, 128, 129, 5000):
        ids = (rng.pareto(0.7, n) * 3).clip(0, 50_000).astype(np.uint16)
        symbols, counts = np.unique(ids, return_counts=True)
        book = binary_ids.Codebook(symbols.astype(np.int64), binary_ids.code_lengths(counts))
        bits, offsets = book.pack(ids)
        assert book.unpack(bits, offsets, n).tolist() == ids.tolist()


@pytest.mark.parametrize("parts", [1, 4])
def test_files(spark, docs, byte_bpe, tmp_path, parts):
    tokenizer, folder = path("byte_bpe_50k.json"), f"file://{tmp_path}/{parts}"
    binary_ids.write(binary_ids.encode(docs, tokenizer, 2, parts), folder, binary_ids.kind_of(tokenizer))
    got = sorted(binary_ids.read(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in order]
    start = 0
    for r, d in zip(got, order, strict=True):
        ids = byte_bpe.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_no_files(spark, no_docs, tmp_path):
    tokenizer, folder = path("byte_bpe_50k.json"), f"file://{tmp_path}/none"
    binary_ids.write(binary_ids.encode(no_docs, tokenizer, 2, 3), folder, binary_ids.kind_of(tokenizer))
    assert binary_ids.read(spark, folder).count() == 0


def test_ids_of_documents_that_all_tie(spark, byte_bpe, tmp_path):
    rows = [(7, f"text {i}" * i) for i in range(12)] + [(7, "text 3" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    binary_ids.write(binary_ids.encode(df, path("byte_bpe_50k.json"), end_id=2, parts=4), f"{tmp_path}/ids", "<u2")
    got = sorted(binary_ids.read(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    each = sorted(np.array(byte_bpe.encode(t, add_special_tokens=False).ids + [2], "<u2").tobytes() for _, t in rows)
    assert [r.n_tokens for r in got] == [len(x) // 2 for x in each]
    assert [r.start for r in got] == [sum(len(x) // 2 for x in each[:k]) for k in range(len(each))]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in each]
