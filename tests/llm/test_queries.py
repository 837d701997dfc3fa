"""Every registered query of the training-data operators over the whole tables of the smallest scale, against brute force or the libraries."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from test_duplicates import brute_hits, brute_links, brute_repeats, brute_word_repeats, own_words
from test_models import brute_log_likelihood
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from gridwright.llm import langid, omh, passages, queries, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables of the smallest scale aren't here")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def found(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_score(model, text):
    """Of the worst window of eight words: the mean share of a feature, each word once, with the pad."""
    w = toxicity.words_of(text)
    logits = []
    for lo in range(max(1, len(w) - toxicity.WINDOW + 1)):
        share, n = model.of_words(sorted({toxicity.PAD, *w[lo : lo + toxicity.WINDOW]}))
        logits.append(share.sum() / n.sum() + model.bias)
    return 1 / (1 + np.exp(-max(logits)))


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return toxicity.fit(queries.labelled(docs, labels))


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(i) for i in range(1, 11)} and "pipeline" in names


def test_op1(spark, rows):
    got = found(spark, "op1_ngram_jaccard_join")
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == sorted(brute_links(rows))


def test_op2(spark, rows, toxic_model):
    got = {r.doc_id: r for r in found(spark, "op2_toxicity")}
    assert len(got) == len(rows)
    for doc, text in rows:
        want = brute_score(toxic_model, text or "")
        assert got[doc].score == pytest.approx(want, abs=1e-9) and got[doc].predicted == int(got[doc].score >= 0.7)
        assert got[doc].held_out == (zlib.crc32(str(doc).encode()) % 3 == 1)


def test_op3(spark, rows):
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = []
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r)[:4] for r in found(spark, "op3_bpe_round_trip")) == sorted(want)


def test_op4(spark, rows, items):
    want = []
    for doc, text in rows:
        n, hit, names = brute_hits(text, items)
        want.append((doc, n, hit, len(names), sha(",".join(names)), hit > 0 and 20 * hit >= n))
    assert sorted(tuple(r)[:6] for r in found(spark, "op4_decontamination")) == sorted(want)


def test_op5(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    want = [(doc, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for doc, t in rows]
    assert sorted(tuple(r)[:4] for r in found(spark, "op5_token_counts")) == sorted(want)


def test_op6(spark, rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in found(spark, "op6_order_minhash")}
    for k, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = omh.signature(text), omh.signature(edited), omh.signature(after)
        r = got[doc]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(edited), omh.as_text(own), omh.as_text(changed))
        assert r.near_edited == omh.likeness(own, changed) and r.near_next == omh.likeness(own, other)
    assert len(got) == len(rows)


def test_op7(spark, rows):
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc, text in sorted(rows):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in found(spark, "op7_binary_ids")) == want


def test_op8(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    got = __spark_entry__.queries()["op8_chat_formatting"](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()['op8_chat_formatting']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_op9(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("lang IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 4 <> 2").select("text", "lang"), path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in found(spark, "op9_language_id")}
    assert len(got) == len(rows)
    known = {}
    for doc, text in rows:
        words = langid.words_of(text or "")
        r = got[doc]
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 4 == 2) and (r.lang_pred == "und") == (not words)
        if words and len(words) < 60:  # the plain sum over segmentations is slow
            for w in words:
                if w not in known:
                    known[w] = np.array([brute_log_likelihood(model, w, i) for i in range(len(model.langs))])
            total = sum(known[w] for w in words)
            assert r.lang_pred == model.langs[int(total.argmax())] and r.score == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-6)
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in got.values() if r.held_out and true[r.doc_id] and r.lang_pred != "und"]
    assert held and np.mean([r.lang_pred == true[r.doc_id] for r in held]) >= 0.95


def test_op10(spark, rows):
    got = found(spark, "op10_repeated_passages")
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 400)


def test_pipeline(spark, rows, items, toxic_model):
    """Each stage by brute force on what the one before has left."""
    left = [(doc, text) for doc, text in rows if brute_score(toxic_model, text or "") < 0.7]
    classes = {(d, t): c for (d, t), (_, c, _) in zip(left, brute_links(left), strict=True)}
    left = [(d, t) for d, t in left if not own_words(t) or str(d) == classes[d, t]]
    cut = {doc: kept for doc, *_, kept in brute_word_repeats(left)}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id IN ({', '.join(str(d) for d, _ in left)})")
    texts = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, docs, SF).collect()}
    assert {str(d): sha(t or "") for d, t in texts.items()} == cut
    fair = [(d, t) for d, t in texts.items() if not (lambda n, hit, _: hit > 0 and 20 * hit >= n)(*brute_hits(t, items))]
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = []
    for doc, text in fair:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r)[:4] for r in found(spark, "pipeline")) == sorted(want)


def test_columns_of_any_name_are_carried(spark):
    """Columns that operators use inside come through; those that an operator makes give way."""
    from gridwright.llm import decontam, near_duplicates, token_count

    inner = ["tk", "spans", "node", "words", "sig", "rows", "rows_", "size", "own", "key", "band", "root", "first", "kept", "chunk", "place", "part", "to", "at", "h", "c", "n", "k", "s", "kd", "kt", "word_spans", "lang", "__rows"]
    made = ["n_bytes", "n_tokens", "score", "predicted", "items", "n_words", "hit_words", "hit_bytes", "lang_pred", "fingerprint", "n_removed"]
    texts = ["a text of some words that is here " * 9, "another one entirely", None, ""]
    df = spark.createDataFrame([(i, t, *[f"v{k}{i}" for k in range(len(inner) + len(made))]) for i, t in enumerate(texts)], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in inner + made)]))
    want = {r.doc_id: [r[c] for c in inner] for r in df.collect()}
    none = spark.createDataFrame([], "item_id long, text string")
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    languages = langid.fit(spark.createDataFrame([("some words", "aa")], "text string, lang string"), path("piece_bpe_32k.model"))
    for got in (
        near_duplicates.keep_one(df), passages.remove_repeats(df, count_words=True), decontam.find_hits(df, none), toxicity.score(df, model, keep_text=True),
        token_count.count_tokens(df, path("piece_bpe_32k.model")), langid.predict(df, languages), omh.fingerprints(df),
    ):
        assert {r.doc_id: [r[c] for c in inner] for r in got.collect()} == want and len(set(got.columns)) == len(got.columns)
