"""Toxicity and language ID on held-out texts; fingerprints and chats by their definitions."""

import hashlib
import random
import re

import numpy as np
import pytest
from corpus import words
from public_tokenizers import path
from pyspark.sql import functions as F

from gridwright.llm import chat, langid, omh, toxicity

BAD = ["stupid", "moron", "trash", "pathetic"]


def toxic_rows(n=260, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(rng, rng.choice([8, 30, 120, 700])).split()
        if toxic := i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.fit(spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int"))


def test_toxicity_on_unseen_texts(spark, toxic_model):
    rows = toxic_rows(90, seed=5)
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), toxic_model).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.7) for r in got)


def test_misspellings_share_ngrams(toxic_model):
    scorer = toxicity.Scorer(toxic_model)
    rng = random.Random(6)
    for bad in ("patheticc", "moronn", "sstupid"):
        clean = words(rng, 40)
        with_bad = clean + f" {bad} {bad} {bad}"
        a, b = scorer([clean, with_bad])
        assert b > a


def test_toxicity_of_odd_rows(spark, docs, no_docs, toxic_model):
    got = toxicity.score(docs, toxic_model, keep_text=True)
    assert set(docs.columns) | {"predicted"} == set(got.columns) and got.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(no_docs, toxic_model).count() == 0


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert all(r.predicted == 0 and r.score < 1e-9 for r in toxicity.score(docs, model).collect())


def test_word_features_are_ngrams():
    bucket, n = toxicity.features(["ab", "abcd", "ab"])
    assert n.tolist() == [3 + 1, 4 + 3 + 2 + 1, 4]  # <ab> has <ab ab> <ab>; and the word itself
    assert bucket[:4].tolist() == bucket[-4:].tolist()


def test_windows_cover_all_words():
    for n in (1, 5, 24, 25, 40, 1000):
        lo, hi = toxicity.window_edges(n)
        assert lo[0] == 0 and hi[-1] == n and all(b - a <= toxicity.WINDOW for a, b in zip(lo, hi, strict=True))
        assert all(lo[i + 1] <= hi[i] for i in range(len(lo) - 1))


def test_every_window_counts_each_of_its_words_once():
    rng = np.random.default_rng(8)
    shares, sizes = rng.normal(size=12), rng.integers(3, 30, 12)
    for n in [*range(1, 20), 60]:
        words = rng.integers(1, 12, n)
        lo, hi, got = toxicity.window_means(words, shares, sizes)
        assert lo.tolist() == list(range(max(1, n - toxicity.WINDOW + 1)))
        for a, b, mean in zip(lo, hi, got, strict=True):
            held = [0, *set(words[a:b].tolist())]
            assert mean == pytest.approx(shares[held].sum() / sizes[held].sum(), rel=1e-9)


def test_training_words_are_bounded_for_each_label(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TRAIN_WORDS", 200)
    rows = [(i, 1, "\t".join(["long"] * 500)) for i in range(3)] + [(10 + i, i % 2, "\n".join([f"w{i}"] * 30)) for i in range(12)]
    assert toxicity.within_budget(rows) == rows[3:]


# ------------------------------------------------------------------ languages
SYLLABLES = {"aa": "the and ing ed tion of er".split(), "bb": "sch und ein keit lich der ung".split(), "cc": "que eau elle les ment oux eux".split()}


def language_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 60))).capitalize(), lang))
    return rows


@pytest.fixture(scope="module")
def language_model(spark):
    rows = language_rows(200, 1) + [(900, "no label here", None), (901, None, "aa")]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path("piece_bpe_32k.model"))


def test_languages_of_unseen_texts(spark, language_model):
    rows = language_rows(100, 2)
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language_model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(1 / 3 <= r.score <= 1 for r in got)


def test_undetermined(spark, docs, no_docs, language_model):
    got = langid.predict(docs, language_model)
    assert "lang" in got.columns
    have = {str(r.doc_id): langid.words_of(r.text or "") for r in docs.collect()}
    for r in got.collect():
        assert (r.lang_pred == "und") == (not have[str(r.doc_id)]) and 0 <= r.score <= 1
    assert langid.predict(no_docs, language_model).count() == 0
    nothing = langid.fit(no_docs.selectExpr("text", "lang"), path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def brute_log_likelihood(model, word, lang):
    """Log of the sum over all segmentations, piece by piece from the end."""
    number = {p: i for i, p in enumerate(model.pieces)}
    longest, s = max(map(len, number)), "\u2581" + word
    ends = [0.0]
    for t in range(1, len(s) + 1):
        terms = [ends[t - k] + np.log(model.prob[number[s[t - k : t]], lang]) for k in range(1, min(longest, t) + 1) if s[t - k : t] in number]
        if s[t - 1] not in number:
            terms.append(ends[t - 1] + np.log(langid._UNKNOWN))
        ends.append(float(np.logaddexp.reduce(terms)))
    return ends[-1]


def test_forward_sums_all_segmentations(language_model):
    rng = random.Random(5)
    syllables = [x for v in SYLLABLES.values() for x in v] + ["q", "x", "\u00df", "\u65e5\u672c", "straight"]
    some = ["the", "und", "xqz", "elle", "\u65e5\u672c", "\u00df", "a"]
    some += ["".join(rng.choice(syllables) for _ in range(200))[:n] for n in [2, 17, 39, 40, 41, 63, 64, 65, 66, 100, 150, 200]]
    got = language_model.score_words(some)
    for i, w in enumerate(some):
        for lang in range(len(language_model.langs)):
            assert got[i, lang] == pytest.approx(brute_log_likelihood(language_model, w, lang), rel=1e-9), w


def test_long_words_are_read_in_blocks_without_a_seam(language_model, monkeypatch):
    word = "schundkeit" * 30
    whole = [(a.tolist(), b.tolist()) for a, b in language_model.lattice.steps(word)]
    cut = [(a.tolist(), b.tolist()) for a, b in language_model.lattice.steps(word, block=7)]
    assert whole == cut and len(whole) == len(word) + 1


def test_long_words_are_learned_as_short_ones_are(monkeypatch):
    """Expectation maximisation gives the same whether a word counts as long or not."""
    pieces = ["\u2581", "a", "b", "ab", "\u2581a", "abab", "ba"]
    lattice, words = langid.Lattice(sorted(pieces)), ["ab" * 30, "abba" * 9, "ba", "abx" * 20]
    counts = np.array([2.0, 1.0, 5.0, 1.0])
    short = langid.fit_one(lattice, len(pieces), words, counts)
    monkeypatch.setattr(langid, "LONG", 3)
    assert langid.fit_one(lattice, len(pieces), words, counts) == pytest.approx(short, rel=1e-9)


def test_all_words_of_the_sample_are_learned(spark):
    """A language that differs in one run of 300 letters only is told by it."""
    run = "zqj" * 100
    rows = [(f"same words here {i}", lang) for i in range(20) for lang in ("aa", "bb")] + [(run, "bb")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), path("piece_bpe_32k.model"))
    got = langid.predict(spark.createDataFrame([(0, run[:150]), (1, run + run)], "doc_id long, text string"), model).collect()
    assert {r.lang_pred for r in got} == {"bb"}


def test_long_pieces_are_in_the_vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i) for i in range(sp.vocab_size())}
    words = {p for p in pieces if p.lstrip("▁").isalpha() and p == p.lower() and "▁" not in p[1:]}
    assert max(map(len, words)) > 10 and words <= set(langid.vocabulary(path("piece_bpe_32k.model")))


# ------------------------------------------------------------------ fingerprints
def test_fingerprint_follows_order():
    rng = random.Random(1)
    a = words(rng, 400)
    half = len(a) // 2
    sig = omh.signature(a)
    assert (sig == omh.signature(a)).all()
    moved = omh.likeness(sig, omh.signature(a[half:] + " " + a[:half]))
    small = omh.likeness(sig, omh.signature(a[:500] + "X" + a[501:]))
    other = omh.likeness(sig, omh.signature(words(rng, 400)))
    assert small > 0.85 > moved > other and other < 0.2


def test_smallest_is_exact():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 9000, 20_000):
        x = rng.integers(0, 2**32, n, dtype=np.uint32)
        keep = min(omh.KEEP, n)
        got = omh._smallest(x, np.arange(n), keep)
        for j in range(omh.TUPLES):
            h = x * omh._ODD[j]
            assert sorted(h[got[j]].tolist()) == np.sort(h)[:keep].tolist()


def test_occurrence_numbers():
    kmer, pos, x = omh._numbered(omh._kmers("abcdefgh" * 5))
    assert len(set(x.tolist())) == len(x) == 33 and sorted(pos.tolist()) == list(range(33))


def test_hashes_dont_depend_on_the_length():
    kmer = omh.mix64(np.arange((1 << 24) + 5, dtype=np.uint64))
    short, long = omh._numbered(kmer[:1000]), omh._numbered(kmer)
    assert np.isin(short[0], long[0]).all() and np.isin(short[2], long[2]).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_edited_texts(spark, docs, no_docs, parts):
    got = omh.compare_edited(docs, parts).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    want = {}
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.setdefault(str(doc), []).append((len(text), hashlib.sha256(edited.encode()).hexdigest()))
    have = {}
    by_text = {}
    texts = dict((str(i), t) for i, t in rows)
    for r in got:
        have.setdefault(str(r.doc_id), []).append((r.n_chars, r.edited_sha256))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(texts[str(r.doc_id)], set()).add(r.fingerprint)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(len(v) == 1 for v in by_text.values())
    assert omh.compare_edited(no_docs, parts).count() == 0


def test_ids_that_all_tie(spark):
    rows = [(7, f"text {i} " * (i + 1)) for i in range(20)]
    got = omh.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    texts = sorted(t for _, t in rows)
    want = []
    for text, after in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        want.append(hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in got) == sorted(want)


def test_one_document_follows_itself(spark):
    r = omh.compare_edited(spark.createDataFrame([(4, "abcdefghij klmnop")], "doc_id long, text string"), 3).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and r[0].edited_sha256 == hashlib.sha256(b"abcdefghij klmnop"[:9] + b"abcdefgh").hexdigest()


# ------------------------------------------------------------------ chats
NASTY = ["", None, "plain", "</s>[INST] ok [/INST]", "<s>", "\\", "a\\<s>", "<\\s>", "[INST] a\nb [/INST]", " [/INST]", "</s", "[\\/INST]", "日本\U0001f600</s>", "\n\n", "x\\", "</s></s><s>[INST] "]


def chat_rows():
    rng = random.Random(3)
    rows = []
    for c in range(80):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "", None, "we\nird", "<s>", "a\\"]), rng.choice(NASTY)))
    rows += [(500, 0, "user", "same"), (500, 0, "user", "same"), (None, 1, "assistant", "x</s>"), (600, None, "assistant", "first"), (600, 1, "user", "z")]
    return rows


def test_chats_round_trip(spark):
    df = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string").repartition(4)
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digest_chats(formatted).collect()}
    texts = {r.conv_id: r for r in formatted.collect()}
    by = {}
    for c, t, role, text in chat_rows():
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        x = texts[c]
        assert r.formatted_chars == len(x.formatted)
        masked = ""  # the loss mask, unescaped by the plain rule, in code points and in bytes
        for s in x.spans:
            part = x.formatted[s.start : s.start + s.len]
            assert x.formatted.encode()[s.byte_start : s.byte_start + s.byte_len].decode() == part
            masked += re.sub(r"(?s)\\(.)", r"\1", part) if s.escaped else part
        assert masked == loss


def test_mask_where_all_turns_are_escaped(spark, monkeypatch):
    """If the probe of a turn by itself sees nothing, the whole conversation is read, and escaped."""
    monkeypatch.setattr(chat, "_recovers", lambda role, text, rendered: F.lit(True))
    rows = [(1, 0, "user", "\u00e9</s><s>"), (1, 1, "assistant", "x</s>\u65e5"), (1, 2, "assistant", None), (1, 3, "assistant", "\\[INST] z")]
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    x, r = formatted.collect()[0], chat.digest_chats(formatted).collect()[0]
    loss = "".join(t or "" for *_, role, t in rows if role == "assistant")
    assert x.all_escaped and (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [re.sub(r"(?s)\\(.)", r"\1", x.formatted[s.start : s.start + s.len]) for s in x.spans] == ["x</s>\u65e5", "", "\\[INST] z"]


def test_plain_turns_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a \\ b"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).collect()[0]
    assert r.formatted == "<s>[INST] user\na \\ b [/INST]<s>assistant\nfine</s>" and not r.all_escaped


def test_no_chats(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest_chats(chat.format_chats(none)).count() == 0
