"""Near duplicates, repeated passages and contamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import words

from gridwright.llm import common, components, decontam, near_duplicates, passages


def own_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("by_space", [False, True])
def test_words_are_scanned_in_parts_without_a_seam(monkeypatch, by_space):
    rng = random.Random(31)
    texts = [words(rng, n).replace("a", rng.choice(["a", "\u00e9", " \t", "A."])).encode() for n in (0, 1, 40, 300, 3)] + [b"", b"x" * 5000, b" \n ", b"yz " * 700]
    whole = common.scan_words(texts, by_space)
    monkeypatch.setattr(common, "SCAN", 50)
    cut = common.scan_words(texts, by_space)
    assert all(np.array_equal(a, b) for a, b in zip(whole[:4], cut[:4], strict=True))
    found = [whole[4][a:b] for a, b in zip(whole[0], whole[1], strict=True)]
    assert found == [w for t in texts for w in (re.findall(rb"[^ \t\n\v\f\r]+", t) if by_space else [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.decode())])]
    fold = (lambda w: w) if by_space else bytes.lower
    assert len(set(whole[2].tolist())) == len({fold(w) for w in found})


# ------------------------------------------------------------------ near duplicates
def shingle_set(text):
    w = own_words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows):
    """(links, class as smallest id) of each row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in classes.items()}
    return [(str(doc), str(least[find(i)]), links[i]) for i, (doc, _) in enumerate(rows)]


def variants(n, length=90, seed=2):
    """A large group of near copies of one text, each with a word or two changed, among other texts."""
    rng = random.Random(seed)
    base = words(rng, length).split()
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(length)] = f"w{rng.randrange(500)}"
        out.append((i, " ".join(own)))
    return out + [(n + i, words(rng, rng.randint(1, 60))) for i in range(40)]


@pytest.mark.parametrize("block", [7, 256])
def test_near_duplicates_of_a_large_group(spark, block):
    rows = variants(150)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got.collect()) == sorted(brute_links(rows))


def test_near_duplicates_of_odd_rows(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates.near_duplicates(docs.select("doc_id", "text")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == sorted(brute_links(rows))
    assert near_duplicates.near_duplicates(no_docs).count() == 0


def test_keep_one(spark, docs, no_docs):
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = {c for (_, t), (_, c, _) in zip(rows, brute_links(rows), strict=True) if own_words(t)}
    ids = [r.doc_id for r in kept.collect() if own_words(r.text)]
    assert len(ids) == len(classes) == len(set(ids))
    assert near_duplicates.keep_one(no_docs).count() == 0


def test_pruning_keeps_what_is_near():
    least = near_duplicates.least_matches()
    assert len(least) == near_duplicates.HASHES // near_duplicates.STEP and least == sorted(least)
    rng = np.random.default_rng(0)
    n = 4000
    sig = np.zeros((2 * n, near_duplicates.HASHES), np.uint16)
    sig[:n] = rng.integers(0, 60_000, (n, near_duplicates.HASHES))
    sig[n:] = np.where(rng.random((n, near_duplicates.HASHES)) < 0.8, sig[:n], 65_000)
    left, _ = near_duplicates.prune(sig, np.arange(n), np.arange(n) + n)
    assert len(left) == n
    far = np.where(rng.random((n, near_duplicates.HASHES)) < 0.25, sig[:n], 65_000).astype(np.uint16)
    left, _ = near_duplicates.prune(np.concatenate([sig[:n], far]), np.arange(n), np.arange(n) + n)
    assert len(left) < n / 20


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 20).astype(np.uint64)) for _ in range(9)]
    got = near_duplicates.intersections(sets, columns=7)
    for i in range(9):
        for j in range(9):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_links_near_the_threshold(spark):
    """Pairs of texts whose last words differ: an index of (n - k) / (n + k) for n shingles. All at 0.8 or more are found, none below."""
    rng = random.Random(44)
    rows, want = [], {}
    for n, k in ((90, 10), (105, 11), (111, 9), (190, 10), (94, 11), (100, 15)):
        for _ in range(40):
            head = [f"h{rng.randrange(10**9)}" for _ in range(n + 4 - k)]
            for _ in range(2):
                want[len(rows)] = int(5 * (n - k) >= 4 * (n + k))
                rows.append((len(rows), " ".join(head + [f"t{rng.randrange(10**9)}" for _ in range(k)])))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == want


def test_pairs_in_a_class_need_no_band_in_common(monkeypatch):
    rng = random.Random(12)
    text = words(rng, 200)
    rows = [(0, 1, 1, text.encode(), False), (0, 2, 1, (text + " " + words(rng, 12)).encode(), False)]
    monkeypatch.setattr(near_duplicates, "bands", lambda sig: np.arange(len(sig))[:, None])
    edges, links = near_duplicates._verify(rows)
    assert [sorted(x) for x in edges] == [[1, 2]] and links == [(1, 1), (2, 1)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    real = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in real}


# ------------------------------------------------------------------ repeated passages
def brute_repeats(rows, length):
    seen = Counter()
    raw = [(doc, (t or "").encode()) for doc, t in rows]
    for _, b in raw:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for doc, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((str(doc), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passage_rows():
    """A common passage at changing places, periods, overlaps and copies."""
    rng = random.Random(8)
    common = words(rng, 90)
    rows = [(i, words(rng, rng.randint(0, 30)) + common[rng.randint(0, 60) : len(common) - rng.randint(0, 60)] + words(rng, rng.randint(0, 30))) for i in range(40)]
    rows += [(100 + i, words(rng, 12) + "Is onhe. " * (60 + i) + words(rng, 12)) for i in range(12)]
    rows += [(200, "z" * 900), (201, "zy" * 500), (202, words(rng, 400)), (203, None), (204, ""), (205, rows[0][1])]
    return rows


@pytest.mark.parametrize("group", [3, passages.GROUP])
def test_repeated_passages(spark, group):
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.remove_repeats(df, group=group).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, passages.BYTES.length)


def brute_word_repeats(rows, length=51):
    seen, spans = Counter(), []
    for _, t in rows:
        spans.append([m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", (t or "").encode())])
        w = [(t or "").encode()[a:b] for a, b in spans[-1]]
        seen.update(tuple(w[k : k + length]) for k in range(len(w) - length + 1))
    out = []
    for (doc, t), at in zip(rows, spans, strict=True):
        raw = (t or "").encode()
        w = [raw[a:b] for a, b in at]
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        starts = [a for a, _ in at] + [len(raw)]
        cut = np.zeros(len(raw), bool)
        for k in gone:
            cut[starts[k] : starts[k + 1]] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~cut]) if raw else b""
        runs = sum(k - 1 not in gone for k in gone)
        out.append((str(doc), len(raw), int(cut.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def word_passage_rows():
    """Common passages of 40 to 60 words, some under 400 bytes, with odd white space, at changing places."""
    rng = random.Random(18)
    rows = []
    for k, n in enumerate([40, 49, 50, 51, 52, 60, 60]):
        common = " ".join(rng.choice(["a", "of", "the", "word", "other"]) + str(rng.randrange(9)) for _ in range(n))
        rows += [(10 * k + i, words(rng, rng.randint(0, 70)) + rng.choice([" ", "\n\t", "  "]) + common.replace(" ", "  " if i == 2 else " ") + "\u00a0\n" * (i % 2) + " " + words(rng, rng.randint(0, 9))) for i in range(4)]
    rows += [(100 + i, words(rng, 12) + " on" * (40 + i) + " " + words(rng, 12)) for i in range(30)]
    return rows + [(200, None), (201, ""), (202, " \n "), (203, rows[30][1]), (204, "\u00e9" * 900)]


@pytest.mark.parametrize("group", [3, passages.GROUP])
def test_repeated_passages_of_words(spark, group):
    rows = word_passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.remove_repeats(df, passages.WORDS, group=group).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_word_repeats(rows)


def test_words_are_counted_beside_bytes(spark):
    rows = word_passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.remove_repeats(df, count_words=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 400)
    seen = Counter(tuple(w[k : k + 51]) for w in ((t or "").encode().split() for _, t in rows) for k in range(len(w) - 50))
    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows), strict=True):
        w = (t or "").encode().split()
        assert r.n_repeated_words == len({i for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for i in range(k, k + 51)})


@pytest.mark.parametrize("unit", [passages.BYTES, passages.WORDS])
def test_passages_of_a_very_long_text(spark, monkeypatch, unit):
    """Texts of more than two segments are cut into segments, which changes nothing."""
    rng = random.Random(28)
    common = words(rng, 120)
    rows = [(0, words(rng, 3000) + " " + common + " " + words(rng, 2000)), (1, common), (2, "x " * 3000), (3, words(rng, 900) + common[:700])]
    monkeypatch.setattr(passages, "SEGMENT", 1000)
    raw = passages.coded([t.encode() for _, t in rows], unit)
    cut = passages.anchors(raw, unit)
    monkeypatch.setattr(passages, "SEGMENT", 10**6)
    whole = passages.anchors(raw, unit)
    assert set(zip(cut[0].tolist(), cut[1].tolist(), strict=True)) == set(zip(whole[0].tolist(), whole[1].tolist(), strict=True))
    covered = [set() for _ in range(2)]
    for got, out in zip((cut, whole), covered, strict=True):
        for who, pos, _, _, low, high in zip(*(x.tolist() for x in got), strict=True):
            out.update((who, pos - a) for a in range(low, high + 1))
    assert covered[0] == covered[1] == {(i, k) for i, t in enumerate(raw) for k in range(len(t) // unit.width - unit.length + 1)}


def test_passages_carry_columns_of_any_name(spark):
    rows = [(i, "same words again " * 60, "x", "y", 5, 6.5) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tk string, spans string, n_bytes int, SPANS_ double")
    got = passages.remove_repeats(df).collect()
    assert [(r.tk, r.spans, r["SPANS_"], r.n_bytes, r.n_removed) for r in got] == [("x", "y", 6.5, 1020, 1020)] * 2


def test_passages_of_odd_rows(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = passages.remove_repeats(docs, keep_text=True)
    assert set(docs.columns) <= set(got.columns)
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_repeats(rows, passages.BYTES.length)
    assert sum(r.text is None for r in found) == sum(t is None for _, t in rows)
    assert passages.remove_repeats(no_docs).count() == 0


def test_deep_shallow_order():
    rng = random.Random(4)
    for n in (1, 2, 5, 60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) + b"q" * rng.randint(0, 300) + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))) for _ in range(n)]
        for shallow in (0, 3, 96):
            order, lcp = passages.deep_shallow(strings, shallow)
            ranked = [strings[i] for i in order]
            assert ranked == sorted(strings) and sorted(order.tolist()) == list(range(n))
            for i in range(1, n):
                a, b = ranked[i - 1], ranked[i]
                k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert lcp[i] == k


def test_repeats_of_many_contexts():
    """The loop over all lengths agrees with the pairwise rule."""
    rng = random.Random(6)
    left, right = words(rng, 60).encode(), words(rng, 60).encode()
    lefts = [left[: rng.randint(0, 368)] + bytes([65 + i % 50]) * 3 for i in range(60)]
    rights = [right[: rng.randint(32, 400)] + bytes([65 + i % 47]) * 3 for i in range(60)]
    low, high = passages.repeats(lefts, rights)
    for i in range(60):
        pairs = [(passages.common(lefts[i], lefts[j]), passages.common(rights[i], rights[j])) for j in range(60) if j != i]
        good = [(a, r) for a, r in pairs if a + r >= 400]
        assert low[i] == min((400 - min(r, 400) for _, r in good), default=-1)
        assert high[i] == max((a for a, _ in good), default=-1)


# ------------------------------------------------------------------ contamination
def brute_hits(text, items, window=13):
    w, hit, found = own_words(text), set(), set()
    for name, item in items:
        x = own_words(item)
        for g in {tuple(x[k : k + window]) for k in range(max(1, len(x) - window + 1))} if x else ():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), sorted(found)


def contaminated_rows():
    rng = random.Random(9)
    items = [(i, words(rng, 40)) for i in range(6)] + [(6, None), (7, ""), (8, "short item of five"), (9, "word"), (10, " ... "), (None, words(rng, 20))]
    items += [(11, items[0][1].upper()), (12, "a a a a a a a a a a a a a a a a"), (0, words(rng, 25))]
    texts = [words(rng, 30) + " " + " ".join(items[k % 6][1].split()[5 : 5 + n]) + " " + words(rng, m) for k, (n, m) in enumerate([(12, 5), (13, 5), (20, 900), (35, 3), (13, 200), (14, 0)])]
    texts += [items[0][1], "a " * 40, "word", "it is a Short, item. of FIVE words", None, "", items[1][1] + " " + items[2][1], items[11][1], items[-1][1] + " and " + items[0][1]]
    return items, texts


@pytest.mark.parametrize("shard", [30, 10**6])
def test_contamination(spark, shard):
    items, texts = contaminated_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, ["x"]) for i, t in enumerate(texts)], "doc_id long, text string, items array<string>")
    hits = decontam.judge(decontam.find_hits(df, bench, shard_words=shard)).collect()
    assert len(hits) == len(texts)
    for r in hits:
        n, hit, found = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, list(r["items"])) == (n, hit, found), texts[r.doc_id]
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_digest_and_cut(spark):
    items, texts = contaminated_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = decontam.judge(decontam.find_hits(df, bench))
    for r in decontam.digest(hits).collect():
        _, _, found = brute_hits(texts[r.doc_id], items)
        assert (r.n_items, r.items_sha256) == (len(found), decontam.sha256_of(found))
    for r in decontam.cut_spans(hits).collect():
        n, hit, _ = brute_hits(texts[r.doc_id], items)
        assert len(own_words(r.clean_text)) == n - hit


def test_contamination_of_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.digest(decontam.judge(decontam.find_hits(docs, none))).collect()
    assert len(got) == docs.count() and all(r.n_hit == 0 and not r.contaminated for r in got)
    assert decontam.find_hits(no_docs, none).count() == 0
