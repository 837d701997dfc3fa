"""The pipeline's stages on odd rows, and each stage's own decisions."""

import random

import pytest
from corpus import words

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(2)
    more = []
    for i in range(120):
        w = words(rng, 40).split()
        if i % 2:
            w[5:5] = ["stupid", "moron", "trash"]
        more.append((1000 + i, " ".join(w), "en", "s", 1, "s", 1, 1))
    passage = words(rng, 80)
    item = words(rng, 30)
    more.append((2000, words(rng, 50) + " " + passage, "en", "s", 1, "s", 1, 1))
    more.append((2001, words(rng, 50) + " " + passage, "en", "s", 1, "s", 1, 1))
    more.append((2002, words(rng, 20) + " " + item, "en", "s", 1, "s", 1, 1))
    all_docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    all_docs.write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, r[0] % 2) for r in more if r[0] < 2000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage


def test_stages(spark, folder):
    path, passage = folder
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = stages["toxicity"](spark, docs, path)
    assert clean.columns == columns and dict(clean.dtypes) == dict(docs.dtypes)
    kept = ids(clean)
    assert {i for i in kept if i and 1000 <= i < 2000} == set(range(1000, 1120, 2)) and {2000, 2001, 2002} <= kept
    one = stages["ngram_jaccard_join"](spark, docs, path)
    assert one.columns == columns and {2000, 2001, 2002} <= ids(one)
    cut = stages["suffix_array_dedup"](spark, docs, path)
    assert cut.columns == columns and cut.count() == docs.count()
    texts = {r.doc_id: r for r in cut.collect()}
    assert passage[20:-20] not in texts[2000].text and passage[20:-20] not in texts[2001].text
    assert all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)
    fair = stages["benchmark_decontamination"](spark, docs, path)
    assert fair.columns == columns and ids(docs) - ids(fair) == {2002}
    ids_of = stages["bpe_encoding"](spark, docs, path)
    assert ids_of.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and ids_of.count() == docs.count()


def test_run(spark, folder):
    path, _ = folder
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert 2000 in got and 2001 in got and 2002 not in got and 1001 not in got and 1000 in got


def test_empty_tables(spark, docs, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
