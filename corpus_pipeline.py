"""The corpus pipeline: toxicity, near duplicates, repeated passages, contamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept.  All but the last return the columns of ``docs``, whatever
columns those are: only doc_id and text are looked at, the rest is carried.

- toxicity drops the documents that the classifier rejects (fitted on the labelled
  documents that are there, without the held-out third);
- the n-gram Jaccard join keeps one document of each group of near duplicates;
- suffix-array dedup cuts every passage of more than 50 words that occurs again out of
  the texts, all its occurrences (n_chars follows);
- benchmark decontamination drops the contaminated documents and leaves the others as they are;
- encoding returns (doc_id, n_tokens, ids_sha256, decoded_sha256).

Null texts count as empty, are never rejected and stay null where nothing is cut.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import bpe, decontam, near_duplicates, passages, toxicity
from gridwright.llm.common import materialize, release, table, written
from gridwright.llm.queries import labelled, parts_of


def _plain(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but doc_id and text renamed out of the operators' way, and the way back."""
    names = {c: c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(docs.columns)}
    back = {v: k for k, v in names.items()}
    return docs.withColumnsRenamed(names), lambda df: df.select(*back).withColumnsRenamed(back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(labelled(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    plain, back = _plain(docs)
    return back(toxicity.score(plain, model, keep_text=True).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = _plain(docs)
    return back(near_duplicates.keep_one(plain))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = _plain(docs)
    cut = back(passages.remove_repeats(plain, passages.WORDS, keep_text=True))
    if "n_chars" in cut.columns:
        kind = dict(cut.dtypes)["n_chars"]
        cut = cut.withColumn("n_chars", F.char_length("text").cast(kind))
    return cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = _plain(docs)
    hits = decontam.find_hits(plain, table(spark, sf_dir, "benchmark"))
    return back(decontam.judge(hits).where("NOT contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), parts_of(spark), texts=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: No SQL: the classifier and the encoding are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = written()
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep=1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
