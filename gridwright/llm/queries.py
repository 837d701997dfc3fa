"""The queries of the training-data operators, one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

import uuid

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from gridwright.llm import binary_ids, bpe, chat, decontam, langid, near_duplicates, omh, passages, token_count, toxicity
from gridwright.llm.common import shared_dir, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "class_id", "n_links")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the documents whose labels may be learned from."""
    learn = labels.where("crc32(CAST(doc_id AS STRING)) % 3 <> 1").select("doc_id", "toxic").distinct()
    return docs.select("doc_id", "text").join(learn, "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(labelled(docs, table(spark, sf_dir, "labels")))
    got = toxicity.score(docs, model)
    return got.selectExpr("doc_id", "crc32(CAST(doc_id AS STRING)) % 3 = 1 AS held_out", "score", "predicted")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), parts_of(spark), texts=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontam.digest(decontam.judge(decontam.find_hits(docs, table(spark, sf_dir, "benchmark"))))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.compare_edited(documents(spark, sf_dir).select("doc_id", "text"), parts_of(spark))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learn = docs.where("lang IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 4 <> 2").select("text", "lang")
    model = langid.fit(learn, tokenizer_path("piece_bpe_32k.model"))
    got = langid.predict(docs.select("doc_id", "text"), model)
    return got.selectExpr("doc_id", "crc32(CAST(doc_id AS STRING)) % 4 = 2 AS held_out", "lang_pred", "score")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), count_words=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    got = token_count.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"))
    return got.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 4096 AS over_limit")


def op7_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    path = f"{shared_dir(spark)}/gridwright-files-{uuid.uuid4().hex}"
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    staged = binary_ids.encode(docs, tokenizer, end_id=2, parts=parts_of(spark))
    binary_ids.write(staged, path, binary_ids.kind_of(tokenizer))
    return binary_ids.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, "
        "'</s>[INST] ok [/INST]' AS text FROM range(2)"
    )
    return chat.digest_chats(chat.format_chats(rows.unionByName(extra)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_toxicity,
        op3_bpe_round_trip,
        op4_decontamination,
        op5_token_counts,
        op6_order_minhash,
        op7_binary_ids,
        op8_chat_formatting,
        op9_language_id,
        op10_repeated_passages,
    )
}

ORACLE_SQL = {
    "op8_chat_formatting": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, regexp_matches(text, '<s>|</s>|\\[INST\\]|\\[/INST\\]') AS esc,
                   regexp_replace(replace(text, '\\', '\\\\'), '(<)(/?s>)|(\\[)(/?INST\\])', '\\1\\3\\\\\\2\\4', 'g') AS escaped
            FROM rows)
        SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(CASE WHEN esc THEN 2 ELSE 1 END * length(role) + 1 + CASE WHEN role = 'assistant' THEN 7 ELSE 18 END
                        + CASE WHEN esc THEN 1 + length(escaped) ELSE length(text) END) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
