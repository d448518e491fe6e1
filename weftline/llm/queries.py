"""Queries opN_<name>: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm import bpe

    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import media

    return media.chunked_media(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import mixing

    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import embeddings

    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import sharding

    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_langid_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import langid

    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op6_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import brown

    return brown.score_documents(table(spark, sf_dir, "documents"))


def op2_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import secrets

    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op5_toxic_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import toxicity

    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm import tokenids

    return tokenids.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op12_spelling_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import spelling

    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import negatives

    return negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_chunked_media, op2_secret_network, op3_flow_mix, op4_langid_ftrl, op5_toxic_kneser_ney, op6_brown_classes, op7_projection_passes, op8_splitter_shards, op9_byte_bpe, op10_simhash, op11_ranked_ids, op12_spelling_fm, op13_slot_negatives, pipeline)
}

#: Slots and merges are a way to compute it; the SQL states what is asked: positives by rank, then negatives in each window.
OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id AS negative, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS nth
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, nth::INTEGER AS rank, negative AS negative_id, positive_score, negative_score
FROM n WHERE nth <= 10"""

#: Learnt models, sampled splitters, hashes of tokens, iterated links and a tokenizer's merges have no SQL form; tests/llm has
#: brute force.
ORACLE_SQL: dict[str, str] = {"op13_slot_negatives": OP13_SQL}
