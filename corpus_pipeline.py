"""From documents to token ids in five stages, each an operator of ``weftline.llm`` over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, langid, mixing, secrets, simhash
from weftline.llm.common import doc_crc, written

#: Rows of whole texts that Spark hands to Python at a time, where the session leaves Spark's own number.
BATCH, PLAIN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: A text is kept if it has a letter and its language is predicted at least so surely.
LEAST_SURE = 0.5


def small_batches(spark: SparkSession) -> None:
    """Ten thousand whole texts fill tens of megabytes in each task and its Python worker, a thousand do as well. A session
    that names a number of its own keeps it."""
    if spark.conf.get(BATCH, PLAIN) == PLAIN:
        spark.conf.set(BATCH, "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language predicted at ``LEAST_SURE``. Repeated rows stay;
    without labelled documents no language is known and all go."""
    small_batches(spark)
    model = langid.fit(docs.where((doc_crc(F.col("doc_id")) % 5 != 0) & F.col("lang").isNotNull()))
    return langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id, of rows that repeat that id one;
    a group without any id keeps one of its rows. No documents: none.

    Groups are settled on ids and hashes of rows alone; whole rows are shuffled once, to meet the hashes kept.
    """
    small_batches(spark)
    own = "weftline_row"
    hashed = docs.withColumn(own, F.xxhash64(*docs.columns))
    rows = written(simhash.near_duplicates(hashed, (own,)).select("doc_id", own, "root"), "near-groups")
    first = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", own)).alias("r")).select(f"r.{own}")
    times = rows.groupBy(own).agg(F.count("*").alias("n"))
    kept = written(first.join(times, own), "near-kept")
    out = hashed.join(kept.hint("shuffle_hash"), own)
    if kept.where("n > 1").isEmpty():
        return out.select(docs.columns)
    again = out.where("n > 1").groupBy(own).agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")  # equal rows
    return out.where("n = 1").select(docs.columns).unionByName(again)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by ``[SECRET]``; keeps all documents, null texts as they are."""
    small_batches(spark)
    clean = secrets.redact(docs, secrets.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does, up to three times; one row for each time. Rows that
    share an id are taken as often as the one of them that is taken most."""
    small_batches(spark)
    sized = written(mixing.word_sizes(docs), "word-sizes")
    times = mixing.mix(sized.withColumn("sources", F.array("source"))).where("times > 0").groupBy("doc_id").agg(F.max("times").alias("times"))
    return docs.join(times.hint("shuffle_hash"), docs.doc_id.eqNullSafe(times.doc_id)).select(*[docs[c] for c in docs.columns], F.explode(F.expr("sequence(1L, times)")).alias("nth")).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each text, none for a null or empty one; a row for every row."""
    small_batches(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN).select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

#: Models, fingerprints and tokens have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
