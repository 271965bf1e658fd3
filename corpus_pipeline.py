"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import arrowtext, bpe_codec, jaccard_join, secret_scan, source_mixing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the rest, null texts included, stay unchanged."""
    model = toxicity.learn_from_tables(spark, sf_dir, docs)
    # positional names: no column of the documents can clash with the score
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = toxicity.score_toxicity(docs.toDF(*names), model, text=names[docs.columns.index("text")], out="score")
    return scored.filter(F.col("score") < toxicity.TOXIC_AT).select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id stays of each class of near-duplicates."""
    return jaccard_join.keep_one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the new text."""
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture, which slot and place carry on."""
    return source_mixing.mixed_order(docs, places=True, shares=source_mixing.SHARES)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, slot and place in the mixture, and the digests of each text's tokens."""
    import public_tokenizers

    return bpe_codec.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "source", "slot", "place"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix),
    ("bpe_codec", encode),
]

#: Learned scores and tokenizer merges have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what each kept is a table in the shared folder until the next has read it."""
    folder = f"{arrowtext.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = arrowtext.table_path(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            arrowtext.remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
