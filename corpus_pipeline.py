"""Corpus pipeline over ``documents``: language ID, near-dedup, pseudonyms, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result as Parquet in the shared checkpoint folder and reads it back as the next one's docs.
All stages but the last return the columns of ``documents``.  Stages keep rows with null
ids or other columns; what happens to null and empty texts is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwise.llm import feistel_pii, langid, minmax_dedup, mixing, packing
from revwise.llm.common import fresh, stage_table

#: Below this posterior a language counts as not recognized.
MIN_SCORE = 0.5
#: The packing stage's tasks remember fewer words than the operator's default, because the
#: Python workers also serve the stages before it and keep the memory they once had.
CACHED_WORDS = 60_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: drop documents without a recognized language; fill in a lang that is null.

    The model learns from the labelled rows of ``docs``.  Null texts and texts without a
    letter are ``und`` and go; without any labelled row nothing can be recognized, and all
    rows with a letter stay as they are.
    """
    model = langid.train(docs)
    pred, score = fresh(docs.columns, "lang_pred", "score")
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model, pred=pred, score=score)
    return (found.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= MIN_SCORE))
            .withColumn("lang", F.coalesce("lang", pred)).select(*[F.col(f"`{c}`") for c in docs.columns]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near duplicates the document with the smallest doc_id stays.

    Rows are dropped by doc_id and text, so of rows that share a doc_id each goes or stays by
    its own text, and rows that repeat both stay together; texts without a word and rows
    without a doc_id are no duplicates.
    """
    doc, key = fresh(docs.columns, "copy_id", "copy_key")
    copies = (minmax_dedup.near_duplicates(docs, text_key=True).where("not kept")
              .select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct())
    same = (F.col(doc) == F.col("doc_id").cast("long")) & (F.col(key) == F.xxhash64(F.col("text").cast("string")))
    return docs.join(copies, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal numbers, dates and addresses become pseudonyms; every row stays.

    ``n_chars`` follows the text (an address of the same form may be longer or shorter).
    """
    count, = fresh(docs.columns, "n_pseudonyms")
    out = feistel_pii.pseudonymize(docs, count=count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a row for each document and epoch in the mix, with the words it takes."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the token pieces of every row and their places in sequences of 4096.

    The rows of one document from several epochs of the mix differ in text_key.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=CACHED_WORDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", pseudonymize),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The stages are not expressible in SQL (see tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
