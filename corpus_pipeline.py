"""The corpus pipeline: stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard_join, langid, mixing, packing, secrets
from tidemark.llm.common import documents, materialise
from tidemark.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier rejects go: those far from every
    language that labelled documents have, and those with null or empty text or
    without a letter. Without labelled documents all go. Long texts are read whole;
    repeated rows stay or go together; an empty table stays empty; extra columns
    stay whatever their names."""
    return langid.keep_accepted(docs, langid.fit(docs.select("doc_id", "lang", "text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id
    (null ids last), and one row of rows that repeat. Texts without words, null or
    empty, are linked with nothing and stay; long texts are read whole; an empty
    table stays empty; extra columns stay whatever their names."""
    return jaccard_join.keep_one_of_each(docs, shingle_words=5, num=75, den=100)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, give way to the name of their kind. All documents
    stay, repeated rows too; null and empty texts stay as they are; n_chars follows
    the text; an empty table stays empty; extra columns stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice, repeats
    as rows of their own. Null texts and texts without words take no budget and stay,
    once; a null source is a source, the last; repeated rows are documents each; ties go by a
    digest of doc_id; an empty table stays empty; extra columns stay."""
    return mixing.mix(docs, weights=(5.0, 2.0, 1.0), budget_ratio=1.5, max_repeats=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset; other columns end here.
    Null and empty texts are their end id alone; long texts are cut; repeated rows
    are packed each; pieces of one length go by a hash of doc_id, start and ids; an
    empty table gives no rows."""
    return packing.pack(docs, tokenizer_path()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", hide_secrets),
    ("mix", mix_sources),
    ("pack", pack),
]

#: The classifier and the tokenizer have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every stage starts from its predecessor's table."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
