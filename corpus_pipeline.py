"""The corpus pipeline: documents in, token counts and digests of the clean corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import bpe, decontamination, minhash, quality, queries, shared, suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go.

    Null and empty texts have no words and go; texts are read whole, whatever their length. Repeated rows get
    equal verdicts and all stay or go. Null ids are judged like others. Columns, whatever their names, stay."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, from a similarity of 0.8 on, the document with the smallest id stays.

    Null and empty texts are nobody's duplicates and stay; a null id is the smallest; repeated rows are one
    document and stay with it. Texts are read whole; columns, whatever their names, stay."""
    return minhash.one_of_each(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that stand earlier in the corpus are cut out of the texts.

    All documents stay, a text may become empty, null texts stay null, characters aren't cut, and n_chars, if
    there, is the new length. Of rows that share an id none is earlier. Other columns, whatever their names, stay."""
    return suffix_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go.

    Null and empty texts have none and stay; texts are searched whole; repeated rows get equal verdicts."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document row; null and empty texts have no tokens."""
    return bpe.tokenise(docs, queries.default_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", benchmark_decontamination),
    ("tokens", tokens),
]

#: Hashed n-gram scores, suffix order and byte-pair merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shared.written(docs)
    return docs
