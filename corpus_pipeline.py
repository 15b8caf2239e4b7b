"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote. All but the last return the columns of documents.

1. toxicity: documents that score 0.5 or more go.
2. exact_dedup: of equal texts the smallest doc_id stays.
3. near_dedup: of documents linked by SimHash one stays, that of the smallest doc_id.
4. suffix_dedup: bytes of strings of 200 bytes that occur twice go from the texts; the rows stay.
5. packing: what is left is tokenised and packed into sequences of 2048 tokens.

SQL can't express the classifier, the hashes or the tokenizer, so ORACLE_SQL is None and the
tests hold run() against plain versions of the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselle.llm import exact, packing, simhash, suffix, toxicity
from tesselle.llm.common import SharedTable, scratch, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, stage in STAGES[:-1]:
        with scratch() as spare:  # what a stage has written on its way goes with it
            before, written = written, spare(SharedTable(stage(spark, docs, sf_dir), name))
        docs = written.df
        if before:
            before.drop()
        settle()
    return STAGES[-1][1](spark, docs, sf_dir)
