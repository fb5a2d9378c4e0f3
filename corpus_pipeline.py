"""The corpus pipeline: documents through five operators of the llm subpackage, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchweave.llm import chosen_path, decontaminate, fair_mix, kneser_ney, repair
from patchweave.llm.common import stage, table
from patchweave.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps."""
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return chosen_path.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of virtual finish time."""
    return fair_mix.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks, written and read back: doc_id, start, n_tokens, ids_crc32."""
    return repair.token_output(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("token-ID output", token_output),
]

#: Stages 1, 2 and 5 train a model, sample paths and tokenise, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
