"""The thin queries over whole tables, one for each operator, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.llm import audio, chosen_path, decontaminate, fair_mix, kneser_ney, repair, splitters, suffix_dedup, transducer, url_filter
from patchweave.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the package is installed alike on driver and executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio.store_media(table(spark, sf_dir, "documents"))
    return audio.audio_features(audio.store_features(media))


def op2_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


def op5_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_output(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitters.shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_audio, op2_transducer, op3_suffix_dedup, op4_chosen_path, op5_repair, op6_kneser_ney, op7_decontaminate, op8_url_filter, op9_fair_mix, op10_splitters)}
ORACLES = {"op3_suffix_dedup": suffix_dedup.ORACLE, "op4_chosen_path": chosen_path.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op9_fair_mix": fair_mix.ORACLE}
