"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontamination, embeddings, kneser_ney, language, lines, phrases, pii, sentencepieces, simhash, suffixes, toxicity, variants
from lumenframe.llm.common import remainder


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *more, "text")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder(F.col("doc_id"), 5) == 1
    scored = kneser_ney.held_out(_documents(spark, sf_dir), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "lang")
    held = remainder(F.col("doc_id"), 3) == 1
    model = language.learn(docs.filter(~held))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "spans")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_decode(_documents(spark, sf_dir), vocabulary, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removals(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir))
    counts = [F.expr(f"bigint(size(filter(base, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = remainder(F.col("doc_id"), 5) == 0
    scored = toxicity.detect(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train_on=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = sentencepieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepieces.encode_decode(_documents(spark, sf_dir), model, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir, "lang"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_language_id, op3_line_dedup, op4_embedding_dedup, op5_decontamination, op6_bpe, op7_simhash, op8_suffix_dedup, op9_pii, op10_toxicity, op11_sentencepiece, op12_collocations, op13_variants)}

ORACLES: dict[str, str] = {"op3_line_dedup": lines.ORACLE_SQL, "op12_collocations": phrases.ORACLE_SQL}
