"""The corpus pipeline: stages that each keep what they return for the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontamination, jaccard, lines, toxicity
from lumenframe.llm.common import dropped, fresh, remainder, stored


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, given): all other columns in one, so that no name that an operator gives or needs meets one of theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("given"))


def _unpacked(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` as they were, but for those ``changed``."""
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) if c in ("doc_id", "text") else F.col(f"given.`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the model is fitted to labelled documents outside the held-out fifth."""
    scored = toxicity.detect(spark, _packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), train_on=remainder(F.col("doc_id"), 5) != 0)
    return _unpacked(scored.filter("score < 0.5"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs, n_chars anew; one that loses all its text goes."""
    found = lines.dedup_lines(_packed(docs)).filter("n_removed = 0 OR text IS NULL OR text <> ''")
    if "n_chars" not in docs.columns:
        return _unpacked(found, docs)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("given.n_chars")).cast(docs.schema["n_chars"].dataType)
    return _unpacked(found, docs, n_chars=n_chars)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, 0.8 or more alike in five-word shingles: that of the least id.

    Of rows of that id, repeated ones included, one stays, and of a group without ids one.
    """
    own, row = fresh(docs.columns, "_own"), F.monotonically_increasing_id()
    rows = stored(docs.withColumn(own, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row.alias("row"))))
    near = jaccard.near_duplicates(rows.select(own, "text"), id_col=own)
    stay = near.filter(F.col(own) == F.col("component_id")).select(F.col(f"{own}.row").alias("stay"))
    return rows.join(stay, F.col(f"{own}.row") == F.col("stay"), "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    found = decontamination.decontaminate(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(found.filter(~F.col("contaminated")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and the digests of its ids and of what they decode to."""
    import public_tokenizers

    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_decode(docs.select("doc_id", "text"), vocabulary, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("SimHash near-dedup", drop_near_duplicates), ("benchmark decontamination", drop_contaminated), ("BPE encoding", encode)]

#: Stages here are fitted models and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                dropped(before)
            before = docs
    return docs
