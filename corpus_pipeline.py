"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import decontamination, packing, simhash, substring, toxicity
from tallybook.llm.shared import table, written
from tallybook.llm.tokens import public_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go; null and empty texts are scored like others."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs.select(F.struct(*docs.columns).alias("all"), "text"), model)
    return scored.where("score < 0.5").select("all.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays, that with the least id."""
    return simhash.keep_one_similar(docs, size=5, similarity=0.8, radius=24)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that occur anywhere else go; a document stays even if its text ends up empty.

    ``n_chars`` follows where a text was cut.
    """
    out = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        cut = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, cut).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (five-word shingles, similarity 0.8 or more) go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids and its place in sequences of 4096 tokens."""
    return packing.pack(docs, public_path("word_bpe_49k.json"), end_id=1, room=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Models and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
