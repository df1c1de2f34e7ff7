"""From raw documents to packed training rows: toxicity, near duplicates, benchmark leaks, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage starts from its Parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatguard.llm import dartminhash, decontam, mixing, packing, toxicity
from chatguard.llm.queries import VOCABULARY, held_out
from chatguard.llm.store import free_name, keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the lexicon model scores below 0.5; the model learns from labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels))
    return scored.filter("toxic_score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each near-duplicate class."""
    return dartminhash.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for, 0 to 2 times."""
    words, copy = free_name("__words", docs.columns), free_name("__copy", docs.columns)
    mixed = mixing.mix_to_targets(docs.withColumn(words, mixing.word_count("text")), size=words)
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return mixed.filter("mix_copies > 0").withColumn(copy, copies).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("packing", pack_rows),
]

# Scores, signatures and packing are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read back in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, f"pipeline-{name}")
    return docs
