"""The archive scan: messages in, decisions and audit rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatguard.operators import decide
from chatguard.operators.policy import DEFAULT_POLICY

TABLES = ("documents", "conversations", "events", "pages", "labels")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A message view over the Parquet tables of a folder; its time column, a keyword elsewhere, becomes at."""
    used = [t for t in TABLES if f"FROM {t}" in sql]
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    # A stated number keeps Spark from merging the partitions again by their bytes: what follows costs Python time for each row.
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.sql(sql.replace("REPARTITION(", f"REPARTITION({most}, "), **args)
    return rows.withColumnRenamed("sent_at", "at")


def scan_archive(messages: DataFrame, policy: dict | None = None) -> DataFrame:
    """Decisions of the rules over a table of messages (id, channel, author, at, text).

    One shuffle, by channel and author, and it carries folded text only where the gate lets it through Python.
    """
    named = messages.withColumns({"channel_name": F.col("channel"), "guests": F.lit(False)})
    return decide.rules_decision(named, DEFAULT_POLICY if policy is None else policy)
