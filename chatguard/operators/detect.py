"""Detection over message tables: one pandas UDF behind a JVM-side gate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatguard.functions import digits as D
from chatguard.functions.folding import REPEATS, TEENS, TENS, UNITS, fold_text
from chatguard.functions.spans import Part, all_spans, custom_scans, decode_codebook, digit_chains as span_chains, encoded_look, part_of, split_hit
from chatguard.schemas import CODEBOOK, FINDING, FINDINGS

_WORDS = sorted({*UNITS, *TEENS, *TENS, *REPEATS}, key=lambda w: (-len(w), w))
GATE = rf"(?i)[0-9]|[^\x00-\x7F]|\b(?:keycap_ten|{'|'.join(w for w in _WORDS if w.isascii())})\b"
SCAN = f"struct<findings:{FINDINGS},folded:string,groups:array<string>,disguised:int,encoded:boolean>"
SPLIT = "struct<entity:string,indexes:array<int>,confidence:double>"
PART = "struct<folded:string,groups:array<string>,disguised:int>"


def may_hold_digits(text: Column) -> Column:
    """False only for texts that fold to themselves and can hold no finding but a key without digits."""
    key = F.exists(F.array(*[F.lit(p) for p in (*D.KEY_PREFIXES, "sk-")]), lambda p: F.contains(text, p))
    return text.rlike(GATE) | key


SHORT_TEXT = 400  # characters up to which it pays to count repeated words before Python does


def _scanned(text: str, holds: bool, scans) -> tuple:
    if not holds:
        return [], None, [], 0, encoded_look(text, text)
    folded = fold_text(text)
    part = part_of(text, folded)
    return [s._asdict() for s in all_spans(text, folded, scans)], folded, part.groups, part.disguised, encoded_look(text, folded)


def scan_messages(messages: DataFrame, text: str = "text", gate: bool = True, rules: list[tuple[str, str, str | None, float]] | None = None) -> DataFrame:
    """messages with findings, folded, groups, disguised and encoded of every text.

    Texts that the gate passes by go round Python: no findings, folded equals the text. Such a text can still
    look encoded by few distinct words in a row; that takes 13 words with three repeats, or emoji codes, so short
    texts with either go through, and long texts all do (only that look is judged of them where nothing else can
    be found). Null texts count as empty. rules: own (entity, regular expression, check name or empty, confidence)
    rows, tried after the built-in ones; a pattern can match any text, so with rules every text goes through.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.lower(body), "[^a-z]+"), lambda w: w != "")
    repeats = (F.size(words) >= 13) & (F.size(words) - F.size(F.array_distinct(words)) >= 3)
    scans = custom_scans(rules or [])
    holds = may_hold_digits(body) if gate and not rules else F.lit(True)
    through = F.when(holds | (F.length(body) > SHORT_TEXT), True).otherwise(repeats | (F.size(F.split(body, ":")) > 4)) if gate and not rules else F.lit(True)

    @F.pandas_udf(SCAN)
    def scan(texts: pd.Series, may: pd.Series) -> pd.DataFrame:
        rows = [([], None, [], 0, False) if t is None else _scanned(t, bool(h), scans) for t, h in zip(texts, may, strict=True)]
        return pd.DataFrame(rows, columns=["findings", "folded", "groups", "disguised", "encoded"])

    out = messages.withColumn("__scan", scan(F.when(through, body), holds))
    return out.withColumns({
        "findings": F.coalesce("__scan.findings", F.array().cast(FINDINGS)),
        "folded": F.coalesce("__scan.folded", body),
        "groups": F.coalesce("__scan.groups", F.array().cast("array<string>")),
        "disguised": F.coalesce("__scan.disguised", F.lit(0)),
        "encoded": F.coalesce("__scan.encoded", F.lit(False)),
    }).drop("__scan")


def normalize_text(text: Column) -> Column:
    """The folded text as a column."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold_text(t))

    return fold(text)


def detect_split(parts: Column) -> Column:
    """Split hit of each chain (array of PART, oldest first, current message last); null where there is none."""

    @F.pandas_udf(SPLIT)
    def hit(chains: pd.Series) -> pd.DataFrame:
        rows = []
        for chain in chains:
            found = split_hit([Part(p["folded"], list(p["groups"]), p["disguised"]) for p in chain]) if chain is not None and len(chain) > 1 else None
            rows.append(found or (None, None, None))
        return pd.DataFrame(rows, columns=["entity", "indexes", "confidence"])

    enough = F.aggregate(parts, F.lit(0), lambda n, p: n + F.size(p["groups"])) >= 2
    digits = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(F.array_join(p["groups"], ""))) >= 9
    out = hit(F.when((F.size(parts) > 1) & enough & digits, parts))
    return F.when(out["entity"].isNotNull(), out)


def split_as_finding(hit: Column, text: Column, tier: int = 0) -> Column:
    """A split hit as a finding over the whole current message."""
    return F.struct(
        hit["entity"].alias("entity"), F.lit(0).alias("start"), F.length(text).alias("end"), hit["confidence"].alias("confidence"),
        F.lit("unknown").alias("subject"), F.lit(tier).alias("tier"), F.concat(F.lit("split across "), F.size(hit["indexes"]).cast("string"), F.lit(" messages")).alias("note"),
    ).cast(FINDING)


def read_codebook(text: Column, pairs: Column) -> Column:
    """(entity, confidence) of the number that a text holds when its tokens are read by a codebook; null if none."""

    @F.pandas_udf("struct<entity:string,confidence:double>")
    def decode(texts: pd.Series, books: pd.Series) -> pd.DataFrame:
        rows = []
        for t, book in zip(texts, books, strict=True):
            found = decode_codebook(t, [(p["token"], p["digit"]) for p in book if p["token"] is not None]) if t is not None and book is not None else None
            rows.append(found or (None, None))
        return pd.DataFrame(rows, columns=["entity", "confidence"])

    out = decode(text, pairs.cast(CODEBOOK))
    return F.when(out["entity"].isNotNull(), out)


def findings_table(messages: DataFrame) -> DataFrame:
    """One row for each finding, with the message id and the finding's place.

    The outer form keeps Spark from testing the findings below the detector, which would run it a second time.
    """
    rows = messages.select("id", F.posexplode_outer("findings").alias("place", "finding"))
    return rows.filter("place is not null").select("id", "place", "finding.*")


def digit_chain_table(messages: DataFrame) -> DataFrame:
    """(id, start, end, groups) of every chain of two or more digit groups; texts with fewer groups go round Python."""

    @F.pandas_udf("array<struct<start:int,end:int,groups:int>>")
    def chains(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": c[0][0], "end": c[-1][1], "groups": len(c)} for c in span_chains(t)])

    rows = messages.select("id", chains(F.when(F.col("text").rlike(r"(?U)\d\D{1,8}\d"), F.col("text"))).alias("chains"))
    return rows.select("id", F.explode_outer("chains").alias("c")).filter("c is not null").select("id", "c.*")


def spread(messages: DataFrame) -> DataFrame:
    """messages dealt over all cores where a small table comes in fewer splits; larger ones stay as they are read."""
    cores = messages.sparkSession.sparkContext.defaultParallelism
    return messages.repartition(cores) if messages.rdd.getNumPartitions() < cores else messages


def valid_card_counts(messages: DataFrame, text: str = "text") -> DataFrame:
    """Count form of the detector, JVM-side only: card-shaped runs and valid cards for each channel."""
    counted = messages.select("channel", D.card_runs(text).alias("runs"))
    return counted.groupBy("channel").agg(F.count("*").alias("messages"), F.sum(F.size("runs")).cast("long").alias("runs"), F.sum(F.size(F.filter("runs", D.is_card))).cast("long").alias("cards"))
