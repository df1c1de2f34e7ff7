"""Evaluation against labels, audit roll-ups and backlog reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatguard.schemas import REMOVING

DIMENSIONS = ["action", "channel", "model", "entity"]


def token_usage(audit: DataFrame) -> DataFrame:
    """audit with used: total tokens of the first non-empty of token_usage, tokens and usage; null if unknown."""
    filled = [F.when(F.size(F.col(n)) > 0, F.col(n)) for n in ("token_usage", "tokens", "usage") if n in audit.columns]
    return audit.withColumn("used", F.coalesce(*filled)["total_tokens"])


def routing_summary(audit: DataFrame, baseline: int = 800, grams: float = 0.2, usd: float = 0.15) -> DataFrame:
    """One row of totals: model calls, zero-token share, removals by the rules alone, measured and avoided tokens.

    grams and usd are for 1,000 and 1,000,000 tokens. An empty table gives zeros.
    """
    rows = token_usage(audit)
    called = F.coalesce(F.col("model"), F.lit("")) != ""
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    out = rows.agg(
        F.count("*").alias("total"), count(called).alias("model_calls"), count(~called).alias("zero_token"),
        count(F.col("action").isin(REMOVING) & ~called).alias("removed_by_rules"),
        F.coalesce(F.sum(F.when(called, F.col("used"))), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum(F.when(called, F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"),
        count(called & (F.coalesce("used", F.lit(0)) == 0)).alias("unknown_usage"),
    )
    avoided = F.col("zero_token") * baseline
    return out.withColumns({
        "zero_token_share": F.when(F.col("total") > 0, F.col("zero_token") / F.col("total")).otherwise(0.0),
        "avoided_tokens": avoided, "avoided_usd": avoided * usd / 1_000_000, "avoided_grams": avoided * grams / 1_000,
    })


def counts_by(audit: DataFrame, most: int = 8) -> DataFrame:
    """(dimension, label, n, share): the most frequent actions, channels, models and entities in one pass.

    Missing actions and channels count as unknown, rows without a model not at all; ties go by label. Shares are of the
    dimension's own total.
    """
    label = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    model = F.filter(F.array(F.struct(F.lit("model").alias("dimension"), F.col("model").alias("label"))), lambda x: F.coalesce(x["label"], F.lit("")) != "")
    pairs = [F.struct(F.lit("action").alias("dimension"), label("action").alias("label")), F.struct(F.lit("channel").alias("dimension"), label("channel").alias("label"))]
    entities = F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.struct(F.lit("entity").alias("dimension"), e.alias("label")))
    long = audit.select(F.explode(F.concat(F.array(*pairs), model, entities)).alias("x")).groupBy("x.dimension", "x.label").agg(F.count("*").alias("n"))
    # The rank is limited before rows meet; shares come from one total for each dimension.
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "label")
    top = long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    totals = long.groupBy("dimension").agg(F.sum("n").alias("whole"))
    return top.join(F.broadcast(totals), "dimension").select("dimension", "label", "n", (F.col("n") / F.col("whole")).alias("share"))


def precision_recall(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity, tp, fp, fn, precision, recall) over the sets of entities of each message; 0 where undefined.

    decisions: id, entities (findings about the author left out). labels: id, entity (null for clean rows).
    """
    got = decisions.select("id", F.explode(F.array_distinct("entities")).alias("entity"), F.lit(1).alias("got"))
    want = labels.filter("entity is not null").select("id", "entity", F.lit(1).alias("want"))
    both = got.join(want, ["id", "entity"], "full_outer")
    hit = lambda a, b: F.sum((a & b).cast("long"))
    g, w = F.col("got").isNotNull(), F.col("want").isNotNull()
    out = both.groupBy("entity").agg(hit(g, w).alias("tp"), hit(g, ~w).alias("fp"), hit(~g, w).alias("fn"))
    rate = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(0.0)
    return out.withColumns({"precision": rate("fp"), "recall": rate("fn")})


_SKETCH = 100_000  # a rank of the sketch is off by at most n / _SKETCH


def latency_quantiles(timings: DataFrame, value: str = "ms") -> DataFrame:
    """(p50, p95): elements n // 2 and int(0.95 n) of the sorted values; nulls if there are none.

    A mergeable sketch brackets both elements in one pass; a second pass counts what lies below each bracket and the
    values inside, a few for every _SKETCH rows, among which the exact element is found. Nothing runs before the
    result is read, no row set is sorted, and the one row that both passes share is all that is broadcast.
    """
    slack = 3 / _SKETCH
    rows = timings.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    ends = F.array(*[F.lit(p) for q in (0.5, 0.95) for p in (q - slack, q + slack)])
    facts = rows.agg(F.count("*").alias("n"), F.percentile_approx("v", ends, _SKETCH).alias("e"))
    n = F.col("n")
    ask = lambda name, rank, k: F.struct(F.lit(name).alias("name"), F.floor(rank).alias("rank"), F.col("e")[k].alias("low"), F.col("e")[k + 1].alias("high"))
    asked = F.array(ask("p50", n / 2, 0), ask("p95", n * F.lit(0.95), 2))
    one = facts.filter("n > 0").select(F.explode(asked).alias("q")).select("q.*")
    near = rows.join(F.broadcast(one), F.col("v") <= F.col("high")).groupBy("name", "rank", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("name").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("upto", upto).filter("rank < upto and rank >= upto - n").select("name", "v")
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("v"))).alias(name)
    return found.agg(pick("p50"), pick("p95"))


def case_messages(cases: DataFrame) -> DataFrame:
    """Eval cases as messages: id case.place, one author or one for each message, channel eng by default."""
    one = cases.select("*", F.posexplode(F.coalesce("messages", F.array("text"))).alias("place", "body"))
    author = F.when(F.coalesce("different_authors", F.lit(False)), F.concat(F.lit("U"), F.col("place").cast("string"))).otherwise("U1")
    return one.select(
        F.concat_ws(".", F.col("id"), F.col("place").cast("string")).alias("id"), F.col("id").alias("case_id"), "place", F.coalesce("channel", F.lit("eng")).alias("channel"),
        F.coalesce("channel", F.lit("eng")).alias("channel_name"), author.alias("author"), F.lit(False).alias("guests"), (F.lit(1725000000.0) + F.col("place")).alias("at"), F.col("body").alias("text"),
    )


def case_outcomes(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, category, expect, got, status): the last message of a case decides.

    decisions: case_id, place, action. A known gap that now passes is fixed gap, one that fails known gap.
    """
    last = decisions.groupBy("case_id").agg(F.max_by("action", "place").alias("action")).withColumnRenamed("case_id", "id")
    got = F.when(F.col("action").isin(REMOVING), "removed").otherwise(F.coalesce("action", F.lit("allow")))
    out = cases.join(last, "id", "left").withColumn("got", got)
    good, gap = F.col("got") == F.col("expect"), F.coalesce("known_gap", F.lit(False))
    status = F.when(good & gap, "fixed gap").when(good, "pass").when(gap, "known gap").otherwise("fail")
    return out.select("id", "category", "expect", "got", status.alias("status"))


def coverage_by_category(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("category").pivot("status", ["pass", "fail", "known gap", "fixed gap"]).agg(F.count(F.lit(1))).na.fill(0)


def model_scores(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """(model, correct, cases, median_ms, max_ms), best first: exact match of entity and subject over scored entities.

    responses: model, case_id, findings array<struct<entity,subject>>, latency_ms; expected: case_id, expected
    map<entity,subject>. Public findings and entities that no case expects are left out.
    """
    scored = expected.select(F.explode(F.map_keys("expected")).alias("entity")).agg(F.collect_set("entity").alias("scored"))  # at most 13 entities
    rows = responses.join(expected, "case_id").crossJoin(F.broadcast(scored))
    said = F.array_distinct(F.transform(F.filter("findings", lambda f: (f["subject"] != "public") & F.array_contains("scored", f["entity"])), lambda f: F.concat_ws(":", f["entity"], f["subject"])))
    want = F.transform(F.map_entries("expected"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    right = (F.size(F.array_except(said, want)) == 0) & (F.size(F.array_except(want, said)) == 0)
    out = rows.groupBy("model").agg(F.sum(right.cast("long")).alias("correct"), F.count("*").alias("cases"), F.percentile("latency_ms", F.lit(0.5)).alias("median_ms"), F.max("latency_ms").alias("max_ms"))
    return out.orderBy(F.desc("correct"), "median_ms", "model")


def lane_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("topic", "status").agg(F.count("*").alias("n"))


def latest_dead(jobs: DataFrame, most: int = 20) -> DataFrame:
    return jobs.filter("status = 'dead'").orderBy(F.desc("id")).limit(most).select("id", "dedupe", "error")


def backlog_health(jobs: DataFrame, connected: bool = True, most_dead: int = 50) -> DataFrame:
    """(dead, queued, state): degraded from `most_dead` dead jobs on or without a connection."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    out = jobs.agg(n("dead").alias("dead"), n("queued").alias("queued"))
    return out.withColumn("state", F.when((F.col("dead") >= most_dead) | F.lit(not connected), "degraded").otherwise("ok"))
