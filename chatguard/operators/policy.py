"""Rule tables, decisions and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatguard.schemas import ENTITIES, SEVERITY, SUBJECTS

RULES = "rule_order int, channel string, id string, entity string, action string, subject string, min_confidence double, only_with_guests boolean, message string"
CHANNELS = "channel string, trigger string, hold boolean, risk string"
TRIGGERS = ["never", "on_uncertain", "always"]

# A policy of our own; entities, actions and thresholds follow the public default of the service.
DEFAULT_POLICY = {
    "defaults": {"tier1_trigger": "on_uncertain", "confidence_threshold": 0.85, "subject_policy": {"self": "allow"}},
    "rules": [
        {"id": "card", "entity": "CREDIT_CARD", "action": "mask"},
        {"id": "card.shape", "entity": "CARD_LIKE", "action": "mask", "min_confidence": 0.7},
        {"id": "sin", "entity": "CA_SIN", "action": "block"},
        {"id": "ssn", "entity": "US_SSN", "action": "block"},
        {"id": "key", "entity": "API_KEY", "action": "block"},
        {"id": "iban", "entity": "IBAN", "action": "mask"},
        {"id": "special", "entity": "SPECIAL_CATEGORY", "action": "quarantine"},
        {"id": "health", "entity": "HEALTH", "action": "quarantine"},
        {"id": "address", "entity": "ADDRESS", "action": "mask", "subject": "third_party"},
        {"id": "phone", "entity": "PHONE", "action": "warn", "subject": "third_party"},
        {"id": "email", "entity": "EMAIL", "action": "mask", "subject": "third_party"},
        {"id": "birth", "entity": "DATE_OF_BIRTH", "action": "mask", "subject": "third_party"},
    ],
    "channels": {},
}


def policy_tables(spark: SparkSession, policy: dict) -> tuple[DataFrame, DataFrame, dict]:
    """(rules in match order, channels, defaults) of a policy document; overrides carry their channel and come first."""
    rows, channels = [], []
    for name, spec in policy.get("channels", {}).items():
        channels.append((name, spec.get("tier1_trigger"), bool(spec.get("hold", False)), spec.get("risk")))
        rows += [(name, r) for r in spec.get("overrides", [])]
    rows += [(None, r) for r in policy.get("rules", [])]
    table = [
        (n, channel, r.get("id", ""), r["entity"], r["action"], r.get("subject"), r.get("min_confidence"), bool(r.get("only_with_guests", False)), r.get("message", f"{r['action']} by policy"))
        for n, (channel, r) in enumerate(rows)
    ]
    defaults = {"trigger": "on_uncertain", "threshold": 0.85, "self": "allow"}
    given = policy.get("defaults", {})
    defaults |= {"trigger": given.get("tier1_trigger", "on_uncertain"), "threshold": given.get("confidence_threshold", 0.85), "self": given.get("subject_policy", {}).get("self", "allow")}
    return spark.createDataFrame(table, RULES), spark.createDataFrame(channels, CHANNELS), defaults


def _rule(n: int, r: dict, threshold: float) -> tuple:
    action = r["action"]
    return (n, r.get("id", ""), r["entity"], action, SEVERITY.index(action), r.get("subject"), float(r.get("min_confidence", threshold)), bool(r.get("only_with_guests", False)), r.get("message", f"{action} by policy"))


_RULE = "struct<rule_order:int, id:string,entity:string,action:string,severity:int,subject:string,least:double,guests:boolean,message:string>"


def _specs(policy: dict) -> tuple[list[tuple[str, list[tuple]]], list[tuple]]:
    """(each channel's overrides, the common rules), numbered in match order: overrides come first."""
    threshold = policy.get("defaults", {}).get("confidence_threshold", 0.85)
    n, own = 0, []
    for name, spec in policy.get("channels", {}).items():
        if rules := spec.get("overrides", []):
            own.append((name, [_rule(n + k, r, threshold) for k, r in enumerate(rules)]))
            n += len(rules)
    return own, [_rule(n + k, r, threshold) for k, r in enumerate(policy.get("rules", []))]


def _literal(rules: list[tuple]) -> Column:
    return F.array(*[F.struct(*map(F.lit, r)) for r in rules]).cast(f"array<{_RULE}>")


def with_rules(messages: DataFrame, policy: dict, channel: str = "channel_name", name: str = "rules") -> DataFrame:
    """messages with `name`: the rules that apply in the row's channel, its overrides before the common rules.

    Overrides are one row a channel of a table, which Spark joins by its size, so the plan is the same for ten
    channels and for ten thousand. Without any override nothing is joined.
    """
    own, common = _specs(policy)
    if not own:
        return messages.withColumn(name, _literal(common))
    table = messages.sparkSession.createDataFrame(own, f"__channel string, __own array<{_RULE}>")
    joined = messages.join(table, F.concat(F.lit("#"), F.col(channel)) == F.col("__channel"), "left")
    return joined.withColumn(name, F.concat(F.coalesce("__own", _literal([])), _literal(common))).drop("__channel", "__own")


def _rules_of(channel: Column, policy: dict) -> Column:
    """with_rules as an expression that holds all overrides: for policies with a few channels."""
    own, common = _specs(policy)
    if not own:
        return _literal(common)
    chosen = F.coalesce(*[F.when(channel == name.removeprefix("#"), _literal(rules)) for name, rules in own if name.startswith("#")], _literal([]))
    return F.concat(chosen, _literal(common))


def decision(findings: Column, channel: Column, guests: Column, policy: dict, rules: Column | None = None) -> Column:
    """struct<action, rule_id, message, finding> for a row's findings.

    rules: what with_rules gave the row; without it the policy's overrides are part of the expression.

    Each finding takes the first rule that matches it, a channel's overrides before the common rules; over the
    findings the most severe action wins, ties the earliest finding. Findings about the author are passed over
    when the policy allows them. Without any match the action is allow and rule and message are null.
    """
    own_allowed = policy.get("defaults", {}).get("subject_policy", {}).get("self", "allow") == "allow"
    rules = _rules_of(channel, policy) if rules is None else rules

    def first_match(f: Column, i: Column) -> Column:
        def fits(r: Column) -> Column:
            return (
                (r["entity"] == f["entity"]) & (r["subject"].isNull() | (r["subject"] == f["subject"])) & (f["confidence"] >= r["least"])
                & (~r["guests"] | F.coalesce(guests, F.lit(False)))
            )

        rule = F.get(F.filter(rules, fits), F.lit(0))
        return F.when(rule.isNotNull() & ~((f["subject"] == "self") & F.lit(own_allowed)), F.struct(rule["severity"].alias("severity"), i.alias("place"), rule["rule_order"].alias("rule_order")))

    best = F.array_min(F.filter(F.transform(findings, first_match), lambda x: x.isNotNull()))
    rule = F.get(F.filter(rules, lambda r: r["rule_order"] == best["rule_order"]), F.lit(0))
    return F.struct(F.coalesce(rule["action"], F.lit("allow")).alias("action"), rule["id"].alias("rule_id"), rule["message"].alias("message"), best["place"].alias("finding"))


def match_rules(findings: DataFrame, rules: DataFrame, threshold: float = 0.85) -> DataFrame:
    """The join form for rule tables of any size: the first matching rule of each finding, as (id, place, rule_id, action, rule_order).

    findings: id, place, entity, confidence, subject, channel, guests; other columns are not read. The rules become
    an index of two levels, one row for each (entity, channel) and one for each entity, that holds its rules in match
    order. A finding meets at most one row of either level and picks within it, so no rows are made that do not
    leave, nothing is grouped afterwards, and Spark may broadcast an index, or split a hot key of the findings.
    """
    one = F.struct("rule_order", F.col("id").alias("rule_id"), "action", "subject", F.coalesce("min_confidence", F.lit(threshold)).alias("least"), F.coalesce("only_with_guests", F.lit(False)).alias("guests"))
    listed = F.array_sort(F.collect_list(one))  # by rule_order, which is unique
    own = rules.filter("channel is not null").groupBy(F.col("entity").alias("__e"), F.col("channel").alias("__c")).agg(listed.alias("__own"))
    common = rules.filter("channel is null").groupBy(F.col("entity").alias("__f")).agg(listed.alias("__common"))

    def first(rules_of: str) -> Column:
        fits = lambda r: (r["subject"].isNull() | (r["subject"] == F.col("subject"))) & (F.col("confidence") >= r["least"]) & (~r["guests"] | F.coalesce("guests", F.lit(False)))
        return F.get(F.filter(rules_of, fits), F.lit(0))

    slim = findings.select("id", "place", "entity", "confidence", "subject", "channel", "guests")
    met = slim.join(own, (F.col("entity") == F.col("__e")) & (F.concat(F.lit("#"), F.col("channel")) == F.col("__c")), "left").join(common, F.col("entity") == F.col("__f"), "left")
    met = met.select("id", "place", first("__own").alias("a"), first("__common").alias("b"))
    rule = F.when(F.col("a").isNull() | (F.col("b.rule_order") < F.col("a.rule_order")), F.col("b")).otherwise(F.col("a"))
    return met.select("id", "place", rule.alias("rule")).filter("rule is not null").select("id", "place", "rule.rule_id", "rule.action", "rule.rule_order")


def model_trigger(messages: DataFrame, channels: DataFrame, default: str = "on_uncertain") -> DataFrame:
    """messages with trigger: the channel's value, else the default."""
    c = channels.select(F.col("channel").alias("__c"), F.col("trigger").alias("__t"))
    return messages.join(c, F.concat(F.lit("#"), F.col("channel_name")) == F.col("__c"), "left").withColumn("trigger", F.coalesce("__t", F.lit(default))).drop("__c", "__t")


def hold_flag(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """messages with held: the channel holds messages and the rules did not remove this one."""
    c = channels.select(F.col("channel").alias("__c"), F.col("hold").alias("__h"))
    joined = messages.join(c, F.concat(F.lit("#"), F.col("channel_name")) == F.col("__c"), "left")
    return joined.withColumn("held", F.coalesce("__h", F.lit(False)) & ~F.col("action").isin("mask", "block", "quarantine")).drop("__c", "__h")


def rule_problems(rules: DataFrame, channels: DataFrame) -> DataFrame:
    """One row (kind, place, problem) for everything wrong in the tables."""
    place = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("rule_order").cast("string"))

    def bad(test: Column, problem: str) -> DataFrame:
        return rules.filter(test).select(F.lit("rule").alias("kind"), place.alias("place"), F.lit(problem).alias("problem"))

    out = bad(F.col("entity").isNull() | ~F.col("entity").isin(ENTITIES), "unknown entity")
    out = out.union(bad(F.col("action").isNull() | ~F.col("action").isin(SEVERITY), "unknown action"))
    out = out.union(bad(F.col("subject").isNotNull() & ~F.col("subject").isin(SUBJECTS), "unknown subject"))
    out = out.union(bad(F.col("min_confidence").isNotNull() & ~F.col("min_confidence").between(0, 1), "confidence outside 0 to 1"))
    again = rules.filter("id is not null and id <> '' and channel is null").groupBy("id").count().filter("count > 1")
    out = out.union(again.select(F.lit("rule"), F.col("id"), F.lit("duplicate id")))
    out = out.union(channels.filter(~F.startswith("channel", F.lit("#"))).select(F.lit("channel"), F.col("channel"), F.lit("name without #")))
    return out.union(channels.filter(F.col("trigger").isNotNull() & ~F.col("trigger").isin(TRIGGERS)).select(F.lit("channel"), F.col("channel"), F.lit("unknown trigger")))
