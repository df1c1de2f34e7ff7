"""Plans and amounts of work that must not grow with what a cluster holds."""

import random
import time

import pytest
from pyspark.sql import functions as F

from chatguard import sources
from chatguard.operators import events as E, policy as P, report as R

FINDINGS = "array<struct<entity:string,start:int,end:int,confidence:double,subject:string,tier:int,note:string>>"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _first_rule(rules, f, threshold):
    for order, channel, rule, entity, action, subject, least, guests, _ in sorted(rules):
        if entity == f[2] and channel in (None, f"#{f[5]}") and subject in (None, f[4]) and f[3] >= (threshold if least is None else least) and (not guests or f[6]):
            return rule, action, order
    return None


def test_match_rules_equals_plain_loop(spark):
    rng = random.Random(2)
    rules = [(n, rng.choice([None, None, "#a", "#b", "#c"]), f"r{n}", rng.choice(["IBAN", "EMAIL", "PHONE"]), rng.choice(["mask", "warn"]), rng.choice([None, None, "self"]), rng.choice([None, 0.5, 0.95]), rng.random() < 0.3, "m") for n in range(60)]
    findings = [(f"m{k}", k % 3, rng.choice(["IBAN", "EMAIL", "KEY"]), rng.choice([0.4, 0.6, 0.9, 0.99]), rng.choice(["self", "unknown"]), rng.choice(["a", "b", "z", None]), rng.choice([True, False, None])) for k in range(300)]
    got = P.match_rules(spark.createDataFrame(findings, "id string, place int, entity string, confidence double, subject string, channel string, guests boolean"), spark.createDataFrame(rules, P.RULES), 0.8).collect()
    want = {f[:2]: hit for f in findings if (hit := _first_rule(rules, f, 0.8))}
    assert {(r["id"], r["place"]): (r["rule_id"], r["action"], r["rule_order"]) for r in got} == want and len(got) == len(want)


def test_match_rules_makes_no_more_rows_than_findings(spark):
    """100,000 channel rules: a finding meets its own channel's rules only, and nothing is grouped after the join."""
    n = F.col("id")
    rules = spark.range(100_000).select(n.cast("int").alias("rule_order"), F.concat(F.lit("#c"), (n % 20_000).cast("string")).alias("channel"), F.concat(F.lit("r"), n.cast("string")).alias("id"), F.element_at(F.array(F.lit("IBAN"), F.lit("EMAIL")), (n / 20_000 % 2 + 1).cast("int")).alias("entity"), F.lit("mask").alias("action"), F.lit(None).cast("string").alias("subject"), F.lit(0.5).alias("min_confidence"), F.lit(False).alias("only_with_guests"), F.lit("m").alias("message"))
    findings = spark.range(50_000).select(n.cast("string").alias("id"), F.lit(0).alias("place"), F.lit("IBAN").alias("entity"), F.lit(0.9).alias("confidence"), F.lit("unknown").alias("subject"), F.concat(F.lit("c"), (n % 20_000).cast("string")).alias("channel"), F.lit(False).alias("guests"))
    out = P.match_rules(findings, rules)
    assert out.count() == 50_000
    above = _plan(out).split("Join")[0]
    assert "Aggregate" not in above and "CartesianProduct" not in _plan(out)


def _many_channels(n):
    return {"rules": [{"id": "i", "entity": "IBAN", "action": "mask"}], "channels": {f"#c{k}": {"overrides": [{"id": f"o{k}", "entity": "IBAN", "action": "log"}]} for k in range(n)}}


def test_decisions_by_joined_rules_have_one_plan(spark):
    finding = F.array(F.struct(F.lit("IBAN").alias("entity"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0.9).alias("confidence"), F.lit("unknown").alias("subject"), F.lit(0).alias("tier"), F.lit("").alias("note"))).cast(FINDINGS)
    rows = spark.range(3000).select("id", F.concat(F.lit("c"), (F.col("id") % 3000).cast("string")).alias("channel_name"))
    sizes, took = {}, {}
    for n in (10, 2000):
        policy = _many_channels(n)
        began = time.perf_counter()
        out = P.with_rules(rows, policy).select("id", P.decision(finding, F.col("channel_name"), F.lit(False), policy, F.col("rules")).alias("d")).select("id", "d.action", "d.rule_id")
        got = {r["id"]: (r["action"], r["rule_id"]) for r in out.collect()}
        took[n] = time.perf_counter() - began
        sizes[n] = len(out._jdf.queryExecution().optimizedPlan().toString())
        assert got == {k: ("log", f"o{k}") if k < n else ("mask", "i") for k in range(3000)}
    assert sizes[2000] < 2 * sizes[10] and took[2000] < took[10] + 5


def test_rules_of_a_channel_are_the_same_joined_or_in_the_plan(spark):
    policy = {"rules": [{"id": "a", "entity": "EMAIL", "action": "warn"}, {"id": "b", "entity": "IBAN", "action": "block"}], "channels": {"#x": {"overrides": [{"id": "o", "entity": "IBAN", "action": "log"}]}, "y": {"overrides": [{"id": "no hash", "entity": "IBAN", "action": "log"}]}}}
    rows = spark.createDataFrame([(k, c, [(e, 0, 1, 0.9, "unknown", 0, "")]) for k, (c, e) in enumerate([("x", "IBAN"), ("x", "EMAIL"), ("y", "IBAN"), (None, "IBAN"), ("x", "KEY")])], f"n int, channel string, f {FINDINGS}")
    ruled = P.with_rules(rows, policy, "channel")
    both = ruled.select("n", P.decision(F.col("f"), F.col("channel"), F.lit(False), policy).alias("a"), P.decision(F.col("f"), F.col("channel"), F.lit(False), policy, F.col("rules")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    assert [r["a"]["rule_id"] for r in sorted(both)] == ["o", "a", "b", "b", None]


def test_quantiles_run_nothing_until_read_and_are_exact(spark):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    rows = spark.range(400_000).select((F.col("id") * 7919 % 400_009 * 1.25).alias("ms"))
    sc.setJobGroup("lazy", "lazy")
    out = R.latency_quantiles(rows)
    assert not tracker.getJobIdsForGroup("lazy")
    got = out.first()
    sc.setJobGroup("rest", "rest")
    ranked = sorted(r["ms"] for r in rows.collect())
    assert tuple(got) == (ranked[200_000], ranked[int(0.95 * 400_000)])
    same = R.latency_quantiles(spark.range(100_000).select(F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id").cast("double")).alias("ms"))).first()
    assert same["p50"] == 5.0 and same["p95"] > 5.0


def test_missed_messages_cut_both_sides(spark):
    n = F.col("id")
    history = spark.range(2000).select(F.concat(F.lit("c"), (n % 3).cast("string")).alias("channel"), F.concat(n.cast("string"), F.lit(".5")).alias("ts")).withColumn("event_key", F.concat_ws(".", "channel", "ts"))
    cursors = spark.createDataFrame([("c0", "100.5"), ("c1", "1000.5"), ("c2", "1990.5")], "channel string, last_ts string")
    stored = history.filter("cast(ts as double) % 4 < 1")
    want = {r["event_key"] for r in history.collect() if float(r["ts"]) > float({"c0": 100.5, "c1": 1000.5, "c2": 1990.5}[r["channel"]]) and float(r["ts"]) % 4 >= 1}
    # The thresholds of a cluster, lowered to the size of the test: the stored side is scanned behind a Bloom filter.
    small = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100MB", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        folder = f"{sources.shared_folder(spark)}/missed"
        history.write.mode("overwrite").parquet(f"{folder}/h")
        stored.write.mode("overwrite").parquet(f"{folder}/s")
        out = E.missed_messages(spark.read.parquet(f"{folder}/h"), cursors, spark.read.parquet(f"{folder}/s"))
        assert {r["event_key"] for r in out.collect()} == want
        assert "might_contain" in out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = E.missed_messages(history, cursors, stored)
    assert _plan(out).count("BroadcastHashJoin") >= 2 and {r["event_key"] for r in out.collect()} == want


def test_an_audit_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = lambda *ts: spark.createDataFrame([(float(t), f"i{t}", "mask") for t in ts], "t double, id string, action string")
    day = 86400
    sources.write_audit(rows(10, day + 5, day + 6), path, batch="a")
    sources.write_audit(rows(20, day + 7), path, batch="b")
    sources.write_audit(rows(10, day + 5, day + 6), path, batch="a")
    ids = lambda **how: sorted(r["id"] for r in sources.read_audit(spark, path, **how).collect())
    assert ids() == ["i10", "i20", f"i{day + 5}", f"i{day + 6}", f"i{day + 7}"]
    assert ids(since="1970-01-02") == [f"i{day + 5}", f"i{day + 6}", f"i{day + 7}"] and ids(before="1970-01-02") == ["i10", "i20"]
    assert sorted(p.name for p in (tmp_path / "audit").iterdir() if p.is_dir()) == ["day=1970-01-01", "day=1970-01-02"]
    assert "day" not in sources.read_audit(spark, path).columns
    with pytest.raises(ValueError):
        sources.write_audit(rows(1).withColumn("text", F.lit("x")), path, batch="c")
