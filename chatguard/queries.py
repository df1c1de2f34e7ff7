"""Registered queries of the chat library and the SQL they must agree with."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatguard import detection_sql as S, golden, schemas, sources, streaming
from chatguard.functions import digits as D
from chatguard.operators import decide, detect, events as E, policy as P, report as R, windows as W
from chatguard.plans import scan, views as V
from chatguard.sources import shared_folder, synth

KEY = "archive-key"
NOW = V.BASE + 5000.0


def _msgs(spark: SparkSession, d: str) -> DataFrame:
    """Messages over the events table."""
    return scan.view(spark, d, V.MSGS_EVENTS)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.view(spark, d, V.AUDIT_EVENTS)
    usage = F.when(F.col("total_tokens").isNotNull(), F.create_map(F.lit("total_tokens"), "total_tokens"))
    return rows.withColumns({"token_usage": usage, "entities": F.when(F.col("entity").isNotNull(), F.array("entity")), "cost_usd": F.col("total_tokens") / 1000.0})


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return scan.view(spark, d, V.JOBS_EVENTS)


def _raw_events(spark: SparkSession, d: str) -> DataFrame:
    """Raw deliveries: every message, a repeat of every 25th, an edit of every 20th; every 30th is a bot's."""
    m = _msgs(spark, d)
    ts = F.concat(F.col("at").cast("long").cast("string"), F.lit(".000100"))
    none = F.lit(None).cast("string")
    inner = "struct<user:string,ts:string,text:string,subtype:string,bot_id:string,thread_ts:string,edited:struct<ts:string>>"
    base = m.select(
        "event_id", F.lit("message").alias("type"), "channel", F.col("author").alias("user"), ts.alias("ts"), "text", none.alias("subtype"),
        F.when(F.col("event_id") % 30 == 0, "B1").alias("bot_id"), none.alias("thread_ts"), F.lit(None).cast("struct<ts:string>").alias("edited"), F.lit(None).cast(inner).alias("message"), F.lit(0).alias("delivery"),
    )
    again = base.filter("event_id % 25 = 0").withColumn("delivery", F.lit(1))
    late = F.concat((F.col("ts").cast("double") + 60).cast("long").cast("string"), F.lit(".000200"))
    edited = F.struct(F.col("user"), F.col("ts"), F.concat("text", F.lit(" (edited)")).alias("text"), none.alias("subtype"), F.col("bot_id"), none.alias("thread_ts"), F.struct(late.alias("ts")).alias("edited"))
    edits = base.filter("event_id % 20 = 0").withColumns({"message": edited, "subtype": F.lit("message_changed"), "delivery": F.lit(2)})
    edits = edits.withColumns({"user": none, "text": none, "bot_id": none})
    return base.unionByName(again).unionByName(edits)


def card_counts(spark, d):
    return detect.valid_card_counts(scan.view(spark, d, V.MSGS_DOCS))


def digit_checks(spark, d):
    m = _msgs(spark, d)
    body = F.left("card", F.lit(15))
    return m.select("id", D.luhn_ok("card").alias("luhn"), D.is_card("card").alias("card_ok"), D.is_sin("sin").alias("sin_ok"), D.is_ssn(F.substr("card", F.lit(5), F.lit(9))).alias("ssn_ok"), D.luhn_complete(body).alias("completed"), D.luhn_ok(D.break_luhn("card")).alias("broken"), D.group_digits("card", [4, 6, 5]).alias("grouped"))


def text_checks(spark, d):
    m = _msgs(spark, d)
    return m.select("id", F.round(D.entropy("text"), 6).alias("entropy"), D.has_card_context("text").alias("card_word"), D.has_sin_context("text").alias("sin_word"), D.is_secret("text").alias("secret"), D.fold_shortcodes("text").alias("unshort"))


def masked_fingerprints(spark, d):
    m = _msgs(spark, d)
    span = F.struct(F.lit("X").alias("entity"), (F.col("rn") % 7).cast("int").alias("start"), (F.col("rn") % 7 + 5).cast("int").alias("end"), F.lit(1.0).alias("confidence"), F.lit("unknown").alias("subject"), F.lit(0).alias("tier"), F.lit("").alias("note"))
    return m.select("id", D.mask_text("text", F.array(span), "*").alias("masked"), D.fingerprint("text", KEY).alias("text_hmac"))


def plain_texts(spark, d):
    m = _msgs(spark, d)
    marked = F.concat(F.lit("&lt;"), "id", F.lit("&gt; <mailto:a@b.c|mail> <https://x.y/"), F.col("event_id").cast("string"), F.lit("> <@U7> "), "text", F.lit(" R&amp;D"))
    return m.select("id", E.plain_text(marked).alias("plain"))


def intake(spark, d):
    raw = _raw_events(spark, d)
    rows = E.unwrap_edits(E.human_messages(raw)).withColumn("event_key", E.event_key())
    rows = E.dedupe_events(rows, ["delivery", "event_id"])
    return rows.select("event_key", F.col("user").alias("author"), E.posted_at().alias("at"), "text")


def _stored(spark, d):
    return E.unwrap_edits(E.human_messages(_raw_events(spark, d))).withColumn("event_key", E.event_key())


def cursors(spark, d):
    return E.channel_cursors(_stored(spark, d))


def missed(spark, d):
    history = _stored(spark, d).filter("delivery = 0")
    past = history.filter(F.col("ts").cast("double") < V.BASE + 2000)
    gone = history.filter("event_id % 2 = 0")
    return E.missed_messages(history, E.channel_cursors(past), gone).select("channel", "ts", "event_key")


def seeds(spark, d):
    history = _stored(spark, d).filter("delivery = 0")
    past = history.filter(F.col("ts").cast("double") < V.BASE + 2000)
    return E.window_seed(history, E.channel_cursors(past), V.BASE + 1990.0).select("channel", "ts", "event_key")


def _dims(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    channels = events.filter("event_type <> 'click'").select(F.col("event_type").alias("channel"), F.concat(F.lit("c-"), "event_type").alias("name")).distinct()
    users = events.select("user_id").distinct().select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("Person "), F.col("user_id").cast("string"))).alias("real_name"), (F.col("user_id") % 37 == 0).alias("is_restricted"), F.struct(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("nick"), F.col("user_id").cast("string"))).alias("display_name")).alias("profile"))
    members = events.groupBy(F.col("event_type").alias("channel")).agg(F.slice(F.array_sort(F.collect_set("user_id")), 1, 60).alias("ids")).select("channel", F.transform("ids", lambda i: F.concat(F.lit("u"), i.cast("string"))).alias("members"))
    return channels, users, members


def named_messages(spark, d):
    channels, users, members = _dims(spark, d)
    m = _msgs(spark, d).select("id", "channel", "author")
    named = E.with_display_name(E.with_guest_flag(E.with_channel_name(m, channels), E.guest_channels(members, users)), users)
    return named.select("id", "channel_name", "guests", "display_name")


def restores(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    tickets = e.select(F.col("event_id").cast("string").alias("id"), (F.lit(float(V.BASE)) + F.col("event_id")).alias("created_at"))
    asked = e.select(F.expr("cast(event_id - event_id % 3 as string)").alias("ticket_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor_id"), (F.lit(float(V.BASE)) + F.col("event_id") + (F.col("event_id") * 37) % 1800).alias("at"))
    managers = e.filter("user_id % 4 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"))
    return E.restorable(tickets, asked, managers)


def chains(spark, d):
    m = W.recent_chain(_msgs(spark, d), ["rn"])
    return m.select("id", F.array_join(F.transform("chain", lambda c: c["id"]), ",").alias("chain"))


def sessions(spark, d):
    return W.author_session(_msgs(spark, d)).select("id", "session")


def _audit_findings(spark, d) -> DataFrame:
    rows = scan.view(spark, d, V.AUDIT_EVENTS).filter("entity is not null")
    n = F.substr("id", F.lit(3)).cast("long")
    return rows.select("id", F.lit(0).alias("place"), "entity", (F.lit(0.7) + n % 4 * 0.1).alias("confidence"), F.lit("unknown").alias("subject"), "channel", (n % 2 == 0).alias("guests"))


_POLICY = {
    "defaults": {"confidence_threshold": 0.85, "subject_policy": {"self": "allow"}},
    "rules": [{"id": "card", "entity": "CREDIT_CARD", "action": "mask"}, {"id": "card.low", "entity": "CREDIT_CARD", "action": "log", "min_confidence": 0.75}, {"id": "sin", "entity": "CA_SIN", "action": "block", "only_with_guests": True}],
    "channels": {"#click": {"overrides": [{"entity": "CREDIT_CARD", "action": "warn"}], "tier1_trigger": "always", "hold": True}, "#view": {"tier1_trigger": "never"}},
}


def rule_join(spark, d):
    rules, _, defaults = P.policy_tables(spark, _POLICY)
    return P.match_rules(_audit_findings(spark, d), rules, defaults["threshold"])


def rule_decisions(spark, d):
    f = _audit_findings(spark, d)
    finding = F.array(F.struct("entity", F.lit(0).alias("start"), F.lit(1).alias("end"), "confidence", "subject", F.lit(0).alias("tier"), F.lit("").alias("note")))
    ruled = P.with_rules(f, _POLICY, "channel")
    return ruled.select("id", P.decision(finding, F.col("channel"), F.col("guests"), _POLICY, F.col("rules")).alias("d")).select("id", "d.action", F.coalesce("d.rule_id", F.lit("none")).alias("rule_id"))


def triggers(spark, d):
    _, channels, defaults = P.policy_tables(spark, _POLICY)
    rows = scan.view(spark, d, V.AUDIT_EVENTS).select("id", "action", F.col("channel").alias("channel_name"))
    return P.hold_flag(P.model_trigger(rows, channels, defaults["trigger"]), channels).select("id", "trigger", "held")


def rule_checks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rules = e.select(
        F.col("event_id").cast("int").alias("rule_order"), F.lit(None).cast("string").alias("channel"), F.concat(F.lit("r"), (F.col("event_id") - (F.col("event_id") % 50 == 1).cast("int")).cast("string")).alias("id"),
        F.when(F.col("event_id") % 41 == 0, "CARD").otherwise("CREDIT_CARD").alias("entity"), F.when(F.col("event_id") % 43 == 0, "drop").otherwise("mask").alias("action"), F.when(F.col("event_id") % 47 == 0, "me").alias("subject"),
        F.when(F.col("event_id") % 53 == 0, 1.5).alias("min_confidence"), F.lit(False).alias("only_with_guests"), F.lit("").alias("message"),
    )
    channels = e.select(F.concat(F.when(F.col("event_id") % 60 == 7, "").otherwise("#"), F.lit("c"), F.col("event_id").cast("string")).alias("channel"), F.when(F.col("event_id") % 180 == 9, "often").alias("trigger"), F.lit(False).alias("hold"), F.lit(None).cast("string").alias("risk"))
    return P.rule_problems(rules, channels)


def located(spark, d):
    m = _msgs(spark, d)
    item = lambda t: F.struct(F.lit("PHONE").alias("entity"), t.alias("text"), F.lit("unknown").alias("subject"), F.lit(0.9).alias("confidence"))
    found = F.array(item(F.substr("text", F.lit(3), F.lit(4))), item(F.concat("id", F.lit("#"))))
    spans = decide.locate_spans(F.col("text"), found)
    return m.select("id", F.size(spans).alias("found"), F.get(spans, F.lit(0))["start"].alias("first_start"), F.get(spans, F.lit(0))["end"].alias("first_end"))


def rebuilt(spark, d):
    m = _msgs(spark, d)
    texts = F.array(F.left("card", F.lit(8)), F.substr("card", F.lit(9)))
    value = F.when(F.col("event_id") % 2 == 0, F.col("card")).otherwise(F.concat(F.substr("card", F.lit(9)), F.left("card", F.lit(8))))
    numbers = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0)))
    item = F.struct(F.lit("CREDIT_CARD").alias("entity"), value.alias("value"), numbers.alias("message_numbers"), F.lit(0.9).alias("confidence"))
    return m.select("id", F.size(decide.window_hits(F.array(item), texts)).alias("hits"))


def usage(spark, d):
    a = scan.view(spark, d, V.AUDIT_EVENTS)
    used = lambda k: F.create_map(F.lit("prompt_tokens"), F.lit(k), F.lit("completion_tokens"), F.lit(1), F.lit("total_tokens"), F.coalesce("total_tokens", F.lit(0)))
    single = a.select("id", F.lit("single").alias("kind"), F.lit("s").alias("model"), used(2).alias("usage"))
    window = a.filter("model is not null").select("id", F.lit("window").alias("kind"), "model", used(3).alias("usage"))
    out = decide.usage_totals(single.unionByName(window))
    return out.select("id", "model", F.col("token_usage")["prompt_tokens"].alias("prompt_tokens"), F.col("token_usage")["total_tokens"].alias("total_tokens"))


def _acted(spark, d) -> DataFrame:
    a = scan.view(spark, d, V.AUDIT_EVENTS)
    n = F.substr("id", F.lit(3)).cast("long")
    finding = lambda e, s, x, y: F.struct(e.alias("entity"), F.lit(x).alias("start"), F.lit(y).alias("end"), F.lit(0.9).alias("confidence"), s.alias("subject"), F.lit(0).alias("tier"), F.when(n % 33 == 0, "obfuscated").otherwise("").alias("note"))
    both = F.array(finding(F.coalesce("entity", F.lit("PHONE")), F.lit("unknown"), 2, 4), finding(F.lit("EMAIL"), F.when(n % 2 == 0, "self").otherwise("unknown"), 5, 7))
    return a.withColumns({
        "findings": both.cast(schemas.FINDINGS), "text": F.concat(F.lit("m-"), "channel", F.lit("-"), n.cast("string")), "rule_id": F.lit("r"), "message": F.lit("x by policy"), "at": F.col("t"),
        "related_ids": F.when(n % 22 == 0, F.array(F.concat(F.lit("e."), (n - n % 5).cast("string")), "id")).otherwise(F.array().cast("array<string>")),
        "held": n % 6 == 0, "thread_ts": F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, F.lit("7")),
    })


def removals(spark, d):
    return decide.removal_targets(_acted(spark, d))


def outgoing(spark, d):
    return decide.outgoing_text(_acted(spark, d), "split", "hidden").filter("outgoing is not null").select("id", "outgoing")


def notices(spark, d):
    return decide.author_notice(_acted(spark, d))


def releases(spark, d):
    return decide.held_releases(_acted(spark, d)).select("id", "channel", "text", "thread")


def audit_lines(spark, d):
    rows = decide.audit_rows(_acted(spark, d), KEY)
    return rows.select("t", "id", "channel", "author", "text_hmac", "action", "rule", F.array_join("entities", ",").alias("entities"), "tier", "related")


def routing(spark, d):
    return R.routing_summary(_audit(spark, d))


def top_counts(spark, d):
    return R.counts_by(_audit(spark, d))


def latency(spark, d):
    return R.latency_quantiles(scan.view(spark, d, V.AUDIT_EVENTS))


def job_lanes(spark, d):
    return R.lane_counts(_jobs(spark, d))


def dead_jobs(spark, d):
    return R.latest_dead(_jobs(spark, d))


def health(spark, d):
    return R.backlog_health(_jobs(spark, d))


def claims(spark, d):
    return W.claimable_jobs(_jobs(spark, d), V.BASE + 200.0).select("id", "topic", "lane")


def retries(spark, d):
    return W.retry_plan(_jobs(spark, d).filter("status <> 'done'"), NOW).select("id", "status", "available_at", "error")


def pruned(spark, d):
    return W.prune_done(_jobs(spark, d), NOW, 3000).select("id", "status")


def coverage(spark, d):
    a = scan.view(spark, d, V.AUDIT_EVENTS)
    n = F.substr("id", F.lit(3)).cast("long")
    cases = a.select("id", F.col("channel").alias("category"), F.when(n % 11 == 0, "removed").otherwise("allow").alias("expect"), (n % 26 == 0).alias("known_gap"))
    return R.coverage_by_category(R.case_outcomes(cases, a.select(F.col("id").alias("case_id"), F.lit(0).alias("place"), "action"))).withColumnsRenamed({"pass": "passed", "fail": "failed", "known gap": "known_gap", "fixed gap": "fixed_gap"})


def model_ranking(spark, d):
    a = scan.view(spark, d, V.AUDIT_EVENTS).filter("model is not null")
    said = a.select("model", F.col("id").alias("case_id"), F.array(F.struct(F.coalesce("entity", F.lit("PHONE")).alias("entity"), F.when(F.col("ms") < 25, "unknown").otherwise("public").alias("subject"))).alias("findings"), F.col("ms").alias("latency_ms"))
    want = a.select(F.col("id").alias("case_id"), F.when(F.col("entity").isNotNull(), F.create_map("entity", F.lit("unknown"))).otherwise(F.create_map().cast("map<string,string>")).alias("expected"))
    return R.model_scores(said, want)


def archive_scan(spark, d):
    rows = scan.scan_archive(_msgs(spark, d).select("id", "channel", "author", "at", "text"), P.DEFAULT_POLICY)
    return rows.select("id", "action", F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.array_join("related_ids", ",").alias("related"))


def document_scan(spark, d):
    rows = detect.spread(scan.view(spark, d, V.MSGS_DOCS))
    return detect.findings_table(detect.scan_messages(rows)).select("id", "place", "entity", "start", "end", "confidence", "note")


def digit_chains(spark, d):
    return detect.digit_chain_table(detect.spread(scan.view(spark, d, V.MSGS_DOCS)))


def conversation_scan(spark, d):
    found = detect.scan_messages(scan.view(spark, d, V.MSGS_CONV_CARDS))
    count = lambda e: F.sum(F.size(F.filter("findings", lambda f: f["entity"] == e)))
    return found.groupBy("author").agg(F.count("*").alias("messages"), count("CREDIT_CARD").alias("cards"), count("CARD_LIKE").alias("shapes"))


def custom_rules(spark, d):
    rules = [("PHONE", r"\b555-0\d{3}\b", "", 0.9), ("ORDER", r"(?i)\border \d+\b", None, 0.8), ("EVEN", r"\b\d{2} of\b", "luhn", 0.5)]
    found = detect.scan_messages(_msgs(spark, d), rules=rules)
    return found.select("id", F.array_join(F.transform("findings", lambda f: f["entity"]), ",").alias("entities"), F.get("findings", F.lit(0))["confidence"].alias("confidence"))


def disguises(spark, d):
    return detect.scan_messages(_msgs(spark, d)).select("id", F.array_join("groups", ",").alias("groups"), "disguised", "encoded")


def splits(spark, d):
    """Split values of every message and its chain, whatever the message alone holds."""
    rows = decide.with_parts(detect.scan_messages(_msgs(spark, d).select("id", "channel", "author", "at", "text")))
    ids = F.concat(F.transform("chain", lambda m: m["id"]), F.array("id"))
    hit = rows.withColumn("hit", detect.detect_split(F.col("parts"))).filter("hit is not null")
    return hit.select("id", "hit.entity", F.array_join(F.transform("hit.indexes", lambda i: F.get(ids, i)), ",").alias("related"))


def codebooks(spark, d):
    """Card numbers written in ten words, read back by a codebook that a model might have returned."""
    words = "ba ce di fo gu ha je ki lo mu".split()
    m = _msgs(spark, d)
    number = F.when(F.col("event_id") % 3 == 0, D.break_luhn("card")).otherwise(F.col("card"))
    text = F.array_join(F.transform(F.filter(F.split(number, ""), lambda c: c != ""), lambda c: F.element_at(F.array(*[F.lit(w) for w in words]), c.cast("int") + 1)), " ")
    book = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(str(n)).alias("digit")) for n, w in enumerate(words)])
    read = detect.read_codebook(text, book)
    return m.select("id", read["entity"].alias("entity"), read["confidence"].alias("confidence"))


def case_rows(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("event_id")
    cases = e.select(
        F.concat(F.lit("C"), n.cast("string")).alias("id"), F.when(n % 3 == 0, F.concat(F.lit("only "), n.cast("string"))).alias("text"),
        F.when(n % 3 != 0, F.array(F.lit("first"), F.concat(F.lit("then "), n.cast("string")))).alias("messages"), F.when(n % 4 == 0, F.col("event_type")).alias("channel"), F.when(n % 5 == 0, True).alias("different_authors"),
    )
    return R.case_messages(cases).select("id", "case_id", "place", "channel", "author", "at", "text")


def golden_cases(spark, d):
    """A golden case for every event, by its number, through the rules to the outcome."""
    n = F.col("event_id") % len(golden.CASES)
    table = spark.createDataFrame([(k, c.category, None if len(c.messages) > 1 else c.messages[0], c.messages if len(c.messages) > 1 else None, c.apart, c.expect, c.gap) for k, c in enumerate(golden.CASES)], "k long, category string, text string, messages array<string>, different_authors boolean, expect string, known_gap boolean")
    events = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("G"), F.col("event_id").cast("string")).alias("id"), n.alias("k"))
    cases = events.join(F.broadcast(table), "k").withColumn("channel", F.col("id")).drop("k")
    decided = decide.rules_decision(R.case_messages(cases), P.DEFAULT_POLICY)
    return R.case_outcomes(cases, decided.select("case_id", "place", "action"))


def audit_files(spark, d):
    """Audit lines written to files in batches, one of them twice, and read back, counted by action."""
    path = f"{shared_folder(spark)}/chatguard/audit-{uuid.uuid4().hex}"
    lines = decide.audit_rows(_acted(spark, d), KEY)
    for batch in (0, 1, 0):
        sources.write_audit(lines.filter(F.pmod(F.crc32("id"), F.lit(2)) == batch), path, batch=f"b{batch}")
    lines = sources.read_audit(spark, path)
    return lines.groupBy("action").agg(F.count("*").alias("lines"), F.sum(F.size("entities")).alias("entities"), F.sum("related").cast("long").alias("related"), F.countDistinct("text_hmac").alias("texts"))


def event_files(spark, d):
    """Raw events written as JSON lines and read back: human messages as the library sees them."""
    path = f"{shared_folder(spark)}/chatguard/events-{uuid.uuid4().hex}"
    _raw_events(spark, d).filter("delivery = 0").drop("delivery", "event_id").write.json(path)
    rows = E.to_messages(E.unwrap_edits(E.human_messages(sources.read_events(spark, path))))
    return rows.select("id", "event_key", "author", "at", "text")


def labelled_files(spark, d):
    """Labelled messages written as JSON arrays of a thousand each and read back, counted by channel and label."""
    path = f"{shared_folder(spark)}/chatguard/labelled-{uuid.uuid4().hex}"
    label = F.when(F.col("entity").isNotNull(), F.struct("entity", F.array("start", "end").alias("span"), "subject"))
    rows = _synth(spark, d).select(F.floor(F.col("n") / 1000).alias("part"), F.struct("ts", "user", "channel", "text", label.alias("label")).alias("row"))
    rows.groupBy("part").agg(F.to_json(F.collect_list("row")).alias("value")).write.partitionBy("part").text(path)
    known = sources.read_labelled(spark, path)
    chars = F.sum(F.element_at("label.span", 2) - F.element_at("label.span", 1)).cast("long")
    return known.groupBy("channel", F.coalesce("label.entity", F.lit("none")).alias("entity"), F.coalesce("label.subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("n"), F.coalesce(chars, F.lit(0)).alias("chars"))


def report_file(spark, d):
    """The roll-up written as one small table and read back."""
    path = f"{shared_folder(spark)}/chatguard/report-{uuid.uuid4().hex}"
    totals = R.routing_summary(_audit(spark, d))
    sources.write_report(totals, path)
    return spark.read.schema(totals.schema).parquet(path)


def label_split(spark, d):
    """Counts by kind of the synthetic messages before and in the hold-out."""
    rows = _synth(spark, d)
    size = spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0] + 1
    train, held = synth.holdout_split(rows, size)
    both = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("held")))
    return both.groupBy("part", "kind").agg(F.count("*").alias("n"))


def _scanned(spark, d) -> DataFrame:
    m = detect.scan_messages(_msgs(spark, d).select("id", "channel", "author", "at", "text"))
    acted = P.decision(F.col("findings"), F.col("channel"), F.lit(False), P.DEFAULT_POLICY)["action"]
    return m.withColumn("removes", acted.isin(schemas.REMOVING))


def rules_lane(spark, d):
    lane = W.ordered_rules_lane(_scanned(spark, d), ["CREDIT_CARD", "CA_SIN"])
    return lane.select("id", "removed", "split_entity", F.array_join("related", ",").alias("related"))


def model_checks(spark, d):
    rows = scan.scan_archive(_msgs(spark, d).select("id", "channel", "author", "at", "text")).withColumn("trigger", F.when(F.col("channel") == "view", "never").otherwise("on_uncertain"))
    return decide.model_plan(rows).select("id", "ask_single", "ask_window", "ask_encoded")


def model_decisions(spark, d):
    rows = scan.scan_archive(_msgs(spark, d).select("id", "event_id", "channel", "author", "at", "text")).withColumn("trigger", F.lit("always"))
    planned = sources.kept(decide.model_plan(rows), "planned")  # read for the replies and for the decisions
    body = F.concat(F.lit('{"findings":[{"entity":"EMAIL","text":"'), F.left("text", F.lit(3)), F.lit('","subject":"third_party","confidence":0.9}]}'))
    replies = planned.filter("ask_single and event_id % 3 = 0").select("id", F.lit("single").alias("kind"), body.alias("body"), F.lit("m1").alias("model"), F.create_map(F.lit("total_tokens"), F.lit(9)).alias("usage"))
    done = decide.final_decision(decide.attach_model_responses(planned, replies), P.DEFAULT_POLICY)
    return done.select("id", "action", F.coalesce("rule_id", F.lit("")).alias("rule_id"), "model_errors")


def folded_texts(spark, d):
    return _msgs(spark, d).select("id", detect.normalize_text(F.col("text")).alias("folded"))


def _synth(spark, d) -> DataFrame:
    return synth.synth_messages(detect.spread(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("n"))))


def synth_labels(spark, d):
    return _synth(spark, d)


def precision(spark, d):
    rows = _synth(spark, d).select(F.col("ts").alias("id"), F.lit("c").alias("channel"), "text", "entity", "subject")
    found = detect.scan_messages(rows)
    sets = found.select("id", F.transform(F.filter("findings", lambda f: f["subject"] != "self"), lambda f: f["entity"]).alias("entities"))
    return R.precision_recall(sets, rows.select("id", F.when(F.coalesce("subject", F.lit("")) != "self", F.col("entity")).alias("entity")))


def _streamed(spark, d, build, mode: str, schema=None) -> DataFrame:
    """Run a stream over the events table to its end; the result table lies in the shared folder."""
    place = f"{shared_folder(spark)}/chatguard/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{d}/events.parquet")
    source = spark.readStream.schema(table.schema).parquet(f"{d}/events.parque[t]")  # a glob, so that a single file may stand there
    out = build(source)
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={n}")
    query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out").select(*out.columns)


def stream_rollup(spark, d):
    def build(events):
        a = events.select((F.lit(float(V.BASE)) + F.col("event_id")).alias("t"), F.col("event_type").alias("channel"), F.when(F.col("event_id") % 11 == 0, "mask").otherwise("allow").alias("action"), F.when(F.col("event_id") % 4 == 0, "m").alias("model"))
        return streaming.stream_audit_rollup(a)

    rows = _streamed(spark, d, build, "complete")
    return rows.select(F.unix_timestamp("window.start").alias("window_start"), "channel", "action", "n", "model_calls")


def stream_once(spark, d):
    def build(events):
        raw = events.select(F.lit("message").alias("type"), F.col("event_type").alias("channel"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), (F.lit(V.BASE) + F.col("event_id") - F.col("event_id") % 5 % 2).cast("string").alias("ts"), F.lit("hi").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("subtype", "bot_id", "thread_ts")], F.lit(None).cast("struct<ts:string>").alias("edited"), F.lit(None).cast("struct<user:string,ts:string,text:string,subtype:string,bot_id:string,thread_ts:string,edited:struct<ts:string>>").alias("message"))
        return streaming.stream_intake(raw).select("event_key", "channel")

    return _streamed(spark, d, build, "append")


def _with_beat(spark, d, events: DataFrame) -> DataFrame:
    """events with beat: the newest row comes twice, the second time as the mark that lets the watermark pass all others."""
    newest = spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0]
    return events.withColumn("beat", F.explode(F.when(F.col("event_id") == newest, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))


def stream_lane(spark, d):
    """The lane with state over messages of the events table; texts are made per row, so the stream needs no window."""
    def build(events):
        n, half = F.col("event_id"), F.col("event_id") % 4
        card = D.luhn_complete(F.concat(F.lit("4"), F.lpad((F.floor(n / 4) * 7919 % 100000000000).cast("string"), 11, "0"), F.lit("731")))
        text = F.when(half == 0, F.left(card, F.lit(8))).when(half == 1, F.substr(card, F.lit(9))).when(half == 2, "that is all").otherwise("see you")
        later, rows = F.when(F.col("beat"), 86400.0).otherwise(0.0), _with_beat(spark, d, events)
        rows = rows.select(F.when(~F.col("beat"), F.concat(F.lit("e."), n.cast("string"))).alias("id"), F.concat(F.lit("c"), (n % 12 / 4).cast("int").cast("string")).alias("channel"), F.concat(F.lit("u"), (n % 20 / 4).cast("int").cast("string")).alias("author"), (F.lit(float(V.BASE)) + n * 3 + later).alias("at"), text.alias("text"))
        rows = detect.scan_messages(rows).withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", "10 minutes")
        acted = P.decision(F.col("findings"), F.col("channel"), F.lit(False), P.DEFAULT_POLICY)["action"]
        return streaming.stream_rules_lane(rows.withColumn("removes", acted.isin(schemas.REMOVING)), ["CREDIT_CARD", "CA_SIN"])

    return _streamed(spark, d, build, "append").select("id", "removed", "split_entity", F.array_join("related", ",").alias("related"))


def stream_last(spark, d):
    def build(events):
        return streaming.stream_cursors(events.select(F.col("event_type").alias("channel"), (F.lit(V.BASE) + F.col("event_id") * 3).cast("string").alias("ts")))

    rows = _streamed(spark, d, build, "update")
    return E.channel_cursors(rows.withColumnRenamed("last_ts", "ts"))


def stream_routes(spark, d):
    """Removed messages and messages for the model in two tables, written batch by batch; counts by channel of both."""
    place = f"{shared_folder(spark)}/chatguard/routes-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    rows = events.select(F.concat(F.lit("e."), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("channel"), E.removed_flag(F.when(F.col("event_id") % 11 == 0, "mask").when(F.col("event_id") % 13 == 0, "warn")).alias("removed"))
    streaming.route_lanes(rows, f"{place}/removed", f"{place}/open").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    tables = [spark.read.schema("id string, channel string, removed boolean").parquet(f"{place}/{t}").withColumn("lane", F.lit(t)) for t in ("removed", "open")]
    return tables[0].unionByName(tables[1]).groupBy("lane", "channel").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def stream_restored(spark, d):
    """The earliest restore request of each ticket within its time; every ticket is asked for twice, the later one first."""
    place = f"{shared_folder(spark)}/chatguard/restores-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{d}/events.parquet")
    events = lambda: spark.readStream.schema(table.schema).parquet(f"{d}/events.parque[t]")
    n = F.col("event_id")
    tickets = events().select(n.cast("string").alias("id"), F.timestamp_seconds(F.lit(V.BASE) + n).alias("created"))
    beat = F.when(F.col("beat"), 864000).otherwise(0)
    asked = _with_beat(spark, d, events()).filter("user_id % 4 = 0 or beat").withColumn("again", F.explode(F.array(F.lit(40), F.lit(0))))
    asked = asked.select(F.when(~F.col("beat"), n.cast("string")).alias("ticket_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.when(F.col("again") > 0, "b").otherwise("")).alias("actor_id"), F.timestamp_seconds(F.lit(V.BASE) + n + n * 37 % 1800 + F.col("again") + beat).alias("asked"))
    out = streaming.stream_restores(tickets, asked, late="2 hours")
    out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out").select("ticket_id", "actor_id", F.unix_timestamp("asked").alias("asked_at"), "created_at")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        card_counts, digit_checks, text_checks, masked_fingerprints, plain_texts, intake, cursors, missed, seeds, named_messages, restores, chains, sessions,
        rule_join, rule_decisions, triggers, rule_checks, located, rebuilt, usage, removals, outgoing, notices, releases, audit_lines, routing, top_counts, latency,
        job_lanes, dead_jobs, health, claims, retries, pruned, coverage, model_ranking, archive_scan, document_scan, conversation_scan, rules_lane, model_checks,
        model_decisions, folded_texts, synth_labels, precision, stream_rollup, stream_once, stream_lane, stream_last, digit_chains, custom_rules, disguises, splits, codebooks,
        case_rows, golden_cases, audit_files, event_files, labelled_files, report_file, label_split, stream_routes, stream_restored,
    )
}

_luhn = S.luhn


def _roll(salt: int, below: int) -> str:
    return f"(((n * 7919 + 104729 + {salt * 611953}) * 48271 % 2147483647) % {below})"


def _pad(salt: int, below: int, width: int) -> str:
    return f"lpad(CAST({_roll(salt, below)} AS VARCHAR), {width}, '0')"


def _pick(salt: int, items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + f"][{_roll(salt, len(items))} + 1]"


def _kind_case(what: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {_pick(14, [x[what] for x in forms])}" for k, forms in synth.LEADS.items()) + " END"


_GROUPED = "concat(substr(card, 1, 4), {0}, substr(card, 5, 4), {0}, substr(card, 9, 4), {0}, substr(card, 13))"
_SYNTH = f"""g AS (SELECT CAST(event_id AS BIGINT) AS n FROM events),
    k AS (SELECT n, CASE {" ".join(f"WHEN {_roll(1, 100)} < {sum(w for _, w in synth.KINDS[: i + 1])} THEN '{name}'" for i, (name, _) in enumerate(synth.KINDS))} END AS kind,
        concat('4', {_pad(2, 10000000, 7)}, {_pad(3, 10000000, 7)}) AS cb, concat(CAST({_roll(4, 7)} + 1 AS VARCHAR), {_pad(5, 10000000, 7)}) AS sb FROM g),
    d AS (SELECT *, {V._doubled('cb')}, {V._doubled('sb')} FROM k),
    c AS (SELECT *, concat(cb, {V._check_digit('cb', 15)}) AS card, concat(sb, {V._check_digit('sb', 8)}) AS sin FROM d),
    v AS (SELECT *, CASE kind WHEN 'card' THEN [{_GROUPED.format("' '")}, {_GROUPED.format("'-'")}, card][{_roll(12, 3)} + 1] WHEN 'sin' THEN concat(substr(sin, 1, 3), ' ', substr(sin, 4, 3), ' ', substr(sin, 7))
        WHEN 'key' THEN concat('AKIA', {_pad(9, 100000000, 8)}, {_pad(10, 100000000, 8)}) WHEN 'phone' THEN concat('416-555-', {_pad(8, 10000, 4)}) WHEN 'address' THEN concat({_roll(6, 900)} + 1, ' ', {_pick(7, ['Elm', 'Lake', 'Mill'])}, ' Road, Northfield')
        WHEN 'own_email' THEN concat('user', {_roll(11, 5000)}, '@mail.example') ELSE CASE WHEN {_roll(13, 2)} = 0 THEN concat(left(card, 15), CAST((CAST(right(card, 1) AS INT) + 1) % 10 AS VARCHAR)) ELSE '' END END AS value FROM c),
    s AS (SELECT *, CASE WHEN value = '' THEN {_pick(17, synth.PROSE)} ELSE {_kind_case(0)} END AS lead, CASE WHEN value = '' THEN '' ELSE {_kind_case(1)} END AS tail,
        CASE kind {" ".join(f"WHEN '{k}' THEN '{e}'" for k, e in synth.ENTITY.items())} END AS entity FROM v)"""


def _hex(pad: int) -> str:
    key = KEY.encode().ljust(64, b"\0")
    return bytes(b ^ pad for b in key).hex()


_HMAC = f"left(sha256(unhex('{_hex(0x5C)}') || unhex(sha256(unhex('{_hex(0x36)}') || encode(text)))), 16)"
_M, _A, _J = f"m AS ({V.MSGS_EVENTS})", f"a AS ({V.AUDIT_EVENTS})", f"j AS ({V.JOBS_EVENTS})"
_RAW = """raw AS (SELECT *, concat(CAST(CAST(sent_at AS BIGINT) AS VARCHAR), '.000100') AS ts FROM m WHERE event_id % 30 <> 0),
    stored AS (SELECT *, concat(channel, '.', ts) AS event_key FROM raw)"""
_ACTED = "acted AS (SELECT *, CAST(substr(id, 3) AS BIGINT) AS n, concat('m-', channel, '-', substr(id, 3)) AS text FROM a)"

ORACLE_SQL: dict[str, str] = {
    "card_counts": f"""
        WITH d AS ({V.MSGS_DOCS}),
        r AS (SELECT channel, list_transform(regexp_extract_all(text, '\\b((?:[0-9][ -]?){{13,19}})\\b', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS runs FROM d)
        SELECT channel, count(*) AS messages, CAST(sum(len(runs)) AS BIGINT) AS runs,
               CAST(sum(len(list_filter(runs, lambda x: len(x) BETWEEN 13 AND 19 AND x[1] IN ('3', '4', '5', '6') AND {_luhn('x')}))) AS BIGINT) AS cards
        FROM r GROUP BY channel""",
    "digit_checks": f"""
        WITH {_M}, k AS (SELECT *, substr(card, 5, 9) AS s, concat(left(card, 15), CAST((CAST(right(card, 1) AS INT) + 1) % 10 AS VARCHAR)) AS b FROM m)
        SELECT id, {_luhn('card')} AS luhn, left(card, 1) IN ('3', '4', '5', '6') AND {_luhn('card')} AS card_ok, left(sin, 1) NOT IN ('0', '8') AND {_luhn('sin')} AS sin_ok,
               left(s, 3) NOT IN ('000', '666') AND left(s, 1) <> '9' AS ssn_ok, card AS completed, {_luhn('b')} AS broken,
               concat(substr(card, 1, 4), ' ', substr(card, 5, 6), ' ', substr(card, 11, 5), ' ', substr(card, 16)) AS grouped FROM k""",
    "text_checks": f"""
        WITH {_M}, c AS (SELECT id, text, x, count(*) AS n FROM (SELECT id, text, unnest(string_split(text, '')) AS x FROM m) GROUP BY ALL),
        h AS (SELECT id, text, round(abs(sum(n / length(text) * log2(n / length(text)))), 6) AS entropy FROM c GROUP BY id, text)
        SELECT id, entropy, regexp_matches(text, '(?i)\\b(card|cc|visa|master ?card|amex|credit|debit|digits|number|num|exp|cvv|cvc|payment)\\b') AS card_word,
               regexp_matches(text, '(?i)\\b(sin|social insurance|t4|payroll|digits|number)\\b') AS sin_word,
               regexp_matches(text, '^(AKIA|ghp_|xoxb-|xoxp-|xoxa-|AIza)') OR (length(text) >= 20 AND entropy > 3.5) AS secret,
               {"".join("replace(" for _ in range(10))}text{"".join(f", ':{w}:', '{k}')" for k, w in enumerate("zero one two three four five six seven eight nine".split()))} AS unshort FROM h""",
    "masked_fingerprints": f"""
        WITH {_M}, p AS (SELECT *, CAST(least(rn % 7 + 5, length(text)) AS INT) AS e, CAST(least(rn % 7, least(rn % 7 + 5, length(text))) AS INT) AS s FROM m)
        SELECT id, concat(left(text, s), repeat('*', e - s), substr(text, e + 1)) AS masked, {_HMAC} AS text_hmac FROM p""",
    "plain_texts": f"WITH {_M} SELECT id, concat('<', id, '> mail https://x.y/', event_id, ' U7 ', text, ' R&D') AS plain FROM m",
    "intake": f"""
        WITH {_M}, {_RAW}
        SELECT event_key, author, CAST(ts AS DOUBLE) AS "at", text FROM stored
        UNION ALL SELECT concat(event_key, '.e', CAST(CAST(sent_at AS BIGINT) + 60 AS VARCHAR), '.000200'), author, CAST(concat(CAST(CAST(sent_at AS BIGINT) + 60 AS VARCHAR), '.000200') AS DOUBLE), concat(text, ' (edited)') FROM stored WHERE event_id % 20 = 0""",
    "cursors": f"WITH {_M}, {_RAW} SELECT channel, arg_max(ts, CAST(ts AS DECIMAL(20, 6))) AS last_ts FROM stored GROUP BY channel",
    "missed": f"""
        WITH {_M}, {_RAW}, c AS (SELECT channel, max(CAST(ts AS DECIMAL(20, 6))) AS last FROM stored WHERE CAST(ts AS DOUBLE) < {V.BASE + 2000} GROUP BY channel)
        SELECT channel, ts, event_key FROM stored JOIN c USING (channel) WHERE CAST(ts AS DECIMAL(20, 6)) > last AND event_key NOT IN (SELECT event_key FROM stored WHERE event_id % 2 = 0)""",
    "seeds": f"""
        WITH {_M}, {_RAW}, c AS (SELECT channel, max(CAST(ts AS DOUBLE)) AS last FROM stored WHERE CAST(ts AS DOUBLE) < {V.BASE + 2000} GROUP BY channel)
        SELECT channel, ts, event_key FROM stored JOIN c USING (channel) WHERE CAST(ts AS DOUBLE) <= last AND CAST(ts AS DOUBLE) >= least(last, {V.BASE + 1990 - 180})""",
    "named_messages": f"""
        WITH {_M}, mem AS (SELECT event_type AS channel, unnest(list_sort(list(DISTINCT user_id))[1:50]) AS u FROM events GROUP BY event_type),
        g AS (SELECT channel, bool_or(u % 37 = 0) AS guests FROM mem GROUP BY channel), us AS (SELECT DISTINCT user_id FROM events)
        SELECT id, CASE WHEN m.channel <> 'click' THEN concat('c-', m.channel) ELSE '' END AS channel_name, coalesce(guests, false) AS guests,
               CASE WHEN user_id IS NULL THEN 'someone' WHEN user_id % 2 = 0 THEN concat('nick', user_id) WHEN user_id % 3 = 0 THEN 'someone' ELSE concat('Person ', user_id) END AS display_name
        FROM m LEFT JOIN g USING (channel) LEFT JOIN us ON m.author = concat('u', user_id)""",
    "restores": f"""
        WITH q AS (SELECT event_id - event_id % 3 AS tid, concat('u', user_id) AS actor_id, CAST({V.BASE} + event_id + (event_id * 37) % 1800 AS DOUBLE) AS "at" FROM events WHERE user_id % 4 = 0),
        f AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY "at", actor_id) AS n FROM q)
        SELECT CAST(tid AS VARCHAR) AS ticket_id, actor_id, "at", "at" - ({V.BASE} + event_id) <= 900 AS restored FROM f JOIN events ON tid = event_id WHERE n = 1""",
    "chains": f"""
        WITH {_M}, w AS (SELECT id, sent_at, list({{'i': id, 'a': sent_at}}) OVER (PARTITION BY channel, author ORDER BY sent_at, id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS c FROM m)
        SELECT id, coalesce(array_to_string(list_transform(list_filter(c, lambda x: w.sent_at - x.a <= 180), lambda x: x.i), ','), '') AS chain FROM w""",
    "sessions": f"""
        WITH {_M}, g AS (SELECT id, channel, author, sent_at, CASE WHEN sent_at - lag(sent_at) OVER (PARTITION BY channel, author ORDER BY sent_at, id) > 180 THEN 1 ELSE 0 END AS s FROM m)
        SELECT id, CAST(sum(s) OVER (PARTITION BY channel, author ORDER BY sent_at, id) AS BIGINT) AS session FROM g""",
    "rule_join": f"""
        WITH {_A}, f AS (SELECT id, entity, channel, 0.7 + CAST(substr(id, 3) AS BIGINT) % 4 * 0.1 AS c, CAST(substr(id, 3) AS BIGINT) % 2 = 0 AS g FROM a WHERE entity IS NOT NULL),
        r AS (SELECT id, CASE WHEN entity = 'CREDIT_CARD' AND channel = 'click' AND c >= 0.85 THEN 0 WHEN entity = 'CREDIT_CARD' AND c >= 0.85 THEN 1 WHEN entity = 'CREDIT_CARD' AND c >= 0.75 THEN 2 WHEN entity = 'CA_SIN' AND g AND c >= 0.85 THEN 3 END AS o FROM f)
        SELECT id, 0 AS place, ['', 'card', 'card.low', 'sin'][o + 1] AS rule_id, ['warn', 'mask', 'log', 'block'][o + 1] AS action, o AS rule_order FROM r WHERE o IS NOT NULL""",
    "rule_decisions": f"""
        WITH {_A}, f AS (SELECT id, entity, channel, 0.7 + CAST(substr(id, 3) AS BIGINT) % 4 * 0.1 AS c, CAST(substr(id, 3) AS BIGINT) % 2 = 0 AS g FROM a WHERE entity IS NOT NULL),
        r AS (SELECT id, CASE WHEN entity = 'CREDIT_CARD' AND channel = 'click' AND c >= 0.85 THEN 0 WHEN entity = 'CREDIT_CARD' AND c >= 0.85 THEN 1 WHEN entity = 'CREDIT_CARD' AND c >= 0.75 THEN 2 WHEN entity = 'CA_SIN' AND g AND c >= 0.85 THEN 3 END AS o FROM f)
        SELECT id, coalesce(['warn', 'mask', 'log', 'block'][o + 1], 'allow') AS action, coalesce(['', 'card', 'card.low', 'sin'][o + 1], 'none') AS rule_id FROM r""",
    "triggers": f"WITH {_A} SELECT id, CASE channel WHEN 'click' THEN 'always' WHEN 'view' THEN 'never' ELSE 'on_uncertain' END AS trigger, channel = 'click' AND action NOT IN ('mask', 'block') AS held FROM a",
    "rule_checks": """
        WITH r AS (SELECT *, concat('r', event_id - CASE WHEN event_id % 50 = 1 THEN 1 ELSE 0 END) AS id FROM events),
        c AS (SELECT concat(CASE WHEN event_id % 60 = 7 THEN '' ELSE '#' END, 'c', event_id) AS name, event_id FROM events)
        SELECT 'rule' AS kind, id AS place, 'unknown entity' AS problem FROM r WHERE event_id % 41 = 0
        UNION ALL SELECT 'rule', id, 'unknown action' FROM r WHERE event_id % 43 = 0
        UNION ALL SELECT 'rule', id, 'unknown subject' FROM r WHERE event_id % 47 = 0
        UNION ALL SELECT 'rule', id, 'confidence outside 0 to 1' FROM r WHERE event_id % 53 = 0
        UNION ALL SELECT 'rule', id, 'duplicate id' FROM r GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'channel', name, 'name without #' FROM c WHERE event_id % 60 = 7
        UNION ALL SELECT 'channel', name, 'unknown trigger' FROM c WHERE event_id % 180 = 9""",
    "located": f"WITH {_M} SELECT id, 1 AS found, CAST(strpos(text, substr(text, 3, 4)) - 1 AS INT) AS first_start, CAST(strpos(text, substr(text, 3, 4)) - 1 + length(substr(text, 3, 4)) AS INT) AS first_end FROM m",
    "rebuilt": f"""
        WITH {_M}, v AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN card ELSE concat(substr(card, 9), left(card, 8)) END AS value FROM m)
        SELECT id, CASE WHEN event_id % 5 <> 0 AND left(value, 1) IN ('3', '4', '5', '6') AND {_luhn('value')} THEN 1 ELSE 0 END AS hits FROM v""",
    "usage": f"WITH {_A} SELECT id, coalesce(model, 's') AS model, CASE WHEN model IS NULL THEN 2 ELSE 5 END AS prompt_tokens, coalesce(total_tokens, 0) * CASE WHEN model IS NULL THEN 1 ELSE 2 END AS total_tokens FROM a",
    "removals": f"""
        WITH {_A}, {_ACTED}, r AS (SELECT * FROM acted WHERE action IN ('mask', 'block'))
        SELECT DISTINCT channel, id FROM (SELECT channel, id FROM r UNION ALL SELECT channel, concat('e.', n - n % 5) FROM r WHERE n % 22 = 0)""",
    "outgoing": f"""
        WITH {_A}, {_ACTED}
        SELECT id, CASE WHEN n % 22 = 0 THEN 'split' WHEN n % 33 = 0 THEN 'hidden' WHEN n % 2 = 0 THEN concat(left(text, 2), '██', substr(text, 5))
                   ELSE concat(left(text, 2), '██', substr(text, 5, 1), repeat('█', CAST(least(length(text), 7) - 5 AS INT)), substr(text, 8)) END AS outgoing FROM acted WHERE action = 'mask'""",
    "notices": f"WITH {_A}, {_ACTED} SELECT id, author, action, CASE WHEN n % 22 = 0 THEN 2 ELSE 1 END AS messages, 'x by policy' AS message, CASE WHEN entity IS NULL THEN 'EMAIL, PHONE' ELSE concat(entity, ', EMAIL') END AS entities FROM acted WHERE action <> 'allow'",
    "releases": f"WITH {_A}, {_ACTED} SELECT id, channel, text, CASE WHEN n % 4 = 1 AND n <> 7 THEN '7' END AS thread FROM acted WHERE n % 6 = 0 AND action NOT IN ('mask', 'block')",
    "audit_lines": f"WITH {_A}, {_ACTED} SELECT t, id, channel, author, {_HMAC} AS text_hmac, action, 'r' AS rule, concat(coalesce(entity, 'PHONE'), ',EMAIL') AS entities, 0 AS tier, CASE WHEN n % 22 = 0 THEN 2 ELSE 0 END AS related FROM acted",
    "routing": f"""
        WITH {_A}, s AS (SELECT count(*) AS total, count(model) AS model_calls, count(*) - count(model) AS zero_token, count(*) FILTER (WHERE model IS NULL AND action IN ('mask', 'block')) AS removed_by_rules,
            CAST(coalesce(sum(total_tokens) FILTER (WHERE model IS NOT NULL), 0) AS BIGINT) AS tokens, coalesce(sum(total_tokens / 1000.0) FILTER (WHERE model IS NOT NULL), 0) AS cost_usd,
            count(*) FILTER (WHERE model IS NOT NULL AND coalesce(total_tokens, 0) = 0) AS unknown_usage FROM a)
        SELECT *, zero_token / total AS zero_token_share, zero_token * 800 AS avoided_tokens, zero_token * 800 * 0.15 / 1000000 AS avoided_usd, zero_token * 800 * 0.2 / 1000 AS avoided_grams FROM s""",
    "top_counts": f"""
        WITH {_A}, l AS (SELECT 'action' AS dimension, action AS label FROM a UNION ALL SELECT 'channel', channel FROM a UNION ALL SELECT 'model', model FROM a WHERE model IS NOT NULL UNION ALL SELECT 'entity', entity FROM a WHERE entity IS NOT NULL),
        c AS (SELECT dimension, label, count(*) AS n FROM l GROUP BY ALL)
        SELECT dimension, label, n, n / sum(n) OVER (PARTITION BY dimension) AS share FROM c QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY n DESC, label) <= 8""",
    "latency": f"WITH {_A}, s AS (SELECT list_sort(list(ms)) AS v FROM a) SELECT v[CAST(floor(len(v) / 2) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95 FROM s",
    "job_lanes": f"WITH {_J} SELECT topic, status, count(*) AS n FROM j GROUP BY ALL",
    "dead_jobs": f"WITH {_J} SELECT id, dedupe, error FROM j WHERE status = 'dead' ORDER BY id DESC LIMIT 20",
    "health": f"WITH {_J} SELECT count(*) FILTER (WHERE status = 'dead') AS dead, count(*) FILTER (WHERE status = 'queued') AS queued, CASE WHEN count(*) FILTER (WHERE status = 'dead') >= 50 THEN 'degraded' ELSE 'ok' END AS state FROM j",
    "claims": f"WITH {_J}, q AS (SELECT *, row_number() OVER (PARTITION BY topic, lane ORDER BY id) AS n FROM j WHERE status = 'queued') SELECT id, topic, lane FROM q WHERE n = 1 AND available_at <= {V.BASE + 200}",
    "retries": f"WITH {_J} SELECT id, CASE WHEN attempts >= 5 THEN 'dead' ELSE 'queued' END AS status, CASE WHEN attempts >= 5 THEN available_at ELSE {NOW} + least(30, pow(2, attempts)) END AS available_at, left(error, 500) AS error FROM j WHERE status <> 'done'",
    "pruned": f"WITH {_J} SELECT id, status FROM j WHERE NOT (status = 'done' AND finished_at < {NOW - 3000})",
    "coverage": f"""
        WITH {_A}, o AS (SELECT channel AS category, (CASE WHEN action IN ('mask', 'block') THEN 'removed' ELSE action END) = (CASE WHEN n % 11 = 0 THEN 'removed' ELSE 'allow' END) AS good, n % 26 = 0 AS gap FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS n FROM a))
        SELECT category, count(*) FILTER (WHERE good AND NOT gap) AS passed, count(*) FILTER (WHERE NOT good AND NOT gap) AS failed, count(*) FILTER (WHERE NOT good AND gap) AS known_gap, count(*) FILTER (WHERE good AND gap) AS fixed_gap FROM o GROUP BY category""",
    "model_ranking": f"""
        WITH {_A}, s AS (SELECT *, CASE WHEN ms < 25 THEN entity END AS said FROM a WHERE model IS NOT NULL)
        SELECT model, CAST(sum(CASE WHEN entity IS NOT DISTINCT FROM said THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS cases, quantile_cont(ms, 0.5) AS median_ms, max(ms) AS max_ms FROM s GROUP BY model""",
    "synth_labels": f"""
        WITH {_SYNTH} SELECT n, CAST(1725000000 + n AS VARCHAR) AS ts, concat('u', {_roll(15, 40)}) AS user, {_pick(16, synth.CHANNELS)} AS channel,
               concat(lead, value, tail) AS text, kind, entity, CASE WHEN kind <> 'clean' THEN CAST(length(lead) AS INT) END AS start, CASE WHEN kind <> 'clean' THEN CAST(length(lead) + length(value) AS INT) END AS "end",
               CASE WHEN kind = 'own_email' THEN 'self' WHEN kind <> 'clean' THEN 'third_party' END AS subject FROM s""",
    # The rules know three of the labelled kinds; telephone numbers and addresses of others are missed, own addresses do not count.
    "precision": f"""
        WITH {_SYNTH}, r AS (SELECT entity, kind IN ('card', 'sin', 'key') AS known FROM s WHERE kind NOT IN ('clean', 'own_email'))
        SELECT entity, CAST(sum(CAST(known AS INT)) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(sum(CAST(NOT known AS INT)) AS BIGINT) AS fn, CASE WHEN bool_and(known) THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN bool_and(known) THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM r GROUP BY entity""",
    "label_split": f"WITH {_SYNTH} SELECT CASE WHEN n < (SELECT max(event_id) + 1 - 100 FROM events) THEN 'train' ELSE 'held' END AS part, kind, count(*) AS n FROM s GROUP BY ALL",
    "stream_rollup": f"""
        SELECT CAST(floor(({V.BASE} + event_id) / 3600) * 3600 AS BIGINT) AS window_start, event_type AS channel, CASE WHEN event_id % 11 = 0 THEN 'mask' ELSE 'allow' END AS action, count(*) AS n,
               CAST(sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS model_calls FROM events GROUP BY ALL""",
    "stream_once": f"SELECT DISTINCT concat(event_type, '.', {V.BASE} + event_id - event_id % 5 % 2) AS event_key, event_type AS channel FROM events",
    "stream_last": f"SELECT event_type AS channel, CAST(max({V.BASE} + event_id * 3) AS VARCHAR) AS last_ts FROM events GROUP BY event_type",
    "conversation_scan": f"WITH c AS ({V.MSGS_CONV_CARDS}) SELECT author, count(*) AS messages, count(*) FILTER (WHERE n % 3 = 0) AS cards, count(*) FILTER (WHERE n % 3 = 2) AS shapes FROM c GROUP BY author",
    "custom_rules": f"""
        WITH {_M}, e AS (SELECT id, CASE rn % 16 WHEN 0 THEN 'CREDIT_CARD' WHEN 2 THEN 'CARD_LIKE' WHEN 3 THEN 'CREDIT_CARD' WHEN 4 THEN 'CA_SIN' WHEN 6 THEN 'US_SSN' WHEN 7 THEN 'API_KEY' WHEN 8 THEN 'IBAN' WHEN 9 THEN 'CREDIT_CARD' WHEN 14 THEN 'ORDER' WHEN 15 THEN 'PHONE' END AS one FROM m)
        SELECT id, coalesce(one, '') AS entities, CASE one WHEN 'CREDIT_CARD' THEN CASE WHEN rn % 16 = 0 THEN 0.97 ELSE 0.9 END WHEN 'CARD_LIKE' THEN 0.75 WHEN 'CA_SIN' THEN 0.9 WHEN 'US_SSN' THEN 0.95 WHEN 'API_KEY' THEN 0.99 WHEN 'IBAN' THEN 0.85 WHEN 'ORDER' THEN 0.8 WHEN 'PHONE' THEN 0.9 END::DOUBLE AS confidence FROM e JOIN m USING (id)""",
    "codebooks": f"WITH {_M} SELECT id, CASE WHEN event_id % 3 <> 0 THEN 'CREDIT_CARD' END AS entity, CASE WHEN event_id % 3 <> 0 THEN 0.85 END::DOUBLE AS confidence FROM m",
    "case_rows": f"""
        WITH c AS (SELECT *, unnest(CASE WHEN event_id % 3 = 0 THEN [0] ELSE [0, 1] END) AS place FROM events)
        SELECT concat('C', event_id, '.', place) AS id, concat('C', event_id) AS case_id, place, CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'eng' END AS channel, CASE WHEN event_id % 5 = 0 THEN concat('U', place) ELSE 'U1' END AS author,
               CAST({V.BASE} + place AS DOUBLE) AS "at", CASE WHEN event_id % 3 = 0 THEN concat('only ', event_id) WHEN place = 0 THEN 'first' ELSE concat('then ', event_id) END AS text FROM c""",
    "golden_cases": f"""
        WITH g AS (SELECT unnest({golden.sql_rows()}) AS r)
        SELECT concat('G', event_id) AS id, r.category, r.expect, r.got, CASE WHEN r.got = r.expect AND r.gap THEN 'fixed gap' WHEN r.got = r.expect THEN 'pass' WHEN r.gap THEN 'known gap' ELSE 'fail' END AS status
        FROM events JOIN g ON event_id % {len(golden.CASES)} = r.n""",
    "audit_files": f"WITH {_A}, {_ACTED} SELECT action, count(*) AS lines, CAST(2 * count(*) AS BIGINT) AS entities, CAST(sum(CASE WHEN n % 22 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS related, count(DISTINCT text) AS texts FROM acted GROUP BY action",
    "event_files": f"WITH {_M}, {_RAW} SELECT event_key AS id, event_key, author, CAST(ts AS DOUBLE) AS \"at\", text FROM stored",
    "labelled_files": f"""
        WITH {_SYNTH} SELECT {_pick(16, synth.CHANNELS)} AS channel, coalesce(entity, 'none') AS entity, CASE WHEN kind = 'own_email' THEN 'self' WHEN kind <> 'clean' THEN 'third_party' ELSE 'none' END AS subject,
               count(*) AS n, CAST(sum(CASE WHEN kind <> 'clean' THEN length(value) ELSE 0 END) AS BIGINT) AS chars FROM s GROUP BY ALL""",
    "stream_routes": "SELECT CASE WHEN event_id % 11 = 0 THEN 'removed' ELSE 'open' END AS lane, event_type AS channel, count(*) AS n, count(*) AS ids FROM events GROUP BY ALL",
    "stream_lane": """
        SELECT concat('e.', e.event_id) AS id, h.event_id IS NOT NULL AS removed, CASE WHEN h.event_id IS NOT NULL THEN 'CREDIT_CARD' END AS split_entity,
               CASE WHEN h.event_id IS NOT NULL THEN concat('e.', h.event_id, ',e.', e.event_id) ELSE '' END AS related
        FROM events e LEFT JOIN events h ON e.event_id % 4 = 1 AND h.event_id = e.event_id - 1""",
    "stream_restored": f"SELECT CAST(event_id AS VARCHAR) AS ticket_id, concat('u', user_id) AS actor_id, {V.BASE} + event_id + event_id * 37 % 1800 AS asked_at, {V.BASE} + event_id AS created_at FROM events WHERE user_id % 4 = 0 AND event_id * 37 % 1800 <= 900",
    **S.SQL,
}
ORACLE_SQL["report_file"] = ORACLE_SQL["routing"]
