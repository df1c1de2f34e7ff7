"""From detections to decisions, actions and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatguard.functions import digits as D
from chatguard.operators import detect, policy as P, windows as W
from chatguard.schemas import FINDINGS, REMOVING, SINGLE, WINDOW


def with_parts(messages: DataFrame) -> DataFrame:
    """scanned messages with chain and with parts: what split detection needs of the chain and of the message itself."""
    chained = W.recent_chain(messages, ["folded", "groups", "disguised"])
    own = F.struct("folded", "groups", "disguised")
    return chained.withColumn("parts", F.concat(F.transform("chain", lambda m: F.struct(m["folded"], m["groups"], m["disguised"])), F.array(own)).cast(f"array<{detect.PART}>"))


def rules_decision(messages: DataFrame, policy: dict) -> DataFrame:
    """messages with action, rule_id, message, findings, related_ids and removes, from the rules alone.

    Each message by itself; if that does not remove it, a split over the author's recent messages. The stateless
    form: chains hold the last six messages whether removed or not (ordered_rules_lane replays removals).
    messages: id, channel, author, at, text, channel_name, guests.
    """
    scanned = detect.scan_messages(messages)
    decided = P.with_rules(with_parts(scanned), policy, name="__rules")
    decided = decided.withColumn("__d", P.decision(F.col("findings"), F.col("channel_name"), F.col("guests"), policy, F.col("__rules")))
    stays = ~F.col("__d.action").isin(REMOVING)
    hit = detect.detect_split(F.when(stays, F.col("parts")))
    decided = decided.withColumn("__hit", hit)
    finding = F.array(detect.split_as_finding(F.col("__hit"), F.col("text"))).cast(FINDINGS)
    split = P.decision(finding, F.col("channel_name"), F.col("guests"), policy, F.col("__rules"))
    decided = decided.withColumn("__s", F.when(F.col("__hit").isNotNull(), split))
    taken = F.col("__s.action").isNotNull()
    ids = F.concat(F.transform("chain", lambda m: m["id"]), F.array("id"))
    pick = lambda name: F.when(taken, F.col(f"__s.{name}")).otherwise(F.col(f"__d.{name}"))
    out = decided.withColumns({
        "action": pick("action"), "rule_id": pick("rule_id"), "message": pick("message"),
        "findings": F.when(taken, finding).otherwise(F.col("findings")),
        "related_ids": F.when(taken & (F.col("__s.action") != "allow"), F.transform("__hit.indexes", lambda i: F.get(ids, i))).otherwise(F.array().cast("array<string>")),
    })
    return out.withColumn("removes", F.col("action").isin(REMOVING)).drop("__d", "__s", "__hit", "__rules", "chain")


def model_plan(decided: DataFrame) -> DataFrame:
    """decided with ask_single, ask_window and ask_encoded: the model checks a message would need.

    None where the rules acted or the channel's trigger is never. decided: action, trigger, text, parts, groups, encoded.
    """
    open_ = (F.col("action") == "allow") & (F.col("trigger") != "never")
    before = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: p["groups"])
    return decided.withColumns({
        "ask_single": open_ & (F.trim("text") != ""),
        "ask_window": open_ & W.worth_window_check(before, F.col("groups")),
        "ask_encoded": open_ & F.col("encoded"),
    })


def attach_model_responses(messages: DataFrame, responses: DataFrame) -> DataFrame:
    """messages with columns single_reply, window_reply, encoded_reply (structs or null) from responses (id, kind, body, model, usage).

    body is the model's JSON. A missing or unreadable response leaves null; model_errors counts asked checks without one.
    """
    kinds = {"single": f"struct<findings:{SINGLE}>", "window": f"struct<reconstructed:{WINDOW}>", "encoded": "struct<tokens:array<struct<token:string,digit:string>>>"}
    read = responses.groupBy("id").agg(*[
        F.max_by(F.struct(F.when(F.col("kind") == k, F.from_json("body", schema)).alias("body"), "model", "usage"), F.when(F.col("kind") == k, F.lit(1))).alias(f"{k}_reply")
        for k, schema in kinds.items()
    ])
    out = messages.join(read, "id", "left")
    for k, field in (("single", "findings"), ("window", "reconstructed"), ("encoded", "tokens")):
        out = out.withColumn(f"{k}_reply", F.when(F.col(f"{k}_reply.body.{field}").isNotNull(), F.col(f"{k}_reply")))
    if {"ask_single", "ask_window", "ask_encoded"} <= set(messages.columns):
        out = out.withColumn("model_errors", sum((F.coalesce(F.col(f"ask_{k}") & F.col(f"{k}_reply").isNull(), F.lit(False)).cast("int") for k in kinds), F.lit(0)))
    return out


def locate_spans(text: Column, found: Column) -> Column:
    """Model findings with the span of their first exact occurrence; those that do not occur are dropped."""

    located = F.transform(found, lambda f: F.struct(f.alias("f"), (F.position(f["text"], text) - 1).alias("start")))
    kept = F.filter(located, lambda x: x["start"] >= 0)
    return F.transform(kept, lambda x: F.struct(
        x["f"]["entity"].alias("entity"), x["start"].alias("start"), (x["start"] + F.length(x["f"]["text"])).alias("end"), x["f"]["confidence"].alias("confidence"),
        x["f"]["subject"].alias("subject"), F.lit(1).alias("tier"), F.lit("").alias("note"),
    )).cast(FINDINGS)


def verify_reconstruction(item: Column, folded_texts: Column) -> Column:
    """Whether a rebuilt value only uses what the named messages hold and passes its kind's check."""
    numbers, n = item["message_numbers"], F.size(folded_texts)
    inside = (F.size(numbers) > 0) & F.forall(numbers, lambda i: (i >= 0) & (i < n))
    joined = F.array_join(F.transform(F.filter(numbers, lambda i: (i >= 0) & (i < n)), lambda i: F.get(folded_texts, i)), "")
    value, typed, wanted = item["value"], D.digits_only(joined), D.digits_only(item["value"])
    count = lambda text, d: F.length(text) - F.length(F.replace(text, F.lit(str(d)), F.lit("")))
    covered = F.lit(True)
    for d in range(10):
        covered = covered & (count(wanted, d) <= count(typed, d))
    packed = F.replace(joined, F.lit(" "), F.lit(""))
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    key = (F.length(value) >= 20) & F.forall(words, lambda w: F.contains(packed, w))
    entity = item["entity"]
    checked = F.when(entity == "API_KEY", key).when(entity == "CREDIT_CARD", covered & D.is_card(value)).when(entity == "CA_SIN", covered & D.is_sin(value)).when(entity == "US_SSN", covered & D.is_ssn(value))
    return F.coalesce(inside & checked, F.lit(False))


def window_hits(items: Column, folded_texts: Column) -> Column:
    """Verified items that hold the last message and another; numbers sorted and distinct. The first one decides."""
    last = F.size(folded_texts) - 1
    tidy = F.transform(items, lambda x: F.struct(x["entity"].alias("entity"), x["value"].alias("value"), F.array_sort(F.array_distinct(x["message_numbers"])).alias("message_numbers"), x["confidence"].alias("confidence")))
    return F.filter(tidy, lambda x: F.array_contains(x["message_numbers"], last) & (F.size(x["message_numbers"]) > 1) & verify_reconstruction(x, folded_texts))


def final_decision(planned: DataFrame, policy: dict) -> DataFrame:
    """Rules first; then, only while the action is allow, the window, encoded and single responses in that order.

    planned: output of model_plan and attach_model_responses. Adds model and token_usage of the responses.
    """
    decide = lambda f: P.decision(f, F.col("channel_name"), F.col("guests"), policy, F.col("__rules"))
    whole = lambda entity, confidence, note: F.array(F.struct(entity.alias("entity"), F.lit(0).alias("start"), F.length("text").alias("end"), confidence.alias("confidence"), F.lit("unknown").alias("subject"), F.lit(1).alias("tier"), note.alias("note"))).cast(FINDINGS)
    rebuilt = window_hits(F.coalesce("window_reply.body.reconstructed", F.array().cast(WINDOW)), F.transform("parts", lambda p: p["folded"]))
    out = P.with_rules(planned, policy, name="__rules").withColumn("__w", F.when(F.col("ask_window"), F.get(rebuilt, F.lit(0))))
    out = out.withColumn("__e", detect.read_codebook(F.when(F.col("ask_encoded"), F.col("text")), F.col("encoded_reply.body.tokens")))
    note = F.concat(F.lit("split across "), F.size("__w.message_numbers").cast("string"), F.lit(" messages"))
    steps = [
        (F.col("__w").isNotNull(), whole(F.col("__w.entity"), F.col("__w.confidence"), note)),
        (F.col("__e").isNotNull(), whole(F.col("__e.entity"), F.col("__e.confidence"), F.lit("obfuscated"))),
        (F.col("ask_single") & F.col("single_reply").isNotNull(), F.concat("findings", locate_spans(F.col("text"), F.coalesce("single_reply.body.findings", F.array().cast(SINGLE))))),
    ]
    for asked, findings in steps:
        use = F.coalesce(asked, F.lit(False)) & (F.col("action") == "allow")
        out = out.withColumn("__f", F.when(use, findings)).withColumn("__d", F.when(use, decide(F.col("__f"))))
        out = out.withColumns({"action": F.coalesce("__d.action", "action"), "rule_id": F.coalesce("__d.rule_id", "rule_id"), "message": F.coalesce("__d.message", "message"), "findings": F.coalesce("__f", "findings")}).drop("__f", "__d")
    return out.drop("__w", "__e", "__rules")


def usage_totals(responses: DataFrame) -> DataFrame:
    """(id, model, token_usage): summed usage of a message's responses; the model of window, else encoded, else single."""
    rank = F.when(F.col("kind") == "window", 0).when(F.col("kind") == "encoded", 1).otherwise(2)
    names = ["prompt_tokens", "completion_tokens", "total_tokens"]
    sums = [F.sum(F.coalesce(F.col("usage")[n], F.lit(0))).cast("int").alias(n) for n in names]
    out = responses.groupBy("id").agg(F.min_by("model", F.when(F.coalesce("model", F.lit("")) != "", rank)).alias("model"), *sums)
    return out.select("id", "model", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("token_usage"))


def removal_targets(decided: DataFrame) -> DataFrame:
    """(channel, id) of every message to remove, once: the parts of a split, else the message itself."""
    ids = F.when(F.size("related_ids") > 0, F.col("related_ids")).otherwise(F.array("id"))
    return decided.filter(F.col("action").isin(REMOVING)).select("channel", F.explode(ids).alias("id")).distinct()


def outgoing_text(decided: DataFrame, split_notice: str = "[removed: spread over several messages]", hidden_notice: str = "[removed: hidden value]") -> DataFrame:
    """decided with outgoing: what replaces a masked message, null for other actions. Spans about the author stay."""
    shown = F.filter("findings", lambda f: f["subject"] != "self")
    hidden = F.exists("findings", lambda f: f["note"] == "obfuscated")
    text = F.when(F.size("related_ids") > 0, F.lit(split_notice)).when(hidden, F.lit(hidden_notice)).otherwise(D.mask_text("text", shown))
    return decided.withColumn("outgoing", F.when(F.col("action") == "mask", text))


def author_notice(decided: DataFrame) -> DataFrame:
    """(id, author, action, messages, message, entities) for every message that is not simply allowed or logged."""
    entities = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["entity"]))), ", ")
    acted = decided.filter(~F.col("action").isin("allow", "log"))
    return acted.select("id", "author", "action", F.greatest(F.size("related_ids"), F.lit(1)).alias("messages"), "message", entities.alias("entities"))


def held_releases(decided: DataFrame) -> DataFrame:
    """(id, channel, text, thread): held messages that nothing removed go out again; a thread's own root is no thread."""
    thread = F.when(F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.element_at(F.split("id", r"\.", 2), 2)), F.col("thread_ts"))
    return decided.filter(F.col("held") & ~F.col("action").isin(REMOVING)).select("id", "channel", "text", thread.alias("thread"))


def audit_rows(decided: DataFrame, key: str) -> DataFrame:
    """Text-free audit lines: fingerprint, action, rule, entities in order, highest tier, number of related messages."""
    return decided.select(
        F.col("at").alias("t"), "id", "channel", "author", D.fingerprint("text", key).alias("text_hmac"), "action", F.coalesce("rule_id", F.lit("")).alias("rule"),
        F.transform("findings", lambda f: f["entity"]).alias("entities"), F.array_max(F.transform("findings", lambda f: f["tier"])).alias("tier"), F.size("related_ids").alias("related"),
    )
