"""Decisions of the scan and of model responses against plain loops."""

import json

import plain
import pytest
from compare import DATA
from pyspark.sql import functions as F

from chatguard import queries as Q
from chatguard.operators import decide, policy as P
from chatguard.plans import scan

RANK = ["quarantine", "block", "mask", "warn", "log", "allow"]


def _decide(entities):
    best = ("allow", "")
    for entity, confidence in entities:
        for rule in P.DEFAULT_POLICY["rules"]:
            if rule["entity"] == entity and "subject" not in rule and confidence >= rule.get("min_confidence", 0.85):
                if RANK.index(rule["action"]) < RANK.index(best[0]):
                    best = (rule["action"], rule["id"])
                break
    return best


CONFIDENCE = {"CREDIT_CARD": 0.9, "CARD_LIKE": 0.75, "CA_SIN": 0.9, "US_SSN": 0.95, "API_KEY": 0.99, "IBAN": 0.85}


def _plain(rows):
    out, held = {}, {}
    for r in sorted(rows, key=lambda r: (r["channel"], r["author"], r["at"], r["id"])):
        mine = held.setdefault((r["channel"], r["author"]), [])
        chain = [m for m in mine[-6:] if r["at"] - m["at"] <= 180]
        texts = [m["text"] for m in [*chain, r]]
        action, rule, ids = *_decide([(e, CONFIDENCE[e]) for e, _, _ in plain.find(r["text"])]), []
        if action not in ("mask", "block", "quarantine"):
            hit = plain.split(texts)
            if hit:
                action, rule = _decide([(hit[0], 0.9)])
                ids = [[*chain, r][i]["id"] for i in hit[1]]
        digits = [sum(b - a for a, b in plain.groups(plain.fold(t))) for t in texts]
        window = action == "allow" and digits[-1] > 0 and sum(n > 0 for n in digits) > 1 and sum(digits) >= 9
        out[r["id"]] = (action, rule, ",".join(ids), action == "allow", window, action == "allow" and plain.coded(r["text"]))
        mine.append(r)
    return out


def test_scan_equals_plain_loop(spark):
    rows = Q._msgs(spark, DATA).select("id", "channel", "author", "at", "text")
    want = _plain(rows.collect())
    decided = scan.scan_archive(rows).withColumn("trigger", F.lit("always"))
    planned = decide.model_plan(decided).select("id", "action", F.coalesce("rule_id", F.lit("")), F.array_join("related_ids", ","), "ask_single", "ask_window", "ask_encoded")
    assert {r[0]: tuple(r)[1:] for r in planned.collect()} == want


def test_documents_equal_plain_detection(spark):
    got = {}
    for r in Q.document_scan(spark, DATA).collect():
        got.setdefault(r["id"], []).append((r["place"], r["entity"], r["start"], r["end"]))
    want = {f"d.{r['doc_id']}": [(k, *x) for k, x in enumerate(plain.find(r["text"]))] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and got


def test_document_scan_runs_python_once(spark):
    plan = Q.document_scan(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.fixture()
def planned(spark):
    words = "aa bb cc dd ee ff gg hh ii jj".split()
    coded = " ".join(words[int(c)] for c in "4539578763621486")
    rows = [
        ("w1", "y", 0.0, "code 4539 5787"), ("w2", "y", 5.0, "rest 6362 1486"), ("e1", "z", 0.0, coded), ("s1", "x", 0.0, "mail bo@x.io please"), ("s2", "q", 0.0, "mail bo@x.io again"), ("s3", "r", 0.0, "nothing"), ("s4", "never", 0.0, "nothing"),
    ]
    frame = spark.createDataFrame([(i, "c", a, 1725000000.0 + t, x) for i, a, t, x in rows], "id string, channel string, author string, at double, text string")
    return decide.model_plan(scan.scan_archive(frame).withColumn("trigger", F.when(F.col("author") == "never", "never").otherwise("on_uncertain"))).persist()


def test_model_responses_decide(spark, planned):
    words = "aa bb cc dd ee ff gg hh ii jj".split()
    email = lambda subject, text="bo@x.io": json.dumps({"findings": [{"entity": "EMAIL", "text": text, "subject": subject, "confidence": 0.95}]})
    replies = [
        ("w2", "window", json.dumps({"reconstructed": [{"entity": "CREDIT_CARD", "value": "4539 5787 6362 1486", "message_numbers": [1, 0], "confidence": 0.9}]})),
        ("e1", "encoded", json.dumps({"tokens": [{"token": w, "digit": str(d)} for d, w in enumerate(words)]})),
        ("s1", "single", email("third_party")), ("s2", "single", email("self")), ("s3", "single", "{not json"), ("s4", "single", email("third_party", "nothing")),
    ]
    frame = spark.createDataFrame([(i, k, b, "m", {"total_tokens": 5, "prompt_tokens": 3}) for i, k, b in replies], "id string, kind string, body string, model string, usage map<string,int>")
    done = decide.final_decision(decide.attach_model_responses(planned, frame), P.DEFAULT_POLICY)
    got = {r["id"]: (r["action"], [f["entity"] for f in r["findings"]], r["model_errors"]) for r in done.collect()}
    assert got["w2"][0] == "mask" and got["w2"][1] == ["CREDIT_CARD"]
    assert got["e1"][0] == "mask" and got["e1"][1] == ["CREDIT_CARD"]
    assert got["s1"][:2] == ("mask", ["EMAIL"]) and got["s2"][:2] == ("allow", ["EMAIL"])
    assert got["s3"] == ("allow", [], 1) and got["s4"] == ("allow", [], 0)
    totals = {r["id"]: (r["model"], r["token_usage"]["total_tokens"]) for r in decide.usage_totals(frame).collect()}
    assert totals["w2"] == ("m", 5)


def test_false_reconstructions_are_dropped(spark, planned):
    bad = [
        {"entity": "CREDIT_CARD", "value": "4539578763621487", "message_numbers": [0, 1], "confidence": 0.9}, {"entity": "CREDIT_CARD", "value": "4111111111111111", "message_numbers": [0, 1], "confidence": 0.9},
        {"entity": "CREDIT_CARD", "value": "4539578763621486", "message_numbers": [0], "confidence": 0.9}, {"entity": "CREDIT_CARD", "value": "4539578763621486", "message_numbers": [0, 7], "confidence": 0.9},
    ]
    frame = spark.createDataFrame([("w2", "window", json.dumps({"reconstructed": bad}), "m", None)], "id string, kind string, body string, model string, usage map<string,int>")
    done = decide.final_decision(decide.attach_model_responses(planned, frame), P.DEFAULT_POLICY)
    assert {r["id"]: r["action"] for r in done.collect()}["w2"] == "allow"
