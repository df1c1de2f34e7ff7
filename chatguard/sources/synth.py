"""Synthetic labelled messages in integer maths, so that any engine can rebuild them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatguard.functions import digits as D

CHANNELS = ["general", "support", "billing", "hiring", "eng", "random"]
# Kinds with their weights of 100.
KINDS = [("card", 8), ("sin", 6), ("key", 5), ("phone", 6), ("address", 5), ("own_email", 5), ("clean", 65)]
ENTITY = {"card": "CREDIT_CARD", "sin": "CA_SIN", "key": "API_KEY", "phone": "PHONE", "address": "ADDRESS", "own_email": "EMAIL"}
BASE = 1725000000
# What stands before and after the value, by kind; a clean message without a value has an empty one.
LEADS = {
    "card": [("please bill ", " again"), ("here you go: ", ""), ("refund goes to ", " as agreed")], "sin": [("the sin is ", " for payroll"), ("t4 for ", "")], "key": [("deploy with ", ""), ("rotate ", " today")],
    "phone": [("reach Robin at ", " after noon"), ("Robin answers ", "")], "address": [("Robin moved to ", ""), ("ship the parcel to ", " please")], "own_email": [("write me at ", ""), ("my own mail is ", " by the way")],
    "clean": [("parcel code ", " has arrived"), ("ticket ", " is closed")],
}
PROSE = ["see you at lunch", "who reviews this", "the meeting moved to 10:15", "tests are green again"]


def _draw(seed: int, salt: int, below: int) -> Column:
    """A number under `below` from the row's id: one step of a linear congruence, the same in every engine."""
    return ((F.col("n") * 7919 + seed * 104729 + salt * 611953) * 48271 % 2147483647) % below


def _first(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, as one CASE: nested ones double the plan with every kind."""
    out = F
    for test, value in cases:
        out = out.when(test, value)
    return out


def synth_messages(ids: DataFrame, seed: int = 1) -> DataFrame:
    """(n, ts, user, channel, text, kind, entity, start, end, subject): one labelled message for each n of ids.

    The kinds that the rules know hold a valid value at the span; telephone numbers, addresses and own e-mail
    addresses are labelled too, though no rule finds them. A clean message is prose or holds a card number that
    fails its check. Only an own e-mail address is about the author.
    """
    rows = ids.select(F.col("n").cast("long").alias("n")).withColumn("roll", _draw(seed, 1, 100))
    upto = list(accumulate(weight for _, weight in KINDS))
    kind = _first([(F.col("roll") < most, F.lit(name)) for (name, _), most in zip(KINDS, upto, strict=True)])
    pad = lambda salt, below, k: F.lpad(_draw(seed, salt, below).cast("string"), k, "0")
    one_of = lambda salt, items: F.element_at(F.array(*[F.lit(x) for x in items]), (_draw(seed, salt, len(items)) + 1).cast("int"))
    rows = rows.withColumn("kind", kind).withColumns({
        "card": D.luhn_complete(F.concat(F.lit("4"), pad(2, 10000000, 7), pad(3, 10000000, 7))),
        "sin": D.luhn_complete(F.concat((_draw(seed, 4, 7) + 1).cast("string"), pad(5, 10000000, 7))),
        "key": F.concat(F.lit("AKIA"), pad(9, 100000000, 8), pad(10, 100000000, 8)),
        "phone": F.concat(F.lit("416-555-"), pad(8, 10000, 4)),
        "address": F.concat((_draw(seed, 6, 900) + 1).cast("string"), F.lit(" "), one_of(7, ["Elm", "Lake", "Mill"]), F.lit(" Road, Northfield")),
        "own_email": F.concat(F.lit("user"), _draw(seed, 11, 5000).cast("string"), F.lit("@mail.example")),
    })
    shape = _draw(seed, 12, 3)
    card = F.when(shape == 0, D.group_digits("card", [4, 4, 4], " ")).when(shape == 1, D.group_digits("card", [4, 4, 4], "-")).otherwise(F.col("card"))
    spoilt = F.when(_draw(seed, 13, 2) == 0, D.break_luhn("card")).otherwise(F.lit(""))
    is_kind = lambda name: F.col("kind") == name
    values = {"card": card, "sin": D.group_digits("sin", [3, 3], " "), "clean": spoilt, **{name: F.col(name) for name in ("key", "phone", "address", "own_email")}}
    value = _first([(is_kind(name), x) for name, x in values.items()])
    lead, tail = (_first([(is_kind(name), one_of(14, [form[side] for form in forms])) for name, forms in LEADS.items()]) for side in (0, 1))
    rows = rows.withColumn("value", value).withColumns({"lead": F.when(F.col("value") == "", one_of(17, PROSE)).otherwise(lead), "tail": F.when(F.col("value") == "", F.lit("")).otherwise(tail)})
    labelled = F.col("kind") != "clean"
    return rows.select(
        "n", (F.lit(BASE) + F.col("n")).cast("string").alias("ts"), F.concat(F.lit("u"), _draw(seed, 15, 40).cast("string")).alias("user"), one_of(16, CHANNELS).alias("channel"),
        F.concat("lead", "value", "tail").alias("text"), "kind",
        F.when(labelled, F.element_at(F.create_map(*[F.lit(x) for kv in ENTITY.items() for x in kv]), F.col("kind"))).alias("entity"),
        F.when(labelled, F.length("lead")).alias("start"), F.when(labelled, F.length("lead") + F.length("value")).alias("end"),
        F.when(F.col("kind") == "own_email", "self").when(labelled, "third_party").alias("subject"),
    )


def holdout_split(messages: DataFrame, rows: int, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(all but the last `size` rows, the last `size` rows) of n = 0 .. rows - 1."""
    return messages.filter(F.col("n") < rows - size), messages.filter(F.col("n") >= rows - size)
