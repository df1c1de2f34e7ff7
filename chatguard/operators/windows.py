"""Per-author order: chains, sessions, the ordered rules lane, and job queues."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatguard.functions.spans import Part, split_hit
from chatguard.sources import kept

MAX_MESSAGES, MAX_AGE = 6, 180.0
CHUNK = 3600.0  # seconds of an author's messages in one group


def recent_chain(messages: DataFrame, carry: list[str], size: int = MAX_MESSAGES, age: float = MAX_AGE, chunk: float = CHUNK) -> DataFrame:
    """messages with chain: structs of id, at and the carried columns of the author's earlier messages, oldest first.

    At most `size` rows back in the same channel, none older than `age` seconds, never the message itself. Time is
    cut into chunks of `chunk` seconds; rows of the last `age` seconds of one also go ahead of the next, so a busy
    author is many groups and every chain is whole.
    """
    own, ahead = F.floor(F.col("at") / chunk), F.floor((F.col("at") + age) / chunk)
    rows = messages.withColumns({"__own": own, "__chunk": F.explode(F.coalesce(F.sequence(own, ahead), F.array(F.lit(None).cast("long"))))})
    back = Window.partitionBy("channel", "author", "__chunk").orderBy("at", "id").rowsBetween(-size, -1)
    chain = F.collect_list(F.struct("id", "at", *carry)).over(back)
    rows = rows.withColumn("chain", F.filter(chain, lambda m: (F.col("at") - m["at"] <= age) & (m["id"] != F.col("id"))))
    return rows.filter(F.col("__own").eqNullSafe(F.col("__chunk"))).drop("__own", "__chunk")


def author_session(messages: DataFrame, age: float = MAX_AGE, chunk: float = CHUNK) -> DataFrame:
    """messages with session: counts up where an author pauses for more than `age` seconds.

    Pauses are counted inside chunks of time; one row a chunk then carries the counts and the pauses between chunks
    on, so only as many rows as an author has chunks meet in one group.
    """
    rows = messages.withColumn("__chunk", F.floor(F.col("at") / chunk))
    order = Window.partitionBy("channel", "author", "__chunk").orderBy("at", "id")
    gap = F.coalesce((F.col("at") - F.lag("at").over(order) > age).cast("long"), F.lit(0))
    rows = rows.withColumn("__gap", gap).withColumn("__inside", F.sum("__gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = rows.groupBy("channel", "author", "__chunk").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.sum("__gap").alias("gaps"))
    later = Window.partitionBy("channel", "author").orderBy("__chunk")
    between = F.coalesce((F.col("low") - F.lag("high").over(later) > age).cast("long"), F.lit(0))
    edges = edges.withColumn("between", between).withColumn("before", F.sum(F.col("between") + F.col("gaps")).over(later.rowsBetween(Window.unboundedPreceding, 0)) - F.col("gaps"))
    edges = edges.select(F.col("channel").alias("__c"), F.col("author").alias("__a"), F.col("__chunk").alias("__k"), F.col("before").alias("__before"))
    same = F.col("channel").eqNullSafe(F.col("__c")) & F.col("author").eqNullSafe(F.col("__a")) & F.col("__chunk").eqNullSafe(F.col("__k"))
    return rows.join(edges, same).withColumn("session", (F.col("__before") + F.col("__inside")).cast("long")).drop("__c", "__a", "__k", "__before", "__inside", "__gap", "__chunk")


def worth_window_check(chain_groups: F.Column, own_groups: F.Column) -> F.Column:
    """Digits in this message and another of the chain, nine or more in all."""
    chars = lambda groups: F.length(F.array_join(groups, ""))
    total = F.aggregate(chain_groups, F.lit(0), lambda n, g: n + chars(g)) + chars(own_groups)
    return (F.size(own_groups) > 0) & F.exists(chain_groups, lambda g: F.size(g) > 0) & (total >= 9)


class Lane:
    """The window of one author in one channel: at most six kept messages with the parts split detection needs."""

    def __init__(self, entries: list[tuple[str, float, Part]] | None = None):
        self.entries = entries or []

    def step(self, key: str, at: float, part: Part, removes: bool, split_action) -> tuple[str | None, list[str], float]:
        """(split entity, ids that form it, confidence) for the next message; keeps it unless it is removed.

        removes: the rules alone remove it. split_action(entity, confidence) says whether such a hit removes.
        """
        self.entries = [e for e in self.entries if at - e[1] <= MAX_AGE]
        if removes:
            return None, [], 0.0
        earlier = [e for e in self.entries if e[0] != key]
        hit = split_hit([*(e[2] for e in earlier), part]) if earlier else None
        if hit and split_action(hit[0], hit[2]):
            ids = [*(e[0] for e in earlier), key]
            gone = [ids[i] for i in hit[1]]
            self.entries = [e for e in self.entries if e[0] not in gone]
            return hit[0], gone, hit[2]
        for n, e in enumerate(self.entries):
            if e[0] == key:
                self.entries[n] = (key, e[1], part)
                break
        else:
            self.entries = [*self.entries, (key, at, part)][-MAX_MESSAGES:]
        return None, [], 0.0


LANE = "id string, channel string, author string, at double, removed boolean, split_entity string, split_confidence double, related array<string>"
_HELD = "array<struct<id:string,at:double,folded:string,groups:array<string>,disguised:int>>"
_REPLAYED = f"{LANE}, chunk long, first double, start {_HELD}, finish {_HELD}"
_KEY = ["channel", "author", "chunk"]


def _held(entries: list[tuple[str, float, Part]]) -> list[dict]:
    return [{"id": i, "at": float(a), "folded": p.folded, "groups": list(p.groups), "disguised": int(p.disguised)} for i, a, p in entries]


def _lane_of(held) -> Lane:
    return Lane([(e["id"], e["at"], Part(e["folded"], list(e["groups"]), e["disguised"])) for e in held])


def _replay(frames: Iterator[pd.DataFrame], wanted: set[str], age: float) -> Iterator[pd.DataFrame]:
    """Chunks in order of time from their start states: a row for each message of a chunk, then one with its two ends.

    Rows of a chunk before are stepped through for the state they leave and give no row.
    """
    now, lane, ends = None, Lane(), None
    columns = [c.split()[0] for c in LANE.split(", ")] + ["chunk", "first", "start", "finish"]

    def closing() -> list[tuple]:
        return [] if ends is None else [(None, now[0], now[1], None, None, None, None, None, now[2], ends[0], ends[1], _held(lane.entries))]

    for frame in frames:
        out = []
        for channel, author, chunk, own, at, key, folded, groups, disguised, removes, start in frame.itertuples(index=False):
            if (channel, author, chunk) != now:
                out += closing()
                now, lane, ends = (channel, author, chunk), _lane_of(start if start is not None else ()), None
            if own and ends is None:
                ends = (at, _held([e for e in lane.entries if at - e[1] <= age]))
            entity, ids, confidence = lane.step(key, at, Part(folded, list(groups), disguised), bool(removes), lambda e, _: e in wanted)
            if own:
                out.append((key, channel, author, at, bool(removes) or entity is not None, entity, confidence if entity else None, ids, chunk, None, None, None))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(closing(), columns=columns)


def ordered_rules_lane(messages: DataFrame, split_removes: list[str], age: float = MAX_AGE, chunk: float = CHUNK, warm: float = 2 * MAX_AGE) -> DataFrame:
    """The exact replay: removed messages never enter the window, split hits forget their parts, edits keep their slot.

    messages: id, channel, author, at, folded, groups, disguised, removes (the rules alone remove it). An edit
    repeats the id with a later at. split_removes: entities whose split hits the policy removes.

    An author's time is cut into chunks of `chunk` seconds that are replayed at once, each from the state that its
    last `warm` seconds before leave. A chunk whose state at its beginning is not what the chunk before really left
    is replayed again from that, until all ends meet; so an author who never pauses is many tasks, and the
    result is that of one pass whatever `chunk` and `warm` are. Usually the first pass is right: entries older than
    `age` count no more. In the worst case an author takes as many passes as chunks.
    """
    wanted = set(split_removes)
    slim = kept(messages.select("channel", "author", "at", "id", "folded", "groups", "disguised", "removes"), "lane-rows")
    own, ahead = F.floor(F.col("at") / chunk), F.floor((F.col("at") + warm) / chunk)
    order = [*_KEY, "at", "id"]

    def passed(rows: DataFrame, start: F.Column) -> DataFrame:
        dealt = rows.select(*_KEY, (F.col("chunk").eqNullSafe(own)).alias("own"), "at", "id", "folded", "groups", "disguised", "removes", start.alias("start"))
        return kept(dealt.repartition(*_KEY).sortWithinPartitions(*order).mapInPandas(lambda x: _replay(x, wanted, age), _REPLAYED), "lane-pass")

    chunks = F.explode(F.coalesce(F.sequence(own, ahead), F.array(F.lit(None).cast("long"))))
    passes = [passed(slim.withColumn("chunk", chunks), F.lit(None).cast(_HELD))]
    ends = passes[0].filter("finish is not null").select(*_KEY, "first", "start", "finish", F.lit(0).alias("last"))
    # One row a chunk: what the chunk before left, as far as it is young enough for the chunk's first message.
    before = F.coalesce(F.lag("finish").over(Window.partitionBy("channel", "author").orderBy("chunk")), F.array().cast(_HELD))
    left = F.filter(before, lambda e: F.col("first") - e["at"] <= age)
    same = lambda a, b: reduce(and_, (a[c].eqNullSafe(b[c]) for c in _KEY))
    while True:
        wrong = kept(ends.withColumn("left", left).filter("start <> left").select(*_KEY, "left"), "lane-wrong")
        if wrong.isEmpty():
            break
        rows = slim.withColumn("chunk", own)
        again = rows.join(wrong, same(rows, wrong)).select(*(rows[c] for c in rows.columns), "left")
        passes.append(passed(again, F.col("left")))
        new = passes[-1].filter("finish is not null").select(*_KEY, "first", "start", "finish", F.lit(len(passes) - 1).alias("last"))
        ends = kept(ends.join(wrong, same(ends, wrong), "left_anti").unionByName(new), "lane-ends")
    columns = [c.split()[0] for c in LANE.split(", ")]
    if len(passes) == 1:
        return passes[0].filter("finish is null").select(*columns)
    rows = reduce(DataFrame.unionByName, [p.filter("finish is null").withColumn("last", F.lit(n)) for n, p in enumerate(passes)])
    return rows.join(ends, same(rows, ends) & (rows["last"] == ends["last"]), "left_semi").select(*columns)


def claimable_jobs(jobs: DataFrame, now: float) -> DataFrame:
    """The oldest queued job of each (topic, lane), where it is due; a head that waits blocks its lane."""
    row = F.struct(*[F.col(c) for c in jobs.columns])
    head = jobs.filter("status = 'queued'").groupBy("topic", "lane").agg(F.min_by(row, "id").alias("__row"))
    return head.select("__row.*").filter(F.col("available_at") <= now)


def retry_plan(failures: DataFrame, now: float, most: int = 5, longest: float = 30.0) -> DataFrame:
    """failures with status dead from `most` attempts on, else queued after 2^attempts seconds, and a short error."""
    dead = F.col("attempts") >= most
    return failures.withColumns({
        "status": F.when(dead, "dead").otherwise("queued"),
        "available_at": F.when(dead, F.col("available_at")).otherwise(F.lit(now) + F.least(F.lit(longest), F.pow(F.lit(2.0), F.col("attempts")))),
        "error": F.substring("error", 1, 500),
    })


def prune_done(jobs: DataFrame, now: float, keep_seconds: float = 86400) -> DataFrame:
    """jobs without those done longer ago than keep_seconds."""
    return jobs.filter(~((F.col("status") == "done") & (F.col("finished_at") < now - keep_seconds)) | F.col("finished_at").isNull())
