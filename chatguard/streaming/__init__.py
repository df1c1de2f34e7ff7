"""Structured Streaming forms of intake, lane, routing and roll-ups."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatguard.functions.spans import Part
from chatguard.operators import events as E
from chatguard.operators.windows import LANE, MAX_AGE, Lane

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def timed_state(rows: DataFrame) -> DataFrame:
    """rows, in a session whose streams keep state in RocksDB: state with timers needs it, and state may exceed memory."""
    if rows.sparkSession.conf.get(_PROVIDER) != _ROCKS:
        rows.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return rows


def stream_intake(events: DataFrame, memory: str = "1 day") -> DataFrame:
    """Human messages, unwrapped, once for each event key within the memory."""
    rows = E.to_messages(E.unwrap_edits(E.human_messages(events)))
    timed = rows.withColumn("event_time", F.timestamp_seconds("at"))
    return timed.withWatermark("event_time", memory).dropDuplicatesWithinWatermark(["event_key"])


_PIECE = 512  # rows of an author that are written to state and read from it at once


class OrderedLane(StatefulProcessor):
    """One author's lane: rows wait in state until the watermark has passed them and are then stepped through in order.

    State: the lane's entries, the waiting rows in pieces of up to 512 that are sorted by time, and the first time of each piece.
    A timer stands for the end of the earliest row's `slot` seconds; when it fires, pieces are read in order of their first
    times and merged with those before. Python holds one batch of arriving
    rows, or those pieces of one author that overlap in time, which is about one of each batch.
    """

    def __init__(self, wanted: set[str], age: float = MAX_AGE, slot: int = 10):
        self.wanted, self.age, self.slot = wanted, age, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ids array<string>, ats array<double>, folded array<string>, groups array<array<string>>, disguised array<int>")
        self.pieces = handle.getValueState("pieces", "firsts array<double>, numbers array<long>")
        self.waiting = handle.getMapState("waiting", "piece long", "ids array<string>, ats array<double>, folded array<string>, groups array<array<string>>, disguised array<int>, removes array<boolean>")

    def _over(self, at: float) -> int:
        return (int(at // self.slot) + 1) * self.slot * 1000

    def _known(self) -> list[tuple[float, int]]:
        known = self.pieces.get()
        return list(zip(*known, strict=True)) if known else []

    def _put(self, rows: list[tuple], pieces: list[tuple[float, int]]) -> None:
        """Rows in order of time into state, their pieces into the list."""
        number = max((n for _, n in pieces), default=-1) + 1
        for k in range(0, len(rows), _PIECE):
            some = rows[k : k + _PIECE]
            ats, *rest = zip(*some, strict=True)
            self.waiting.updateValue((number,), (list(rest[0]), list(ats), *map(list, rest[1:])))
            pieces.append((ats[0], number))
            number += 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = self._known()
        before, first = len(pieces), min(pieces, default=None)
        for frame in rows:
            some = frame[frame["id"].notna() & frame["at"].notna()]
            columns = (some["at"].astype(float), some["id"], some["folded"], map(list, some["groups"]), map(int, some["disguised"]), map(bool, some["removes"]))
            self._put(sorted(zip(*columns, strict=True), key=lambda r: r[:2]), pieces)
        if len(pieces) > before:
            self.pieces.update(tuple(map(list, zip(*pieces, strict=True))))
            if first is None or min(pieces) < first:
                self.handle.registerTimer(self._over(min(pieces)[0]))
        return iter(())

    def _due(self, until: float, pieces: list[tuple[float, int]]) -> Iterator[list[tuple]]:
        """Waiting rows before a time, merged in order; leaves in pieces what waits on."""
        heap = [((first, ""), number, None, 0) for first, number in pieces]
        heapify(heap)
        while heap and heap[0][0][0] < until:
            _, number, rows, k = heappop(heap)
            if rows is None:
                ids, ats, *rest = self.waiting.getValue((number,))
                self.waiting.removeKey((number,))
                rows = list(zip(ats, ids, *rest, strict=True))
            else:
                stop = min((until,), heap[0][0]) if heap else (until,)
                upto = max(k + 1, bisect_left(rows, stop, k, key=lambda r: r[:2]))
                yield rows[k:upto]
                k = upto
            if k < len(rows):
                heappush(heap, (rows[k][:2], number, rows, k))
        pieces[:] = [(key[0], number) for key, number, rows, _ in heap if rows is None]
        self._put(sorted((r for _, _, rows, k in heap if rows is not None for r in rows[k:]), key=lambda r: r[:2]), pieces)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, pieces, held = timerValues.getCurrentWatermarkInMs(), self._known(), self.held.get()
        lane = Lane([(i, a, Part(f, list(g), d)) for i, a, f, g, d in zip(*held, strict=True)] if held else [])
        until = float(now // (self.slot * 1000) * self.slot)
        due, out, columns = bool(pieces) and min(pieces)[0] < until, [], [c.split()[0] for c in LANE.split(", ")]
        frame = lambda: pd.DataFrame(dict(zip(columns, zip(*out, strict=True), strict=True)))
        for rows in self._due(until, pieces):
            for at, i, folded, groups, disguised, removes in rows:
                entity, ids, confidence = lane.step(i, at, Part(folded, groups, disguised), removes, lambda e, _: e in self.wanted)
                out.append((i, key[0], key[1], at, removes or entity is not None, entity, confidence if entity else None, ids))
            if len(out) >= 4096:
                yield frame()
                out = []
        if out:
            yield frame()
        if due:
            self.pieces.update(tuple(map(list, zip(*pieces, strict=True)))) if pieces else self.pieces.clear()
            if pieces:
                self.handle.registerTimer(self._over(min(pieces)[0]))
        # Rows to come are no older than the watermark less a slot.
        kept = [e for e in lane.entries if now / 1000 - self.slot - e[1] <= self.age]
        if kept:
            self.held.update(([e[0] for e in kept], [float(e[1]) for e in kept], [e[2].folded for e in kept], [list(e[2].groups) for e in kept], [int(e[2].disguised) for e in kept]))
            self.handle.registerTimer(int(max(e[1] for e in kept) + self.age + self.slot + 1) * 1000)
        elif held:
            self.held.clear()


def stream_rules_lane(messages: DataFrame, split_removes: list[str]) -> DataFrame:
    """The ordered rules lane: for rows that keep within the watermark the result is that of the batch, in whatever order they come.

    messages: id, channel, author, at, event_time (of at, with a watermark), folded, groups, disguised, removes. A row
    leaves when the watermark has passed its slot of ten seconds. A row with a null id yields nothing; it moves the watermark on
    where messages pause. Rows older than the watermark take no part and Spark counts them (numRowsDroppedByWatermark);
    what the rules alone say of them stands in `removes` before the lane.
    """
    slim = messages.select("id", "channel", "author", "at", "event_time", "folded", "groups", "disguised", "removes")
    grouped = timed_state(slim).groupBy("channel", "author")
    return grouped.transformWithStateInPandas(OrderedLane(set(split_removes)), LANE, "append", "eventTime")


def route_lanes(decided: DataFrame, removed_path: str, open_path: str):
    """A foreachBatch function that writes removed messages and messages for the model to two tables.

    Each batch has a folder of its own that is overwritten, so a batch that runs twice leaves its rows once.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for rows, path in ((batch.filter("removed"), removed_path), (batch.filter("not removed"), open_path)):
                rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return decided.writeStream.foreachBatch(route)


def stream_audit_rollup(audit: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, channel, action, n, model_calls) over tumbling windows of the audit time t."""
    timed = audit.withColumn("event_time", F.timestamp_seconds("t")).withWatermark("event_time", late)
    called = (F.coalesce(F.col("model"), F.lit("")) != "").cast("long")
    return timed.groupBy(F.window("event_time", width), "channel", "action").agg(F.count("*").alias("n"), F.sum(called).alias("model_calls"))


def stream_cursors(done: DataFrame) -> DataFrame:
    """(channel, last_ts) as it rises; for update mode."""
    return E.channel_cursors(done)


def stream_restores(tickets: DataFrame, requests: DataFrame, ttl: int = 900, late: str = "1 minute") -> DataFrame:
    """The earliest request of each ticket within ttl seconds of it; equal times go by actor.

    tickets: id, created timestamp. requests: ticket_id, actor_id, asked timestamp (managers only). Rows may come in
    any order within `late`. Windows are two ttl long and begin every ttl, so the one in whose first half a ticket was
    created holds all requests that count; its row leaves when the watermark has passed that window. State is a row for each
    ticket and window, kept by the JVM: the ticket's time and the requests so far. A ticket that comes again counts
    from its earliest time in the window. A row with a null ticket yields nothing; it moves the watermark on.
    """
    t = tickets.select(F.col("id").cast("string").alias("ticket_id"), F.lit(None).cast("string").alias("actor_id"), F.col("created").alias("event_time"), F.lit(True).alias("opened"))
    r = requests.select(F.col("ticket_id").cast("string").alias("ticket_id"), "actor_id", F.col("asked").alias("event_time"), F.lit(False).alias("opened"))
    half = max(ttl, 1)
    rows = timed_state(t.unionByName(r)).withWatermark("event_time", late).withColumn("window", F.window("event_time", f"{2 * half} seconds", f"{half} seconds"))
    at = F.unix_micros("event_time")
    rows = rows.filter(~F.col("opened") | (at < F.unix_micros("window.start") + half * 1_000_000))
    # Nulls are left out here, not before: a filter by ticket would also keep them from the watermark.
    known = lambda what, value: F.when(F.col("ticket_id").isNotNull() & what, value)
    held = rows.groupBy("window", "ticket_id").agg(F.min(known(F.col("opened"), at)).alias("created"), F.collect_set(known(~F.col("opened"), F.struct(at.alias("asked"), "actor_id"))).alias("requests"))
    best = F.array_min(F.filter("requests", lambda q: (q["asked"] >= F.col("created")) & (q["asked"] <= F.col("created") + ttl * 1_000_000)))
    out = held.withColumn("best", best).filter("best is not null")
    return out.select("ticket_id", F.col("best.actor_id").alias("actor_id"), F.timestamp_micros("best.asked").alias("asked"), F.unix_seconds(F.timestamp_micros("created")).alias("created_at"))
