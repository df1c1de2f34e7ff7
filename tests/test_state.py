"""Ordered state: the lane against a plain loop, streams against batches, tables and sinks."""

import random

import pandas as pd
import plain
import pytest
from compare import DATA
from pyspark.sql import functions as F

from chatguard import queries, sources, streaming
from chatguard.functions.spans import part_of
from chatguard.operators import decide, policy as P, report as R, windows as W
from chatguard.operators.windows import LANE

WORDS = ["4539 5787", "6362 1486", "hello there", "the card above", "number 12", "4539", "5787 6362 1486"]


def _messages(seed: int, n: int = 160) -> list[tuple]:
    rng, at, out = random.Random(seed), {}, []
    for k in range(n):
        channel, author = rng.choice("AB"), rng.choice("xy")
        at[channel, author] = at.get((channel, author), 0.0) + rng.choice([5.0, 20.0, 90.0, 200.0])
        key = f"m{k}" if rng.random() > 0.15 or k < 5 else f"m{k - 3}"
        out.append((key, channel, author, 1725000000.0 + at[channel, author], rng.choice(WORDS), rng.random() < 0.1))
    return out


def _naive(rows: list[tuple]) -> dict[tuple, tuple]:
    held, out = {}, {}
    for key, channel, author, at, text, removes in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        mine = [e for e in held.get((channel, author), []) if at - e[1] <= 180]
        hit, ids = None, []
        if not removes:
            earlier = [e for e in mine if e[0] != key]
            hit = plain.split([e[2] for e in earlier] + [text]) if earlier else None
            if hit:
                ids = [([e[0] for e in earlier] + [key])[i] for i in hit[1]]
                mine = [e for e in mine if e[0] not in ids]
            elif key in [e[0] for e in mine]:
                mine = [(key, e[1], text) if e[0] == key else e for e in mine]
            else:
                mine = (mine + [(key, at, text)])[-6:]
        held[channel, author] = mine
        out[key, channel, author, at] = (removes or hit is not None, tuple(ids))
    return out


def _frame(spark, rows):
    parts = [(k, c, a, t, x, r, part_of(x)) for k, c, a, t, x, r in rows]
    return spark.createDataFrame([(k, c, a, t, x, p.folded, p.groups, p.disguised, r) for k, c, a, t, x, r, p in parts], "id string, channel string, author string, at double, text string, folded string, groups array<string>, disguised int, removes boolean")


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 7)])
def test_lane_equals_plain_loop(spark, seed, parts):
    rows = _messages(seed)
    got = W.ordered_rules_lane(_frame(spark, rows).repartition(parts), ["CREDIT_CARD", "CA_SIN"]).collect()
    assert {(r["id"], r["channel"], r["author"], r["at"]): (r["removed"], tuple(r["related"])) for r in got} == _naive(rows)
    assert any(r["split_entity"] for r in got)


def test_chain_is_bounded(spark):
    rows = [(f"m{k}", "A", "x", 1725000000.0 + 10 * k, "t", False) for k in range(30)] + [("late", "A", "x", 1725009999.0, "t", False)]
    got = {r["id"]: [c["id"] for c in r["chain"]] for r in W.recent_chain(_frame(spark, rows), []).collect()}
    assert got["m20"] == [f"m{k}" for k in range(14, 20)] and got["late"] == [] and got["m0"] == []


@pytest.mark.parametrize("chunk", [50.0, 400.0, 1e9])
def test_chunks_change_no_chain_and_no_session(spark, chunk):
    rng = random.Random(int(chunk) % 97)
    rows, at = [], 1725000000.0
    for k in range(400):
        at += rng.choice([0.0, 1.0, 30.0, 60.0, 179.0, 180.0, 181.0, 700.0])
        rows.append((f"m{k:03d}", rng.choice("AB"), rng.choice("xy"), at, "t", False))
    frame = _frame(spark, rows).repartition(3)
    chains = {r["id"]: [c["id"] for c in r["chain"]] for r in W.recent_chain(frame, [], chunk=chunk).collect()}
    sessions = {r["id"]: r["session"] for r in W.author_session(frame, chunk=chunk).collect()}
    for channel in "AB":
        for author in "xy":
            mine, n = sorted((r for r in rows if r[1:3] == (channel, author)), key=lambda r: (r[3], r[0])), 0
            for k, r in enumerate(mine):
                n += k > 0 and r[3] - mine[k - 1][3] > 180
                assert sessions[r[0]] == n
                assert chains[r[0]] == [e[0] for e in mine[max(0, k - 6) : k] if r[3] - e[3] <= 180]
    assert len(chains) == len(sessions) == 400


def test_a_hot_author_is_many_groups(spark):
    """90 % of the rows are one author's: no task of the chain's window holds more than twice the median."""
    rows = spark.range(40_000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), F.lit("A").alias("channel"), F.when(F.col("id") % 10 > 0, "bot").otherwise(F.concat(F.lit("u"), (F.col("id") % 997).cast("string"))).alias("author"), (F.lit(1725000000.0) + F.col("id") * 20).alias("at"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in W.recent_chain(rows, []).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 40_000 and len(sizes) == 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_quantiles_of_real_values(spark):
    rng = random.Random(3)
    for values in ([rng.gauss(100, 30) for _ in range(501)], [5.0] * 40, [1.0, 1e9, 1e-9, -4.0], [7.0], [None, 3.0]):
        row = R.latency_quantiles(spark.createDataFrame([(v,) for v in values], "ms double")).first()
        ranked = sorted(v for v in values if v is not None)
        assert (row["p50"], row["p95"]) == (ranked[len(ranked) // 2], ranked[int(len(ranked) * 0.95)])
    assert tuple(R.latency_quantiles(spark.createDataFrame([], "ms double")).first()) == (None, None)


@pytest.mark.parametrize("chunk,warm", [(100.0, 0.0), (37.0, 20.0), (700.0, 360.0), (1e9, 0.0)])
def test_lane_of_an_author_who_never_pauses(spark, monkeypatch, chunk, warm):
    """Chunks that begin with a wrong state are replayed until all ends meet."""
    rng, at, rows = random.Random(int(chunk)), 1725000000.0, []
    for k in range(260):
        at += rng.choice([1.0, 5.0, 20.0, 60.0])
        rows.append((f"m{k}" if k < 5 or rng.random() > 0.1 else f"m{k - 2}", "A", rng.choice("xxxxy"), at, rng.choice(WORDS), rng.random() < 0.05))
    passes = []
    real = W.kept
    monkeypatch.setattr(W, "kept", lambda df, name: (passes.append(name), real(df, name))[1])
    got = W.ordered_rules_lane(_frame(spark, rows).repartition(3), ["CREDIT_CARD", "CA_SIN"], chunk=chunk, warm=warm).collect()
    assert len(got) == len(rows)
    assert {(r["id"], r["channel"], r["author"], r["at"]): (r["removed"], tuple(r["related"])) for r in got} == _naive(rows)
    assert passes.count("lane-pass") > 1 if warm == 0.0 and chunk < 1e9 else passes.count("lane-pass") >= 1


def test_a_hot_author_is_many_tasks_of_the_lane(spark):
    """90 % of 40,000 rows are one author's, without a pause: no task replays more than twice the median."""
    n = F.col("id")
    rows = spark.range(40_000).select(F.concat(F.lit("m"), n.cast("string")).alias("id"), F.lit("A").alias("channel"), F.when(n % 10 > 0, "bot").otherwise(F.concat(F.lit("u"), (n % 997).cast("string"))).alias("author"), (F.lit(1725000000.0) + n * 20).alias("at"), F.lit("word").alias("folded"), F.array().cast("array<string>").alias("groups"), F.lit(0).alias("disguised"), F.lit(False).alias("removes"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lane = W.ordered_rules_lane(rows, ["CREDIT_CARD"])
        files = [r["n"] for r in lane.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(files) == 40_000 and len(files) == 4 and max(files) <= 2 * sorted(files)[len(files) // 2]


def _lane_stream(spark, place, schema, delay="1 hour"):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place / "in")).withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", delay)
    lane = streaming.stream_rules_lane(source, ["CREDIT_CARD", "CA_SIN"])
    query = lane.writeStream.format("parquet").option("path", str(place / "out")).option("checkpointLocation", str(place / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return query


def _beat(at):
    return (None, None, None, at, "", False)


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_lane_equals_batch(spark, tmp_path, shuffled):
    """Rows that come in any order within the watermark, over several triggers."""
    rows = list({(r[0], r[1], r[2]): r for r in _messages(5, 60)}.values())
    frame = _frame(spark, rows)
    came = rows[:]
    random.Random(1).shuffle(came) if shuffled else None
    for part in (came[:25], came[25:], [_beat(max(r[3] for r in rows) + 90_000)]):
        _frame(spark, [(k, c, a, t, x or "", r) for k, c, a, t, x, r in part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    _lane_stream(spark, tmp_path, frame.schema, "2 days")
    assert not (tmp_path / "out").exists() or spark.read.schema(LANE).parquet(str(tmp_path / "out")).count() == 0
    _frame(spark, [_beat(max(r[3] for r in rows) + 400_000)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    _lane_stream(spark, tmp_path, frame.schema, "2 days")
    key = lambda r: (r["id"], r["channel"], r["author"], r["at"], r["removed"], tuple(r["related"]))
    batch = W.ordered_rules_lane(frame, ["CREDIT_CARD", "CA_SIN"])
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(key, batch.collect()))


def test_a_row_that_came_out_of_order_takes_its_place(spark, tmp_path):
    """Its second half comes first, the first half a trigger later: the stream joins them in order of time."""
    base = 1725000000.0
    for rows in ([("b", "A", "x", base + 50, "6362 1486", False)], [("a", "A", "x", base + 20, "4539 5787", False)], [_beat(base + 9000)]):
        frame = _frame(spark, rows)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        _lane_stream(spark, tmp_path, frame.schema)
    got = {r["id"]: (r["split_entity"], tuple(r["related"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": (None, ()), "b": ("CREDIT_CARD", ("a", "b"))}


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    base, dropped = 1725000000.0, 0
    for rows in ([("a", "A", "x", base, "hi", False), _beat(base + 9000)], [("b", "A", "x", base + 9001, "hi", False)], [("late", "A", "x", base + 1, "hi", False)], [_beat(base + 99_000)]):
        frame = _frame(spark, rows)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = _lane_stream(spark, tmp_path, frame.schema)
        dropped += sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"] and dropped == 1


class _State:
    """State of one key in memory, its value under None; counts what would go between Python and the JVM."""

    def __init__(self, calls):
        self.held, self.calls = {}, calls

    def get(self):
        return self.getValue(None)

    def getValue(self, key):
        self.calls.append("get")
        return self.held.get(key)

    def update(self, value):
        self.updateValue(None, value)

    def updateValue(self, key, value):
        self.calls.append("put")
        self.held[key] = value

    def clear(self):
        self.held.clear()

    def removeKey(self, key):
        self.calls.append("remove")
        del self.held[key]


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], set()
        self.getValueState = self.getMapState = lambda *_: _State(self.calls)
        self.registerTimer = self.timers.add


class _Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def _stepped(rows, frames, marks):
    """Rows of the lane and calls of state: frames a trigger, with the watermark at marks afterwards."""
    lane, handle, out = streaming.OrderedLane({"CREDIT_CARD", "CA_SIN"}), _Handle(), []
    lane.init(handle)
    columns = ["id", "at", "folded", "groups", "disguised", "removes"]
    frame = lambda some: pd.DataFrame([(k, t, p.folded, p.groups, p.disguised, r) for k, _, _, t, x, r in some for p in [part_of(x)]], columns=columns)
    for came, mark in zip(frames, marks, strict=True):
        list(lane.handleInputRows(("A", "x"), iter([frame([rows[k] for k in some]) for some in came]), _Now(0)))
        while due := [t for t in handle.timers if t <= mark * 1000]:
            handle.timers.discard(min(due))
            now = len(out)
            out += [r for f in lane.handleExpiredTimer(("A", "x"), _Now(int(mark * 1000)), _Now(min(due))) for r in f.to_dict("records")]
            assert all(r["at"] < mark for r in out[now:])
    return out, handle.calls


@pytest.mark.parametrize("shuffled", [False, True])
def test_lane_state_goes_in_pieces_and_not_by_slot(shuffled):
    """8,000 rows of one author in 8 frames take few steps between Python and the JVM, in whatever order they come."""
    rng = random.Random(7)
    rows = [(f"m{k:05d}", "A", "x", 1725000000.0 + 7 * k, rng.choice(WORDS), rng.random() < 0.05) for k in range(8000)]
    order = list(range(8000))
    rng.shuffle(order) if shuffled else None
    out, calls = _stepped(rows, [[order[k : k + 1000] for k in range(0, 8000, 1000)]], [1725100000.0])
    want = _naive(rows)
    assert [r["id"] for r in out] == [r[0] for r in rows]
    assert all((r["removed"], tuple(r["related"])) == want[r["id"], "A", "x", r["at"]] for r in out)
    assert len(calls) < 100


def test_lane_of_many_triggers_with_rows_out_of_order():
    """Rows come up to 600 s late while the watermark follows: each leaves once, in order, and as the plain loop has it."""
    rng = random.Random(8)
    at, rows = 1725000000.0, []
    for k in range(3000):
        at += rng.choice([0.0, 0.5, 5.0, 20.0, 60.0, 200.0])
        rows.append((f"m{k:05d}", "A", "x", at, rng.choice(WORDS), rng.random() < 0.05))
    order = sorted(range(3000), key=lambda k: rows[k][3] + rng.random() * 600)
    frames = [[order[k : k + 60], order[k + 60 : k + 70]] for k in range(0, 2940, 70)] + [[order[2940:]]]
    marks, top = [], 0.0
    for came in frames:
        top = max(top, *(rows[k][3] for some in came for k in some))
        marks.append(top - 600)
    out, _ = _stepped(rows, [*frames, []], [*marks, top + 1000])
    want = _naive(rows)
    assert [(r["at"], r["id"]) for r in out] == sorted((r[3], r[0]) for r in rows)
    assert all((r["removed"], tuple(r["related"])) == want[r["id"], "A", "x", r["at"]] for r in out)


def test_shared_folder_is_asked_for(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn", "applicationId": "x"})

    with pytest.raises(ValueError):
        sources.shared_folder(Cluster())


def test_report_file(spark, tmp_path):
    sources.write_report(spark.createDataFrame([("mask", 3)], "action string, n long"), str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).collect()[0].asDict() == {"action": "mask", "n": "3"}


def test_missed_messages_cap(spark):
    from chatguard.operators import events as E

    history = spark.createDataFrame([("c", f"{k}.5", f"c.{k}.5") for k in range(1, 9)], "channel string, ts string, event_key string")
    cursors, stored = spark.createDataFrame([("c", "2.5")], "channel string, last_ts string"), history.filter("ts = '4.5'")
    assert [r["ts"] for r in E.missed_messages(history, cursors, stored, most=3).collect()] == ["3.5", "5.5", "6.5"]


def test_stream_lane_query_finds_splits(spark):
    rows = queries.stream_lane(spark, DATA).collect()
    assert any(r["split_entity"] == "CREDIT_CARD" for r in rows) and any(not r["removed"] for r in rows)


def test_routing_is_idempotent(spark, tmp_path):
    frame = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "id string, removed boolean")
    frame.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        streaming.route_lanes(source, str(tmp_path / "gone"), str(tmp_path / "open")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "gone")).count() == 1 and spark.read.parquet(str(tmp_path / "open")).count() == 2


def _restored(spark, tmp_path, steps):
    """Rows of (kind, ticket, actor, seconds) a trigger; the last request is a heartbeat a day later."""
    t_schema, r_schema = "id string, created timestamp", "ticket_id string, actor_id string, asked timestamp"
    stamp = lambda s: F.timestamp_seconds(F.lit(1725000000) + F.col("s"))
    for name, schema in (("t", t_schema), ("r", r_schema)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    for step in [*steps, [("r", None, "beat", 86400)]]:
        tickets = [(i, s) for k, i, _, s in step if k == "t"]
        asked = [(i, a, s) for k, i, a, s in step if k == "r"]
        if tickets:
            spark.createDataFrame(tickets, "id string, s long").select("id", stamp(0).alias("created")).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        if asked:
            spark.createDataFrame(asked, "ticket_id string, actor_id string, s long").select("ticket_id", "actor_id", stamp(0).alias("asked")).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        out = streaming.stream_restores(spark.readStream.schema(t_schema).parquet(str(tmp_path / "t")), spark.readStream.schema(r_schema).parquet(str(tmp_path / "r")), late="10 minutes")
        out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    return {r["ticket_id"]: (r["actor_id"], r["asked"].timestamp() - 1725000000, r["created_at"] - 1725000000) for r in spark.read.parquet(str(tmp_path / "o")).collect()}


def test_stream_restores_within_ttl(spark, tmp_path):
    assert _restored(spark, tmp_path, [[("t", "t1", None, 100), ("t", "t2", None, 100), ("r", "t1", "u", 200), ("r", "t2", "u", 2000)]]) == {"t1": ("u", 200, 100)}


def test_the_earliest_request_counts_whatever_comes_first(spark, tmp_path):
    steps = [
        [("t", "t1", None, 100), ("r", "t1", "second", 400), ("r", "t3", "ahead", 350), ("r", "t3", "too early", 10)],
        [("r", "t1", "first", 250), ("t", "t3", None, 50), ("r", "t4", "b", 300), ("r", "t4", "a", 300), ("t", "t4", None, 300)],
        [("r", "t1", "third", 380), ("r", "t9", "no ticket", 380), ("r", "t3", "later", 500)],
    ]
    assert _restored(spark, tmp_path, steps) == {"t1": ("first", 250, 100), "t3": ("ahead", 350, 50), "t4": ("a", 300, 300)}


def _streamed_restores(spark, tmp_path, tickets, requests):
    """All rows at once, then a request without a ticket ten days later; must end within a minute."""
    t_schema, r_schema = "id string, created timestamp", "ticket_id string, actor_id string, asked timestamp"
    tickets.write.parquet(str(tmp_path / "t"))
    beat = spark.range(1).select(F.lit(None).cast("string").alias("ticket_id"), F.lit("beat").alias("actor_id"), F.timestamp_seconds(F.lit(1725864000)).alias("asked"))
    requests.unionByName(beat).write.parquet(str(tmp_path / "r"))
    out = streaming.stream_restores(spark.readStream.schema(t_schema).parquet(str(tmp_path / "t")), spark.readStream.schema(r_schema).parquet(str(tmp_path / "r")), late="10 minutes")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "o"))


def test_fifty_thousand_tickets_take_no_step_each(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(50_000)
    base = F.lit(1725000000) + n
    asked = rows.withColumn("again", F.explode(F.array(F.lit(40), F.lit(0))))
    got = _streamed_restores(
        spark, tmp_path, rows.select(n.cast("string").alias("id"), F.timestamp_seconds(base).alias("created")),
        asked.select(n.cast("string").alias("ticket_id"), F.concat(F.lit("u"), F.col("again").cast("string")).alias("actor_id"), F.timestamp_seconds(base + n * 37 % 1800 + F.col("again")).alias("asked")),
    )
    want = {(str(k), "u0", 1725000000 + k + k * 37 % 1800, 1725000000 + k) for k in range(50_000) if k * 37 % 1800 <= 900}
    rows = [tuple(r) for r in got.select("ticket_id", "actor_id", F.unix_timestamp("asked"), "created_at").collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_restores_equal_a_plain_loop_at_every_edge(spark, tmp_path):
    """Times a microsecond apart, on both ends of a ticket's time and of quarter hours, rows that come twice, null tickets."""
    rng, base, edge = random.Random(4), 1725000000 * 1_000_000, 900 * 1_000_000
    tickets = [(f"t{k}", base + rng.randrange(4) * edge + rng.choice([0, 1, -1, rng.randrange(edge)])) for k in range(60)]
    requests = [(i, rng.choice("abc"), c + rng.choice([0, 1, -1, edge, edge + 1, edge - 1, rng.randrange(2 * edge)])) for i, c in tickets for _ in range(rng.randrange(4))]
    want = {}
    for i, c in tickets:
        if mine := [(at, who) for j, who, at in requests if j == i and c <= at <= c + edge]:
            want[i] = (min(mine)[1], min(mine)[0], c // 1_000_000)
    stamp = lambda c: F.timestamp_micros(c).alias(c)
    t = spark.createDataFrame([*tickets, *tickets[:9], (None, base + 5)], "id string, created long").select("id", stamp("created"))
    r = spark.createDataFrame([*requests, *requests[:9], (None, "a", base + 6)], "ticket_id string, actor_id string, asked long").select("ticket_id", "actor_id", stamp("asked"))
    rows = _streamed_restores(spark, tmp_path, t, r).select("ticket_id", "actor_id", F.unix_micros("asked"), "created_at").collect()
    assert len(rows) == len(want) > 20 and {r[0]: tuple(r)[1:] for r in rows} == want


def test_audit_files(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert sources.read_audit(spark, path).count() == 0
    rows = spark.createDataFrame([(1.0, "a", "mask")], "t double, id string, action string")
    sources.write_audit(rows, path)
    sources.write_audit(rows, path)
    (tmp_path / "audit" / "bad.json").write_text('\n{broken\n{"t": 2.0, "id": "b", "action": "allow", "token_usage": {"total_tokens": 5}}\n')
    assert sources.read_audit(spark, path).count() == 3
    with pytest.raises(ValueError):
        sources.write_audit(rows.withColumn("text", F.lit("x")), path)


def test_labelled_and_cases(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"ts": "1", "user": "u", "channel": "c", "text": "t", "label": {"entity": "IBAN", "span": [0, 1], "subject": "self"}}]')
    assert sources.read_labelled(spark, str(tmp_path / "l.json")).first()["label"]["span"] == [0, 1]
    (tmp_path / "c.json").write_text('{"id": "C1", "category": "x", "messages": ["4539 5787", "6362 1486"], "expect": "removed"}\n{"id": "C2", "category": "x", "text": "hi", "expect": "removed", "known_gap": true}\n')
    cases = sources.read_cases(spark, str(tmp_path / "c.json"))
    decided = decide.rules_decision(R.case_messages(cases), P.DEFAULT_POLICY)
    outcomes = R.case_outcomes(cases, decided.select("case_id", "place", "action")).collect()
    assert {r["id"]: r["status"] for r in outcomes} == {"C1": "pass", "C2": "known gap"}


def test_policy_severity_and_self(spark):
    policy = {"rules": [{"id": "a", "entity": "EMAIL", "action": "warn"}, {"id": "b", "entity": "IBAN", "action": "block"}], "channels": {"#x": {"overrides": [{"entity": "IBAN", "action": "log"}]}}}
    rows = spark.createDataFrame([
        (1, "y", [("EMAIL", 0, 1, 0.9, "unknown", 0, ""), ("IBAN", 0, 1, 0.9, "unknown", 0, "")]), (2, "x", [("IBAN", 0, 1, 0.9, "unknown", 0, "")]), (3, "y", [("IBAN", 0, 1, 0.9, "self", 0, "")]), (4, "y", [("IBAN", 0, 1, 0.5, "unknown", 0, "")]), (5, "y", []),
    ], "n int, channel string, f array<struct<entity:string,start:int,end:int,confidence:double,subject:string,tier:int,note:string>>")
    got = {r["n"]: (r["d"]["action"], r["d"]["rule_id"]) for r in rows.select("n", P.decision(F.col("f"), F.col("channel"), F.lit(False), policy).alias("d")).collect()}
    assert got == {1: ("block", "b"), 2: ("log", ""), 3: ("allow", None), 4: ("allow", None), 5: ("allow", None)}


def test_empty_audit(spark):
    rows = spark.createDataFrame([], "action string, channel string, model string, entities array<string>, token_usage map<string,int>, cost_usd double")
    one = R.routing_summary(rows).first()
    assert one["total"] == 0 and one["tokens"] == 0 and one["zero_token_share"] == 0.0
    assert R.counts_by(rows).count() == 0
