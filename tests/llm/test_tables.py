"""Mixing, resharding and the pipeline against brute force."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatguard.llm import mixing, reshard
from chatguard.llm.mixing import mix_to_targets, source_targets, word_count

DATA = "/root/testdata/sf0.001"


def test_targets():
    assert source_targets({"a": 100, "b": 100, "c": 100}) == {"a": 200, "b": 250 * 1 / 3, "c": 250 * 2 / 3}
    got = source_targets({"b": 10, None: 1000, "a": 1})
    assert got["a"] == 2 and got["b"] == 20 and got[None] == pytest.approx(1.5 * 1011 - 22)
    assert source_targets({}) == {}
    for sizes in itertools.product([0, 1, 50, 1000], repeat=4):
        named = dict(zip("abcd", sizes, strict=True))
        got = source_targets(named)
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes)) and all(got[s] <= 2 * named[s] + 1e-9 for s in named)


def _mixed(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    return mix_to_targets(frame).toPandas()


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", "c", None]), int(rng.paretovariate(1.2) * 20)) for k in range(3000)] + [(k, "hot", 40) for k in range(3000, 5000)]
    got = _mixed(spark, rows)
    assert len(got) == len(rows) and set(got["mix_copies"]) <= {0, 1, 2}
    got["key"] = got["source"].fillna("~")
    totals = {}
    for _, s, n in rows:
        totals[s] = totals.get(s, 0) + n
    want = source_targets(totals)
    for key, part in got.groupby("key"):
        source = None if key == "~" else key
        assert part["mix_target"].iloc[0] == pytest.approx(want[source])
        assert (part["mix_source_size"] == totals[source]).all()
        largest = part["size"].max()
        assert abs((part["mix_copies"] * part["size"]).sum() - want[source]) <= 0.6 * largest + 1
    again = _mixed(spark, rows[::-1])
    assert dict(zip(got["doc_id"], got["mix_copies"], strict=True)) == dict(zip(again["doc_id"], again["mix_copies"], strict=True))


def test_rates_tilt_exponentially(spark):
    import numpy as np

    hist = spark.createDataFrame([(0, s, 100) for s in (1, 5, 20, 80)], "sno int, size long, n long")
    total = 100 * 106.0
    for target in (0.3 * total, total, 1.7 * total):
        (lam,) = mixing._solve(hist, [26.5], [target], [total], [1.0], 2.0)
        rates = np.minimum(2, np.exp(lam * np.array([1, 5, 20, 80]) / 26.5))
        assert (100 * np.array([1, 5, 20, 80]) * rates).sum() == pytest.approx(target, rel=1e-6)


def test_awkward_mix(spark, awkward, nothing):
    got = mix_to_targets(awkward.withColumn("n", word_count("text")), size="n")
    assert got.count() == awkward.count() and set(awkward.columns) <= set(got.columns)
    assert mix_to_targets(nothing.withColumn("n", word_count("text")), size="n").count() == 0
    words = {r["doc_id"]: r["n"] for r in awkward.select("doc_id", word_count("text").alias("n")).collect()}
    assert words[1] == words[2] == words[3] == 0 and words[4] == 60001 and words[8] == 2
    assert _mixed(spark, [(1, "a", 0), (2, "a", None)])["mix_copies"].tolist() == [1, 1]


def test_mix_takes_any_column_names(spark):
    names = ("base", "more", "sno", "n", "part", "upto", "extra", "of", "total", "want", "from", "to", "copies", "x.y", "mix_target")
    rows = spark.createDataFrame([(k, "ab"[k % 2], k % 7, *names) for k in range(40)], ", ".join(["doc_id long", "source string", "size long", *(f"`{n}` string" for n in names)]))
    got = mix_to_targets(rows).toPandas()
    assert all((got[n] == n).all() for n in names if n != "mix_target") and len(got) == 40
    plain = mix_to_targets(rows.select("doc_id", "source", "size")).groupBy("source").agg(F.sum(F.col("size") * F.col("mix_copies")).alias("t")).collect()
    assert {r["source"]: r["t"] for r in plain} == got.assign(t=got["size"] * got["mix_copies"]).groupby("source")["t"].sum().to_dict()


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(0)
    for _ in range(30):
        supply = [rng.randint(0, 9) for _ in range(3)]
        capacity = [rng.randint(0, 9) for _ in range(3)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        flow = reshard.min_cost_flow(supply, capacity, lambda i, j: 0 if i == j else 1)
        assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= capacity[j] for j in range(3))
        assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == sum(supply) - sum(map(min, supply, capacity))
    with pytest.raises(ValueError):
        reshard.min_cost_flow([5], [4], lambda i, j: 0)


def test_reshard_law(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = reshard.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(16))).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(rows["doc_id"]) == sorted(texts)
    assert all(s == len(texts[i].encode()) + 8 and c == zlib.crc32(texts[i].encode()) for i, s, c in zip(rows["doc_id"], rows["size"], rows["text_crc32"], strict=True))
    loads = rows.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert loads.max() - loads.min() <= rows["size"].max()
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in rows.groupby("shard"))


def test_awkward_reshard(awkward, nothing):
    rows = reshard.reshard(awkward, F.lit(None).cast("int"), old_shards=2, new_shards=3).toPandas()
    assert len(rows) == awkward.count() and rows["size"].min() == 8
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in rows.groupby("shard"))
    assert reshard.reshard(nothing, F.lit(0)).count() == 0


def _plan(docs, old, **sizes):
    slim, plan = reshard.plan_reshard(docs, old, **sizes)
    return reshard.assigned(slim, plan).toPandas(), plan


def test_rewrite_leaves_other_shards_alone(spark, tmp_path):
    rows = [(k, f"text {k} " + "x" * (k % 40), k % 4, k) for k in range(400)] + [(None, "no id", 1, -1), (None, "no id", 1, -2), (7, "text 7 " + "x" * 7, 3, -3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, new_slot int, shard int").withColumns({n: F.lit(n) for n in ("__key", "__file", "__first", "__size")})
    old = F.when(F.col("doc_id") < 60, 0).when(F.col("doc_id") < 160, 1).otherwise(2)
    path = str(tmp_path / "store")
    plan = reshard.Plan(8, 3, [0] * 8 + [1] * 8 + [2] * 8, [0] * 24, [1, 1, 1], 0, 0, [0, 1, 2])
    reshard.rewrite_affected(docs, old, plan, path)  # the old layout
    spark.range(1000).withColumn("new_shard", F.lit(99)).write.partitionBy("new_shard").mode("append").parquet(path)
    want, plan = _plan(docs, old, old_shards=3, new_shards=3, blocks_per_shard=8)
    names = reshard.rewrite_affected(docs, old, plan, path)
    assert names == ("new_shard", "new_slot_")
    stored = spark.read.option("mergeSchema", True).parquet(path).toPandas()
    assert (stored["new_shard"] == 99).sum() == 1000
    stored = stored[stored["new_shard"] != 99]
    assert sorted(stored["shard"]) == sorted(r[3] for r in rows)
    assert all((stored[n] == n).all() for n in ("__key", "__file", "__first", "__size"))
    assert dict(zip(stored["shard"], stored["new_slot"], strict=True)) == {r[3]: r[2] for r in rows}
    key = lambda f, shard, slot: sorted((str(a), int(b), int(c)) for a, b, c in zip(f["doc_id"].astype("Int64"), f[shard], f[slot], strict=True))
    assert key(stored, "new_shard", "new_slot_") == key(want, "shard", "slot")
    assert plan.moved_bytes >= 0.9 * plan.least_bytes and sum(plan.shard_bytes) == want["size"].sum()


def test_rewrite_empties_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t" * 50) for k in range(100)], "doc_id long, text string")
    path = str(tmp_path / "store")
    for new in (4, 2):
        _, plan = _plan(docs, F.pmod("doc_id", F.lit(4)).cast("int"), old_shards=4, new_shards=new, blocks_per_shard=16)
        if new == 4:
            plan.changed = [0, 1, 2, 3]
        reshard.rewrite_affected(docs, F.pmod("doc_id", F.lit(4)).cast("int"), plan, path)
    assert {2, 3} <= set(plan.changed)
    assert sorted(r["doc_id"] for r in spark.read.parquet(path).collect()) == list(range(100))


def test_reshard_query_reads_its_files(spark):
    from chatguard.llm import queries as Q

    rows = Q.op6_flow_reshard(spark, DATA).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sorted(rows["doc_id"]) == sorted(docs) and all(c == zlib.crc32(docs[i].encode()) for i, c in zip(rows["doc_id"], rows["text_crc32"], strict=True))
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in rows.groupby("shard"))
    moved = rows.loc[rows["shard"] != rows["old_shard"], "size"].sum() / rows["size"].sum()
    assert 0.3 < moved < 0.6


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.keep(stage(spark, docs, DATA), name)
        seen.append((name, before, docs.count()))
        if name != "packing":
            assert docs.columns == want
    assert [n for n, _, _ in seen] == ["toxicity", "near-duplicates", "benchmark", "mixing", "packing"]
    assert all(after <= before for _, before, after in seen[:3]) and all(after < before for _, before, after in seen[1:3])
    assert docs.agg(F.max("n_tokens")).first()[0] <= 2048


def test_pipeline_takes_awkward_rows(spark, awkward, nothing, tmp_path):
    folder = str(tmp_path)
    for name, rows in (("documents", awkward), ("labels", awkward.select("doc_id", F.lit(None).cast("int").alias("toxic"))), ("benchmark", nothing.select(F.col("doc_id").alias("item_id"), "text"))):
        rows.write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    mixed = corpus_pipeline.mix_sources(spark, awkward.withColumns({"__words": F.lit("mine"), "__copy": F.lit("own")}), folder)
    assert {(r["__words"], r["__copy"]) for r in mixed.collect()} == {("mine", "own")}
