"""Near duplicates, leaks, packing, toxicity and personal data against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatguard.llm import dartminhash as D, decontam, packing, pii, queries as Q, toxicity
from chatguard.llm.words import ngrams, word_hashes

DATA = "/root/testdata/sf0.001"
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def _docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def _classes(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = _WORD.findall(t.lower())
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w) if w else ("raw", t)])
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            low = sum((sets[a] & sets[b]).values())
            if low and low >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - low):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_words_and_ngrams():
    texts = ["One, two THREE", None, "", "a-b ñandú 7", "x " * 700_000]
    got = {}
    for first, last, hashes, counts in word_hashes(texts):
        for k, part in zip(range(first, last), np.split(hashes, np.cumsum(counts)[:-1]), strict=True):
            got[k] = part
    assert [len(got[k]) for k in range(5)] == [3, 0, 0, 4, 700_000]
    assert len(set(got[4].tolist())) == 1
    (_, _, h, c), = word_hashes(["one two three one two", "three one two"])
    grams, owner, place = ngrams(h, c, 2)
    assert owner.tolist() == [0, 0, 0, 0, 1, 1] and place.tolist() == [0, 1, 2, 3, 0, 1] and grams[0] == grams[3] == grams[5] and grams[2] == grams[4]


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    same = np.where(rng.random(300) < 0.7, a, b)
    marks = D.signatures(np.repeat([0, 1], 300), np.concatenate([base, base]), np.concatenate([a, same]), 2, 4000)
    want = np.minimum(a, same).sum() / np.maximum(a, same).sum()
    assert abs((marks[0] == marks[1]).mean() - want) < 0.03
    one = D.signatures(np.zeros(1, int), base[:1], np.ones(1), 1, 130)
    assert (one != 0).all()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = {r["doc_id"]: r["text"] for r in _docs(spark).collect()}
    passage = [word() for _ in range(60)]
    for k in range(60):  # a passage that many short documents share, with own words around
        texts[10_000 + k] = " ".join([*(word() for _ in range(k % 30)), *passage])
    base = [word() for _ in range(200)]
    for k in range(40):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(200)] = word()
        texts[20_000 + k] = " ".join(copy) if k % 2 else " ".join(copy).upper() + " !"
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["id"]: r["class_id"] for r in D.near_duplicate_classes(frame).collect()}
    assert got == _classes(texts)
    small = {r["id"]: r["class_id"] for r in D.near_duplicate_classes(frame, bands=26, rows=5).collect()}
    assert small == got


def test_large_mixed_buckets_are_dealt_again(spark, monkeypatch):
    """Blocks of four texts make nearly every bucket large; classes must still equal brute force."""
    monkeypatch.setattr(D, "_BLOCK_TEXTS", 4)
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, texts = [word() for _ in range(80)], {}
    for k in range(90):  # many texts share most of a passage: alike in some bands, similar only within their family
        family = random.Random(k // 6)
        own = ["".join(family.choice("abcdefgh") for _ in range(4)) for _ in range(50)]
        if k % 6:
            own[rng.randrange(50)] = word()
        texts[k] = " ".join(passage + own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["class_id"] for r in D.near_duplicate_classes(frame).collect()}
    assert got == _classes(texts) and 10 < len(set(got.values())) < 60


def test_pipeline_stage_settles_pairs_of_a_large_bucket(spark, monkeypatch):
    """Two similar texts that share one bucket, too large for a block and mixed, are one class in the pipeline too."""
    import corpus_pipeline

    body = [f"w{i}" for i in range(100)]
    shared = lambda k: " ".join([*body[: 100 - k], *[f"x{k}_{i}" for i in range(k)]])
    rows = [(k, shared(20 * k)) for k in range(4)] + [(10, shared(60) + " end"), (11, shared(40) + " end")]
    classes, signed = D.near_duplicate_classes, D._signed
    monkeypatch.setattr(D, "_BLOCK_TEXTS", 2)
    monkeypatch.setattr(D, "_signed", lambda frames, bands, n: (f.assign(bands=[np.array([7])] * len(f)) for f in signed(frames, bands, n)))
    monkeypatch.setattr(D, "near_duplicate_classes", lambda *a, **o: classes(*a, bands=1, rows=1, **o))
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("share,least", [(0.01, 0.95), (0.02, 0.9), (0.03, 0.9)])
def test_near_copy_recall(spark, share, least):
    """Copies with a share of their words replaced: all that reach the similarity are found; at 1 % nearly all do, at 2 % two thirds, at 3 % few."""
    rng = random.Random(int(1000 * share))
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    texts = {}
    for k in range(120):
        base = [word() for _ in range(300)]
        texts[2 * k] = " ".join(base)
        texts[2 * k + 1] = " ".join(word() if rng.random() < share else w for w in base)
    want = _classes(texts)
    got = {r["id"]: r["class_id"] for r in D.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    reach = [k for k in range(120) if want[2 * k + 1] == 2 * k]
    assert sum(got[2 * k + 1] == 2 * k for k in reach) >= least * len(reach) and len(reach) >= {0.01: 110, 0.02: 60, 0.03: 5}[share]


def test_signs_part_words():
    def words(text):
        return sum(int(c.sum()) for _, _, _, c in word_hashes([text]))

    assert words("“one”—two…three\u00a0four’s") == 5 and words("ñandú größe été") == 3 and words("价格很高 ok") == 5 and words("« un »") == 1 and words("ａ、ｂ。") == 2


def test_components_with_hot_keys(spark):
    edges = spark.createDataFrame([(k, 0) for k in range(1, 60)] + [(k, k - 1) for k in range(100, 130)], "a long, b long")
    values = spark.createDataFrame([(0, 59, "x"), (1, 1, "y")], "a long, n long, v string")
    rows = spark.createDataFrame([(0, k) for k in range(59)] + [(1, 7)], "a long, k long")
    assert sorted((r["k"], r["v"]) for r in D._by_key(rows, values, ["a"], 60, hot=10).collect()) == sorted([(k, "x") for k in range(59)] + [(7, "y")])
    got = {r["id"]: r["root"] for r in D.components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 60)) and all(got[k] == 99 for k in range(100, 130))


def test_links_within_blocks():
    sets = [(np.array(x, dtype=np.uint64), np.array(w, dtype=float)) for x, w in (([1, 2, 3, 4, 5], [1, 1, 1, 1, 4]), ([1, 2, 3, 4, 5], [1, 1, 1, 1, 4]), ([1, 2, 3, 4, 5], [1, 1, 1, 1, 1]), ([9], [1]))]
    assert D.links_within(sets, [0, 1, 2, 3], 0.8) == [(0, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (300, 100)] + [(1000, k) for k in range(1001, 1100)]
    got = {r["id"]: r["root"] for r in D.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and 0 not in got and got[300] == 100 and all(got[k] == 1000 for k in range(1001, 1100))


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """Whatever the blocks, classes are those of all pairs that share a bucket, one bucket being enough."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    texts = [(k, " ".join(f"x{k}_{i}" if i in changed else w for i, w in enumerate(base + [f"t{k % 7}"] * (k % 7 + 3)))) for k in range(150) for changed in [set(rng.sample(range(120), rng.choice([0, 1, 2, 3, 4])))]]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for bands, rows, block in ((1, 1, 64), (2, 2, 6)):
        signed = pd.concat(D._signed(iter([pd.DataFrame(texts)]), bands, rows))
        sets, root = [D.multiset(t) for _, t in texts], list(range(len(texts)))
        for i, j in itertools.combinations(range(len(texts)), 2):
            if (signed["bands"].iloc[i] == signed["bands"].iloc[j]).any() and D.weighted_jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
        monkeypatch.setattr(D, "_BLOCK_TEXTS", block)
        got = {r["id"]: r["class_id"] for r in D.near_duplicate_classes(frame, bands=bands, rows=rows).collect()}
        assert [got[k] for k, _ in texts] == root, (bands, block)


def test_every_two_classes_of_a_bucket_meet(spark, monkeypatch):
    """Members of different classes share a block pair in buckets of every make-up; none is left out, whatever its bucket's size."""
    monkeypatch.setattr(D, "_BLOCK_TEXTS", 8)
    shapes = {1: [2, 1], 2: [20, 1], 3: [20, 1, 1, 2], 4: [9, 12], 5: [1] * 40, 6: [30, 9, *[3] * 9], 7: [7, 1, 1]}  # sizes of the classes
    rows, n = [], 0
    for key, classes in shapes.items():
        for size in classes:
            rows += [(key, key, -(-sum(classes) // 8), n + k, n, 10) for k in range(size)]
            n += size
    mixed = spark.createDataFrame(rows, "band int, key long, parts int, rep long, root long, words long")
    held = {}
    for r in D._met(mixed).collect():
        held.setdefault(r["id"], set()).add(r["pair"])
    assert set(held) == {r[3] for r in rows}
    for a, b in itertools.combinations(rows, 2):
        assert a[1] != b[1] or a[4] == b[4] or held[a[3]] & held[b[3]], (a, b)


def test_awkward_near_duplicates(awkward, nothing):
    got = [(r["id"], r["class_id"]) for r in D.near_duplicate_classes(awkward).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5), (None, None), (8, 8), (9, 9)], key=str)
    assert sorted(r["doc_id"] or 0 for r in D.keep_one_of_each(awkward).collect()) == [0, 1, 2, 3, 4, 5, 8, 9]
    assert D.near_duplicate_classes(nothing).count() == 0 and D.keep_one_of_each(nothing).count() == 0


def _local(item, window):
    best = (0, 0)
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(window) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == window[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, (h[i][j], -j))
    return best[0], -best[1]


def test_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        score, start, end = decontam.smith_waterman(a, b)
        assert (score, end) == _local(a.tolist(), b.tolist())
        assert 0 <= start <= end


def test_leaks_equal_brute_force(spark):
    docs, bench = _docs(spark), spark.read.parquet(f"{DATA}/benchmark.parquet")
    plain = lambda t: " " + " ".join(_WORD.findall(t.lower())) + " "
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if plain(b["text"]) in plain(d["text"])}
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated_pairs(docs, bench).collect()}
    assert want <= set(got) and want
    assert all(got[p]["score"] == 1.0 for p in want)


def test_edited_leaks(spark):
    rng = random.Random(1)
    item = [f"w{k}" for k in range(40)]
    edited = [w if rng.random() > 0.15 else "zz" for w in item]
    rows = [(1, " ".join(["pre"] * 50 + edited + ["post"] * 50)), (2, " ".join(item[:10])), (3, " ".join(f"v{k}" for k in range(90))), (4, " ".join(item[:25] + ["new", "words"] + item[25:])), (5, None), (None, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["start_word"], r["end_word"]) for r in decontam.contaminated_pairs(docs, bench).collect()}
    assert set(got) == {1, 4} and got[4] == (7, 0, 42) and got[1][0] == 7 and 50 <= got[1][1] < 54
    assert sorted(r["doc_id"] or 0 for r in decontam.decontaminate(docs, bench).collect()) == [0, 2, 3, 5]
    assert decontam.contaminated_pairs(docs, bench.filter("1 = 0")).count() == 0


def test_edited_leaks_equal_plain_alignment(spark):
    rng = random.Random(3)
    common = [f"c{k}" for k in range(6)]
    items = {k: [rng.choice(common) if rng.random() < 0.4 else f"i{k}w{j}" for j in range(n)] for k, n in enumerate((15, 15, 22, 30, 45, 59, 60, 4, 6))}
    rows, d = [(0, [w if k not in (4, 9) else "zz" for k, w in enumerate(items[0])]), (1, [w if k % 5 else "zz" for k, w in enumerate(items[5])])], 2
    rows += [(k + 2, [x for w in items[k] for x in (w, "zz")]) for k in items]
    d += len(items)
    for k, item in items.items():
        for share in (0.1, 0.2, 0.3):
            for _ in range(6):
                copy = []
                for w in item:
                    edit = rng.choice("rda") if rng.random() < share else ""
                    copy += [] if edit == "d" else ["zz", w] if edit == "a" else ["zz"] if edit else [w]
                rows.append((d, [*rng.choices(common, k=rng.randrange(30)), *copy, *rng.choices(common, k=rng.randrange(30))]))
                d += 1
    rows.append((d, [w for k in (3, 4, 5, 6) for w in items[k]]))  # verbatim copies elsewhere
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    want = {(k, i): s / (2 * len(item)) for k, words in rows for i, item in items.items() if (s := _local(item, words)[0]) >= len(item)}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated_pairs(docs, bench).collect()}
    assert got == want and want[0, 0] == 0.8 and (1, 5) in want
    joined = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated_pairs(docs, bench, most_broadcast=0).collect()}
    assert joined == want


def test_leaks_of_a_large_benchmark_by_join(spark, monkeypatch):
    """Stretches over block bounds, rows that share an id, and pairs that nearly all items share, salted."""
    rng = random.Random(8)
    monkeypatch.setattr(decontam, "_BLOCK", 16)
    items = {k: [w for j in range(20) for w in ("of", "the", f"i{k}w{j}")][: 30 + k % 30] for k in range(150)}
    items[150] = [f"long{j}" for j in range(300)]
    rows = [(k, [*["of", "the"] * rng.randrange(40), *items[k], *["the"] * rng.randrange(9)]) for k in range(0, 150, 7)]
    rows += [(3, items[4]), (3, items[5]), (5000, items[150]), (5001, [w for k in range(20) for w in items[k]]), (5002, ["of", "the"] * 3000)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(4, " ".join(items[4]))], "item_id long, text string")
    show = lambda df: {(r["doc_id"], r["item_id"]): (r["score"], r["start_word"], r["end_word"]) for r in df.collect()}
    small, large = (show(decontam.contaminated_pairs(docs, bench, most_broadcast=n)) for n in (1 << 21, 0))
    assert {p: x[0] for p, x in small.items()} == {p: x[0] for p, x in large.items()}
    exact = [p for p in small if small[p][0] == 1.0]
    assert len(exact) >= 45 and all(small[p] == large[p] for p in exact)
    words = decontam._items(iter([pd.DataFrame({"id": list(items), "text": [" ".join(w) for w in items.values()]})]), 4)
    table = spark.createDataFrame([(int(r.item_id), r.words.tolist(), int(r.item_id)) for r in pd.concat(words).itertuples()], "item_id long, words array<long>, item long")
    seeds = decontam.seed_table(table, 0.5)
    index = decontam.Index([(r["item_id"], np.array(r["words"], dtype=np.int64).view(np.uint64)) for r in table.orderBy("item_id").collect()], 0.5)
    assert sorted((r["gram"] & (1 << 64) - 1, r["item"]) for r in seeds.collect()) == sorted(zip(np.repeat(index.grams, index.counts).tolist(), index.owner.tolist(), strict=True))


def test_awkward_leaks(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "same text of six plain words")], "item_id long, text string")
    for most in (1 << 21, 0):
        assert {r["doc_id"] for r in decontam.contaminated_pairs(awkward, bench, most_broadcast=most).collect()} == {5, 6}
        assert decontam.contaminated_pairs(nothing, bench, most_broadcast=most).count() == 0
    clash = awkward.withColumn("__bad", F.lit(5)).withColumn("item_id", F.lit(1))
    left = decontam.decontaminate(clash, bench)
    assert left.columns == clash.columns and left.count() == awkward.filter("doc_id is null or doc_id not in (5, 6)").count()


def test_best_fit_equals_scan():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths, size = rng.integers(1, 33, 200), 32
        room: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room[room.index(min(fits))] -= n
            else:
                room.append(size - n)
        rows = packing.best_fit_decreasing(lengths, size)
        assert sorted(k for r in rows for k in r) == list(range(200))
        assert sorted(size - int(lengths[r].sum()) for r in rows) == sorted(room)


def test_packing_round_trip(spark, awkward, nothing):
    docs = _docs(spark).select("doc_id", "text")
    encoding = packing.load_vocabulary(Q.VOCABULARY)
    rows = packing.pack_documents(docs, Q.VOCABULARY, length=256).collect()
    parts = {}
    for r in rows:
        ids, at, cut = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 256 and cut[0] == 0 and cut[-1] == r["n_tokens"] <= 256
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], cut, cut[1:], strict=False):
            assert (at[a:b] == np.arange(b - a)).all()
            parts[doc, piece] = ids[a:b].tolist()
    for d in docs.collect():
        tokens = [t for _, p in sorted(k for k in parts if k[0] == d["doc_id"]) for t in parts[d["doc_id"], p]]
        assert encoding.decode(tokens) == d["text"]
    assert len({r["seq_id"] for r in rows}) == len(rows)
    got = packing.pack_documents(awkward, Q.VOCABULARY, length=64).select(F.explode("doc_ids").alias("d")).groupBy("d").count().collect()
    assert {r["d"] for r in got} == {3, 4, 5, 6, None, 8, 9}
    assert packing.pack_documents(nothing, Q.VOCABULARY).count() == 0


def test_binary_files(spark, tmp_path):
    rows = packing.pack_documents(_docs(spark).select("doc_id", "text").union(spark.createDataFrame([(None, "no id")], "doc_id long, text string")).repartition(3), Q.VOCABULARY, length=128).cache()
    path = str(tmp_path / "packed")
    files = packing.write_binary(rows, path).collect()
    got = []
    for f in files:
        read = lambda kind, dtype, f=f: np.fromfile(f"{path}/{f['part']}.{kind}", dtype)
        ids, at, cut, docs = read("ids", "<u2"), read("positions", "<u2"), read("cu", "<i4"), read("docs", [("doc", "<i8"), ("piece", "<i4")])
        assert f["row_bytes"] == 256 and len(ids) == len(at) == f["rows"] * 128 and len(docs) == f["segments"] and len(cut) == f["segments"] + f["rows"]
        starts = [*np.flatnonzero(cut == 0).tolist(), len(cut)]
        done = 0
        for r, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            mine = docs[done : done + b - a - 1]
            done += b - a - 1
            got.append((ids[r * 128 : (r + 1) * 128].tobytes(), at[r * 128 : (r + 1) * 128].tobytes(), cut[a:b].tolist(), mine["doc"].tolist(), mine["piece"].tolist()))
    want = [(bytes(r["input_ids"]), bytes(r["position_ids"]), r["cu_seqlens"], [-1 if d is None else d for d in r["doc_ids"]], r["pieces"]) for r in rows.collect()]
    assert sorted(got) == sorted(want) and sum(f["tokens"] for f in files) == sum(r["n_tokens"] for r in rows.collect())
    assert packing.write_binary(rows.filter("1 = 0"), str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        packing.load_vocabulary("/nowhere/ranks")


def test_long_stretches_part_where_tokens_part():
    encoding = packing.load_vocabulary(Q.VOCABULARY)
    text = "some words, in  a row\n" * 9000
    assert "".join(packing._stretches(text)) == text
    assert [t for s in packing._stretches(text) for t in encoding.encode_ordinary(s)] == encoding.encode_ordinary(text)


def test_toxicity_held_out(spark):
    folder = DATA.replace("0.001", "0.1")
    scored = Q.op5_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    rows = scored.select("toxic", "predicted", "score").toPandas()
    assert (rows["toxic"] == rows["predicted"]).mean() > 0.97
    assert rows.loc[rows["toxic"] == 1, "predicted"].mean() > 0.85


def test_toxic_folding_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 3.0, toxicity.fold("trash"): 2.0, toxicity.fold("ass"): 1.0, "reeux*": 1.0})
    texts = ("an 1d10t", "ＩＤＩＯＴ", "іdіоt", "i\u200bdiot", "trash can", "trash here", "midiot", None, "", "@idiot", "|idiot|", "7idiot", "idiots", "idiotic!", "idiotaph", "ass", "assess", "class", "réeuxment", "préeux")
    assert [lexicon.measure(t)[1] for t in texts] == [1, 1, 1, 1, 0, 1, 0, 0, 0, 1, 1, 1, 1, 1, 0, 1, 0, 0, 1, 0]


def test_lexicon_equals_plain_matching():
    rng = random.Random(6)
    terms = {"ab": 1.0, "abc": 2.5, "c*": 0.5, "ca": 4.0, "bca*": 1.5, "b": 0.25}
    lexicon, endings = toxicity.Lexicon(terms, exceptions=()), {"", *map(toxicity.fold, toxicity.ENDINGS)}
    for _ in range(2000):
        text = "".join(rng.choice("abcs  .-") for _ in range(rng.randint(0, 20)))
        found = {}
        for m in re.finditer("[a-z]+", text):
            for k, term in enumerate(terms):
                word = term.rstrip("*")
                if m[0].startswith(word) and (term[-1] == "*" or m[0][len(word):] in endings):
                    found[m.start()] = max(found.get(m.start(), 0), terms[term])
        assert lexicon.measure(text) == (sum(found.values()), len(found)), text


def test_ordinary_prose_is_left_alone(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert not any(k.endswith("*") and len(k) < 5 for k in model.weights) and toxicity.fold("idiot") in model.weights
    subjects = ("The pathway", "An idiom", "Her disguise", "A path through Morocco", "The trash can", "Moral support", "A worthy cause", "This stupendous view", "Losing a key", "A pathologist")
    verbs = ("is worth a visit", "was moved near the wall", "makes the idea worthwhile", "came up in the class", "led to the coast")
    ends = ("in summer.", "for the whole family.", "said the guide.", "on most days.")
    prose = [f"{a} {b} {c}" for a in subjects for b in verbs for c in ends]
    rows = toxicity.score_documents(spark.createDataFrame([(t,) for t in prose], "text string"), model).collect()
    assert len(rows) == 200 and sum(r["toxic_score"] >= 0.5 for r in rows) < 2
    lines = toxicity.score_documents(spark.createDataFrame([("you idiot go home now",), ("you\nidiot\tgo\u00a0home\u2003now",)], "text string"), model).collect()
    assert lines[0]["toxic_score"] == lines[1]["toxic_score"] > 0.5


def test_awkward_toxicity(spark, awkward, nothing):
    labels = spark.createDataFrame([(5, 1), (5, None), (6, 0), (9, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    rows = toxicity.score_documents(awkward.withColumn("toxic_score", F.lit("old")), model)
    assert rows.count() == awkward.count() and all(0 <= r["toxic_score"] <= 1 for r in rows.collect())
    empty = toxicity.train(nothing, labels)
    assert toxicity.score_documents(nothing, empty).count() == 0
    named = toxicity.score_documents(awkward.withColumns({"__said": F.lit("mine"), "a.b": F.lit(1), "Toxic_Hits": F.lit(-1)}), model)
    assert {(r["__said"], r["a.b"]) for r in named.collect()} == {("mine", 1)} and named.columns[-2:] == ["toxic_score", "toxic_hits"] and "Toxic_Hits" not in named.columns


def _plain_base(t: str) -> str:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x // 10 + 2 * x % 10 for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", ".", "1", "255", "4111", " ", "-", "+", "(", ")", "x@y.z", "_", "%", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "é", "٣"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.written(pii.base_spans(t)) == _plain_base(t), t
    for t in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1.1." * 50_000):
        pii.base_spans(t)


def test_network_gradient():
    net, rng = pii.Network(hidden=3, seed=1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, gold = rng.integers(0, pii._CLASSES, (3, 7)).astype(np.int16), rng.integers(0, pii.TAGS, (3, 7))
    _, grad = net.gradient(ids, gold)
    for name, p in net.p.items():
        at = np.unravel_index(np.abs(grad[name]).argmax(), p.shape)
        old, e = p[at], 1e-2
        p[at] = old + e
        up = net.gradient(ids, gold)[0]
        p[at] = old - e
        down = net.gradient(ids, gold)[0]
        p[at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-2, abs=1e-4)


def test_crf_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(4)
    scores, trans, gold = rng.normal(size=(2, 4, 3)) * 3, rng.normal(size=(3, 3)), rng.integers(0, 3, (2, 4))
    loss, d_scores, d_trans = pii.crf_gradient(scores, trans, gold)
    want, w_scores, w_trans = 0.0, np.zeros_like(scores), np.zeros_like(trans)
    for k in range(2):
        paths = list(itertools.product(range(3), repeat=4))
        value = np.array([sum(scores[k, t, p[t]] for t in range(4)) + sum(trans[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        share = np.exp(value - value.max()) / np.exp(value - value.max()).sum()
        want += value.max() + np.log(np.exp(value - value.max()).sum()) - value[paths.index(tuple(gold[k]))]
        for p, w in [*zip(paths, share, strict=True), (tuple(gold[k]), -1.0)]:
            for t in range(4):
                w_scores[k, t, p[t]] += w
            for x, y in itertools.pairwise(p):
                w_trans[x, y] += w
    assert loss == pytest.approx(want) and d_scores == pytest.approx(w_scores) and d_trans == pytest.approx(w_trans)
    full = rng.normal(size=(pii.TAGS, pii.TAGS))
    legal = lambda p: p[0] % 2 == 1 or p[0] == 0
    for _ in range(5):
        row = rng.normal(size=(4, pii.TAGS)) * 2
        best = max((p for p in itertools.product(range(pii.TAGS), repeat=4) if legal(p) and all(b % 2 or b == 0 or a in (b - 1, b) for a, b in itertools.pairwise(p))), key=lambda p: sum(row[t, p[t]] for t in range(4)) + sum(full[a, b] for a, b in itertools.pairwise(p)))
        assert pii.viterbi([row.astype(np.float32)], full)[0].tolist() == list(best)


@pytest.fixture(scope="module")
def network(spark):
    return pii.train(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text"))


def _fresh(rng, kind):
    """A value that no base pattern finds, in spellings of the test's own."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8)))
    if kind == 0:
        return w() + rng.choice([" (at) ", "[at]", " AT ", " at "]) + w() + rng.choice([" dot ", "[dot]", "(dot)"]) + rng.choice(["com", "org"])
    if kind == 1:
        return rng.choice(["[.]", " . ", "(dot)", " dot ", "[dot]"]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        body = rng.choice("3456") + d(14)
        number = next(body + str(k) for k in range(10) if pii.luhn(body + str(k)))
        return rng.choice([".", "/", "  ", "\u2013", "_", " - "]).join(number[k : k + 4] for k in range(0, 16, 4))
    return rng.choice([f"00{d(2)} {d(2)} {d(4)} {d(3)}", f"+{d(2)}/{d(2)}/{d(7)}", f"+{d(1)}\u2013{d(3)}\u2013{d(3)}\u2013{d(4)}", f"+{d(2)} (0){d(2)} / {d(6)}", f"00{d(2)}-{d(3)}-{d(6)}", f"+{d(2)}_{d(3)}_{d(5)}", f"00{d(1)}.{d(3)}.{d(3)}.{d(4)}", f"+{d(2)}\u00a0{d(2)}\u00a0{d(4)}\u00a0{d(3)}"])


@pytest.mark.parametrize("kind,least", [(0, 0.8), (1, 0.95), (2, 0.95), (3, 0.9)])
def test_network_alone_finds_fresh_values(spark, network, kind, least):
    rng = random.Random(kind)
    words = " ".join(r["text"] for r in _docs(spark).orderBy("doc_id").collect() if r["text"]).split()[:20_000]
    texts, values = [], []
    while len(texts) < 120:
        value, k = _fresh(rng, kind), rng.randrange(len(words) - 30)
        text = f"{' '.join(words[k : k + 12])} call {value} {' '.join(words[k + 12 : k + 24])}"
        at = text.index(value)
        if not any(a < at + len(value) and at < b for a, b, _ in pii.base_spans(text)) and not re.search("[0-9@]", " ".join(words[k : k + 24])):
            texts.append(text)
            values.append((at, at + len(value)))
    found = pii.all_spans(texts, network)
    hits = [any(k == kind and abs(a - low) <= 1 and abs(b - high) <= 1 for a, b, k in spans) for (_, spans), (low, high) in zip(found, values, strict=True)]
    assert np.mean(hits) >= least, np.mean(hits)


def test_personal_data(spark, awkward, nothing, network):
    docs = _docs(spark).select("doc_id", "text")
    rows = pii.find_personal_data(docs, network).join(docs, "doc_id").collect()
    assert all(r["base_sha256"] == hashlib.sha256(_plain_base(r["text"]).encode()).hexdigest() for r in rows)
    assert all(set(_plain_base(r["text"]).split(",")) - {""} <= set(r["spans"].split(",")) for r in rows)
    odd = pii.find_personal_data(awkward, network).collect()
    assert len(odd) == awkward.count() and all(r["spans"] == "" for r in odd)
    assert pii.find_personal_data(nothing, network).count() == 0
    assert pii.find_personal_data(nothing, None).count() == 0


def test_personal_data_counts_base_spans_only(spark, network):
    """Counts and digest follow from the text alone; what the network adds stands in spans and n_model."""
    texts = ["mail jo.miller at host dot com or a@b.org and +49 30 1234567 today", "from 10[.]0[.]0[.]7 to 10.0.0.8", "0" * 5000 + "1.2.3.4", "", None]
    rows = [(2**53 + 1 + 2 * k, t) for k, t in enumerate(texts)] + [(None, "x@y.z 1.2.3.4")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), network).collect()}
    assert set(got) == {key for key, _ in rows}
    counts = {key: tuple(got[key][f"n_{k}"] for k in pii.KINDS) for key, _ in rows}
    assert list(counts.values()) == [(1, 0, 0, 1), (0, 1, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (1, 1, 0, 0)]
    assert [got[key]["n_model"] for key, _ in rows] == [1, 1, 0, 0, 0, 0]
    assert got[2**53 + 1]["spans"].startswith("email:5:30,email:34:41") and "ip:0:5007" in got[2**53 + 5]["spans"]


def test_disguised_addresses(network):
    names = ("jo.miller", "anna_k7", "r.stone", "peter.lindgren", "a.very.long_local-part.of.some.person")
    for spelling in ("{}(AT)host.com", "{} [AT] host.org", "{}{{at}}host.net", "{}<at>host.com", "{} at host dot com", "{} (at) host.com"):
        values = [spelling.format(n) for n in names]
        texts = [f"the order of the word and {v} in the house" for v in values]
        found = [[t[a:b] for a, b, k in spans if k == 0] for t, (_, spans) in zip(texts, pii.all_spans(texts, network), strict=True)]
        assert np.mean([f == [v] for f, v in zip(found, values, strict=True)]) >= 0.8, (spelling, found)


SPELLINGS = (
    "{} at {} dot com", "{} AT {} DOT org", "{} At {} Dot com", "{} at {}[dot]net", "{} at {} (dot) com", "{}[at]{}.com", "{} [at] {}.org", "{} [AT] {} [DOT] com", "{}(at){}.net", "{} (at) {}.com",
    "{} (at) {} (dot) de", "{}{{at}}{}.com", "{} {{at}} {}{{dot}}com", "{}<at>{}.com", "{} <at> {} <dot> org", "{} @ {}.com", "{}@{}[.]com", "{}@{} dot com", "{}@{}(dot)com", "{} @ {} . com", "{}\uff20{}.com",
    "{} at {} dot co dot uk", "{}@{} [dot] info", "{} at {} DOT com",
)


@pytest.mark.parametrize("spelling", SPELLINGS)
def test_every_spelling_of_an_address_is_found(network, spelling):
    """48 shapes of each: names of four lengths with and without marks, hosts of three, four ends of the sentence."""
    rng, hits = random.Random(spelling), []
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for n in (3, 5, 7, 9):
        for h in (4, 6, 8):
            for end in ("{} is mine", " write to {} today", "mail {}", "the list says {} and more words follow here."):
                value = spelling.format(word(n) if rng.randrange(3) else f"{word(n)}.{word(3)}", word(h))
                text = ("ordinary text that goes before it, " + end).format(value)
                low = text.index(value)
                hits.append((low, low + len(value), 0) in pii.all_spans([text], network)[0][1])
    assert np.mean(hits) >= 0.9, np.mean(hits)


def test_prose_with_at_and_lists_of_numbers_hold_no_value(network):
    for text in ("Meet me at noon dot and bring the of the", "ratio 1,2,3,4 of the mix", "matrix 12, 34, 56, 78", "look at the dot", "of the dot the com", "version 10 20 30 40 50"):
        assert pii.all_spans([text], network)[0][1] == [], text


def test_values_in_digits_of_other_scripts(network):
    for kind, value in ((2, "\uff14\uff15\uff13\uff19 \uff15\uff17\uff18\uff17 \uff16\uff13\uff16\uff12 \uff11\uff14\uff18\uff16"), (1, "\u0661\u0660.\u0662\u0660.\u0663\u0660.\u0664\u0660")):
        text = f"some words and then {value} and more words"
        assert [(text[a:b], k) for a, b, k in pii.all_spans([text], network)[0][1]] == [(value, kind)]
    assert pii.ascii_form("a\uff20b\u0663") == "a@b3"


def test_a_saved_network_finds_the_same(network, tmp_path):
    network.save(str(tmp_path / "n.npz"))
    again, text = pii.Network.load(str(tmp_path / "n.npz")), "write to jomiller at host dot com today"
    assert pii.all_spans([text], again) == pii.all_spans([text], network) and again.p["x"].shape == network.p["x"].shape


def test_skipped_stretches_hold_no_value(network):
    """Decoding only the stretches keeps what decoding whole texts keeps."""
    rng = random.Random(12)
    words = "the order of a word and in our house at noon with some people by then".split()
    texts = []
    for _ in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(100, 300))]
        for _ in range(rng.randint(0, 3)):
            body.insert(rng.randrange(len(body)), _fresh(rng, rng.randrange(4)))
        texts.append(" ".join(body))
    some = pii.all_spans(texts, network)
    cut = pii.stretches
    try:
        pii.stretches = lambda text, margin: [(0, len(text))]
        whole = pii.all_spans(texts, network)
    finally:
        pii.stretches = cut
    a, b = ({(k, *x) for k, (_, spans) in enumerate(rows) for x in spans} for rows in (some, whole))
    assert a == b and len(a) > 20
    assert pii.stretches("x " * 500, 96) == [] and pii.stretches("look at it " * 50, 96) == [] and pii.stretches("y " * 200 + "7" + " y" * 200, 96) == [(304, 497)]


def test_address_spellings():
    for value in ("a.b@c.de", "a (AT) b.com", "a[At]b(DOT)com", "a{at}b.com", "a <at> b.co.uk", "a at b dot com", "a AT b.c DOT com"):
        assert pii.holds_value(0, value), value
    assert not any(pii.holds_value(0, v) for v in ("look at b.com", "meet at noon", "a(bat)b.com", "a at b"))
    text = "x long.local.part(at)host.com y"
    assert pii.grown(text, [(7, 27, 0)]) == [(2, 29, 0)]
    assert pii.grown(text, [(2, 5, 1), (7, 27, 0)])[1] == (5, 29, 0)


def test_long_stretch_is_decoded_as_a_whole():
    network = pii.Network()
    text = "12 " * 20_000
    (found,) = pii.model_spans([text], network)
    assert all(0 <= a < b <= len(text) for a, b, _ in found)
