"""Repeated passages, the prefix trie and clusters against plain loops, on random and awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import DATA, canonical, tables
from hypothesis import given, settings
from hypothesis import strategies as st

from chatguard.llm import anchors, orchard, prefixtrie
from chatguard.llm.queries import ORACLE_SQL, QUERIES

WINDOW = 20


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_orchard_clusters"])
def test_query_equals_sql(spark, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), tables(DATA).execute(ORACLE_SQL[name]).df()
    assert len(got) and canonical(got) == canonical(want)


# Passages ---------------------------------------------------------------------------------------------------------


def plain_passages(rows, window=WINDOW):
    """{(id, text): (words, kept)} by one pass over every window of every document in order."""
    seen, out = set(), {}
    for key in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        words = (key[1] or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if (w := tuple(words[p : p + window])) in seen:
                gone[p : p + window] = [True] * window
            seen.add(w)
        out[key] = (len(words), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return out


def check_passages(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed string")
    got = anchors.remove_repeats(docs, **how).collect()
    want = plain_passages(rows, how.get("window", WINDOW))
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for (i, _), v in want.items():
        by_id[i].append(v)
    for r in got:
        assert (r["n_words"], r["kept_text"]) in by_id[r["doc_id"]]
        assert r["n_words"] - r["n_removed"] == len(r["kept_text"].encode().split())
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
    return {(r["doc_id"], r["kept_text"]) for r in got}


def test_passages_equal_plain_loop_on_pieced_texts(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 70))) for _ in range(40)]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(150)]
    check_passages(spark, rows, chunks=7, buckets=4)


def test_passages_cross_chunks_of_one_document_each(spark):
    rng = random.Random(6)
    words = [f"w{n}" for n in range(5000)]
    shared = rng.sample(words, 60)
    rows = []
    for i in range(40):
        own = rng.sample(words, 90)
        cut = rng.randint(0, 40)
        rows.append((i, " ".join(own[:cut] + shared[rng.randint(0, 10) : rng.randint(25, 60)] + own[cut:])))
    check_passages(spark, rows, chunks=64, buckets=16)


def test_passages_of_19_20_and_21_words(spark):
    base = [f"v{n}" for n in range(60)]
    rows = [(1, " ".join(base))] + [(10 + n, " ".join(["x%d" % n, *base[7 : 7 + n], "y%d" % n])) for n in (19, 20, 21, 40)]
    check_passages(spark, rows, chunks=3, buckets=2)
    got = {r["doc_id"]: r["n_removed"] for r in anchors.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunks=3, buckets=2).collect()}
    assert got == {1: 0, 29: 0, 30: 20, 31: 21, 50: 40}


def test_passages_of_one_repeating_word_and_of_copies(spark):
    rows = [(1, "a " * 300), (2, "a " * 30), (3, "a " * 19), *[(10 + n, " ".join(f"c{k}" for k in range(50))) for n in range(30)]]
    check_passages(spark, rows, chunks=5, buckets=2)


def test_passages_with_other_window_and_case_and_signs(spark):
    rows = [(1, "A b, c. d A b, c. d"), (2, "a b, c. d"), (3, "b, c. d A"), (4, "é ß ☃ b, c."), (5, "é ß ☃ b, c.")]
    check_passages(spark, rows, window=4, chunks=2, buckets=2)


def test_passages_hash_long_texts_in_pieces(monkeypatch):
    import pandas as pd

    text = " ".join(f"word{n % 77}" for n in range(900)) + " " + "z" * 500 + " end"
    frame = pd.DataFrame({"chunk": [0], "doc_id": [1], "no_id": [False], "rank": [1], "text": [text]})
    whole = anchors.Chunk(frame, WINDOW)
    whole.hash()
    monkeypatch.setattr(anchors, "_PIECE", 64)
    pieced = anchors.Chunk(frame, WINDOW)
    pieced.hash()
    assert whole.counts.tolist() == pieced.counts.tolist() == [902]
    assert (whole.words == pieced.words).all()


def test_passages_of_awkward_rows(spark, awkward, nothing):
    assert anchors.remove_repeats(nothing, chunks=2, buckets=2).count() == 0
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in anchors.remove_repeats(awkward, chunks=4, buckets=2).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 60001, 59999), (5, 6, 0), (6, 6, 0), (None, 5, 0), (8, 2, 0), (9, 1, 0)}
    # A null id comes after every other, and rows that repeat id and text are one document.
    long = " ".join(f"k{n}" for n in range(25))
    rows = spark.createDataFrame([(None, long), (7, long), (7, long)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in anchors.remove_repeats(rows, chunks=2, buckets=2).collect()) == [(0, 25), (7, 0), (7, 0)]


# Trie -------------------------------------------------------------------------------------------------------------


def plain_trie(rows, block=20, spread=4):
    """The contract's definition by dictionaries: {(smallest member, depth): figures}."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % spread
        made[c] = tuple(own.get(c - c % block, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, who in members.items():
        gain = (len(who) - 1) * len(n[-1][1].encode().split()) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += gain
    out = set()
    for n, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(n))))
        out.add((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check_trie(spark, rows, parts):
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, part string")
    got = prefixtrie.prefix_trie(frame, parts=parts).collect()
    assert all(list(r.asDict()) == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"] for r in got)
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_trie(rows)


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 3), (3, 9), (4, 30)])
def test_trie_equals_plain_definition(spark, seed, parts):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["yes", "no", "a b c", "", None])) for c in rng.sample(range(400), 120) for t in range(rng.randint(1, 7))]
    rng.shuffle(rows)
    check_trie(spark, rows, parts)


def test_trie_of_long_shared_beginnings_over_many_parts(spark):
    rng = random.Random(7)
    rows = []
    for c in range(90):
        length = rng.randint(30, 45)
        rows += [(c, t, "user", f"turn {t}" if t < length - rng.randint(0, 2) else f"own {c % 7}") for t in range(length)]
    check_trie(spark, rows, 12)


def test_trie_of_copies_and_of_sequences_that_extend_each_other(spark):
    rows = [(c, t, "u", "same text") for c in range(0, 300) for t in range(1 + c % 5)]
    check_trie(spark, rows, 5)


def test_trie_of_awkward_rows(spark):
    rows = [(None, 1, "u", "lost"), (5, None, None, None), (5, 2, "u", "x"), (5, 2, "u", "x"), (5, 2, "a", "y"), (-7, 0, "u", "neg"), (40, 1, "u", ""), (41, 3, "u", "word " * 5000)]
    check_trie(spark, rows, 3)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(empty).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "u", "t")], empty.schema)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.sets(st.lists(st.integers(0, 2), max_size=6).map(tuple), min_size=1, max_size=25))
def test_forest_has_every_branching_prefix(sequences):
    ordered = sorted(sequences)
    shared = [prefixtrie._shared(list(a), list(b)) for a, b in zip(ordered, ordered[1:], strict=False)]
    forest = prefixtrie.Forest([len(s) for s in ordered], shared)
    got = {ordered[forest.some[v]][: forest.depth[v]] for v in forest.nodes()}
    below = defaultdict(set)
    for s in ordered:
        for d in range(len(s)):
            below[s[:d]].add(s[d])
    assert got == {n for n in {s[:d] for s in ordered for d in range(len(s) + 1)} if n in sequences or len(below[n]) > 1}
    assert len(forest.nodes()) == len(got)


def test_member_lists_stream_through_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "_PIECE", 8)
    rows = [(c, 0, "u", "t") for c in (*range(0, 200, 20), *range(20000, 20400, 20))]
    check_trie(spark, rows, 2)


# Clusters ---------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None))[:k]
    cent = [np.array(v, dtype=np.int64) for _, v in first]
    place = lambda v: min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[place(v)[1]].append(v)
        for n, own in groups.items():
            cent[n] = np.array([int(s) // len(own) for s in np.sum(own, axis=0)])
    at = [(i, *place(v)[::-1]) for i, v in kept]
    spread = Counter()
    for _, n, d in at:
        spread[n] += d
    return sorted(((i if i is not None else -1), n, d, spread[n], sum(spread.values()), cent[n].tolist()) for i, n, d in at)


def check_clusters(spark, rows, k=4, rounds=5, dim=3):
    frame = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    got = orchard.cluster_vectors(frame, k=k, rounds=rounds, dim=dim).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], list(r["centroid"])) for r in got) == plain_clusters(rows, k, rounds, dim)


def test_clusters_equal_plain_rounds_with_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) / 4 for _ in range(3)]) for i in range(200)]
    rows += [(300 + i, [0.5, 0.5, 0.5]) for i in range(80)] + [(7, [1.0, 0.0, 0.0]), (None, [2.0, 2.0, 2.0])]
    check_clusters(spark, rows, k=9)


def test_clusters_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None, 2.0]), (5, [1.0, nan, 2.0]), (6, [1.0, inf, 2.0])]
    check_clusters(spark, [*bad, (8, [0.1, -0.2, 0.3]), (9, [0.1, -0.2, 0.3])])
    check_clusters(spark, [(8, [0.1, -0.2, 0.3])], k=1)
    assert orchard.cluster_vectors(spark.createDataFrame(bad, "vec_id long, embedding array<float>"), dim=3).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=20))
def test_orchard_finds_the_nearest_with_ties_to_the_smaller_number(centroids, points):
    found, far, _ = orchard.Orchard([list(c) for c in centroids]).nearest(np.array(points, dtype=np.int64))
    want = [min(((p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2, n) for n, c in enumerate(centroids)) for p in points]
    assert list(zip(far.tolist(), found.tolist(), strict=True)) == want


def test_orchard_skips_far_centroids():
    rng = np.random.default_rng(1)
    centroids = (rng.integers(0, 5, size=(30, 4)) * 1000).astype(np.int64)
    points = centroids[rng.integers(0, 30, size=500)] + rng.integers(-5, 6, size=(500, 4))
    _, _, taken = orchard.Orchard(centroids.tolist()).nearest(points)
    assert taken < 500 * 30 * 0.8
