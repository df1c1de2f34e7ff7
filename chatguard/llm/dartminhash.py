"""Near-duplicate classes of documents: DartMinHash signatures, banded joining, exact checks, components.

A document is the weighted set of its five-word shingles (weight: occurrences; a shorter text is one shingle).
For every element, darts arrive in the weight regions [0,1), [1,2), [2,4), ... at a rate equal to the region's
width; each dart has a hashed rank, weight position and coordinate and hits if its position lies below the
element's weight. The earliest hit of each coordinate is the signature, so two documents agree in a coordinate
with the probability of their weighted Jaccard similarity. Only the first k (ln k + c) / total weight of the
rank axis is thrown at first, so the darts per document do not grow with its length.

Exact copies collapse before anything is compared. Every member of a bucket is compared with its shortest one,
which settles groups of near copies in about as many comparisons as members. Buckets that then still hold several
classes are compared in full, whatever their size, but for pairs within a large class. Comparisons run in blocks of
bounded size inside a task: intersections of all shingle sets of two blocks come from one matrix product, and only
links between different classes leave the task. A bucket of n members of which m stand outside its large classes
takes about m n comparisons.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatguard.llm.store import keep, released
from chatguard.llm.words import _powers, mix, ngrams, word_hashes

SHINGLE = 5
# A block pair holds the shingles of 2 x 2^18 words and a square of 2,048 texts: about 150 MB in a task.
_BLOCK_TEXTS, _BLOCK_WORDS = 1024, 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)
_UNIT = 2.0**-53


def elements(hashes: np.ndarray, counts: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, weight) of each distinct shingle of each text, sorted by text and shingle."""
    grams, owner, _ = ngrams(hashes, counts, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first, _ = sequence_keys(hashes, counts)
        grams, owner = np.concatenate([grams, first[short]]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], grams[at], np.diff([*at, len(grams)]).astype(np.float64)


def sequence_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of the whole word sequence of each text (0 for a text without words)."""
    full = np.flatnonzero(counts > 0)
    out = np.zeros((2, len(counts)), dtype=np.uint64)
    if len(full):
        start = (np.cumsum(counts) - counts)[full]
        up, _ = _powers(int(counts.max()) + 1)
        power = up[np.arange(len(hashes)) - np.repeat(start, counts[full])]
        for row, salt in enumerate((np.uint64(0), _SALT)):
            out[row, full] = mix(np.add.reduceat((mix(hashes ^ salt) if row else hashes) * power, start) + counts[full].astype(np.uint64))
    return out[0], out[1]


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """(texts, k) dart values; rows of texts without elements are 0."""
    total = np.bincount(owner, weights=weight, minlength=texts)
    out = np.zeros((texts, k), dtype=np.uint64)
    reach = np.where(total > 0, (np.log(k) + 3) * k / np.maximum(total, 1e-300), 0)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        hit, rank, value = _throw(owner[mine], element[mine], weight[mine], reach, k)
        late_first = np.argsort(-rank, kind="stable")
        seen = np.zeros(texts * k, dtype=bool)
        got = np.zeros(texts * k, dtype=np.uint64)
        got[hit[late_first]] = value[late_first]
        seen[hit] = True
        done = seen.reshape(texts, k).all(axis=1) & todo
        out[done] = got.reshape(texts, k)[done]
        todo &= ~done
        reach = reach * 2
    return out


def _throw(owner, element, weight, reach, k):
    """All darts that hit within reach: (text * k + coordinate, rank, value)."""
    regions = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(owner)), regions)
    region = np.arange(len(at)) - np.repeat(np.cumsum(regions) - regions, regions)
    low = np.where(region == 0, 0.0, 2.0 ** (region - 1))
    width = np.maximum(low, 1.0)
    key = mix(element[at] + region.astype(np.uint64) * _SALT)
    text, top, limit = owner[at], weight[at], reach[owner[at]]
    rank, round_ = np.zeros(len(at)), 0
    hits, ranks, values = [], [], []
    while len(key):
        m = 1 if len(key) > 4096 else 64
        dart = mix(key[:, None] + np.arange(round_ + 1, round_ + m + 1, dtype=np.uint64) * _STEP)
        when = rank[:, None] + np.cumsum(-np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) * _UNIT), axis=1) / width[:, None]
        row, col = np.nonzero(when <= limit[:, None])
        value = dart[row, col]
        place = mix(value ^ _SALT)
        position = low[row] + (place >> np.uint64(11)).astype(np.float64) * _UNIT * width[row]
        good = position < top[row]
        coordinate = ((mix(value + _SALT) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        hits.append((text[row] * k + coordinate.astype(np.int64))[good])
        ranks.append(when[row, col][good])
        values.append(value[good])
        rank, round_ = when[:, -1], round_ + m
        live = rank <= limit
        key, text, top, limit, low, width, rank = key[live], text[live], top[live], limit[live], low[live], width[live], rank[live]
    return np.concatenate(hits), np.concatenate(ranks), np.concatenate(values)


def _signed(frames: Iterator[pd.DataFrame], bands: int, rows: int) -> Iterator[pd.DataFrame]:
    factor = _powers(rows + 1)[0][1 : rows + 1]
    for frame in frames:
        ids, texts = frame.iloc[:, 0].to_numpy(), frame.iloc[:, 1].tolist()
        for first, last, hashes, counts in word_hashes(texts):
            one, two = sequence_keys(hashes, counts)
            for k in np.flatnonzero(counts == 0):
                digest = hashlib.md5((texts[first + k] or "").encode("utf-8", "replace") + (b"\0null" if texts[first + k] is None else b"")).digest()
                one[k], two[k] = np.frombuffer(digest, dtype=np.uint64)
            owner, grams, weight = elements(hashes, counts)
            marks = signatures(owner, grams, weight, len(counts), bands * rows).reshape(-1, bands, rows)
            keys = mix((marks * factor).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
            yield pd.DataFrame({"id": ids[first:last], "words": counts, "one": one.view(np.int64), "two": two.view(np.int64), "bands": [x if c else None for x, c in zip(keys, counts, strict=True)]})


def multiset(text: str) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(shingles in order, weights, sequence keys) of one text."""
    parts = [(h, c) for _, _, h, c in word_hashes([text])]
    hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.array([len(hashes)])
    one, two = sequence_keys(hashes, counts)
    _, grams, weight = elements(hashes, counts)
    return grams, weight, (int(one.view(np.int64)[0]), int(two.view(np.int64)[0]))


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Sum of smaller over sum of larger weights."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum() if len(common) else 0.0
    whole = a[1].sum() + b[1].sum() - low
    return float(low / whole) if whole else 0.0


def _compared(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by hub, the hub's own text first: its shingles are held while its partners pass by."""
    hub, held = None, None
    for frame in frames:
        out: list[tuple[int, int]] = []
        for now, kind, other, text, one, two in frame[["hub", "kind", "id", "text", "one", "two"]].itertuples(index=False):
            if now != hub:
                hub, held = now, None
            mine = multiset(text)
            if mine[2] != (one, two):
                continue
            if kind == 0:
                held = mine
            elif held is not None and weighted_jaccard(held, mine) >= least:
                out.append((other, hub))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id on an edge (a, b) but the roots; root is the smallest id of its component.

    Alternating large-star and small-star rounds over edges that always point from a larger to a smaller id;
    a node's edges are never gathered, only their minimum. Rounds grow with the logarithm of the longest path.
    """
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(now):
        total = 2 * now.count()  # from the files' footers
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _by_key(both, low, ["a"], total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        less = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _by_key(large, less, ["a"], total)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(less.select("a", F.col("m").alias("b")))
        now = keep(small.filter("a <> b").distinct(), "edges")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id points to one root and no root points on: then the components are done."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def _small(df: DataFrame, rows: int, bound_bytes: int = 32 << 20, row_bytes: int = 16) -> DataFrame:
    """Broadcast a side whose counted size is below the bound; beyond it Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= bound_bytes else df


def _by_key(rows: DataFrame, values: DataFrame, key: list[str], total: int, hot: int = 1 << 20) -> DataFrame:
    """rows (total of them) joined with values, which has each key once and in n the number of its rows.

    Keys of more than `hot` rows are broadcast: there are at most rows / hot of them, a millionth of the table. A
    table of fewer rows has no such key.
    """
    if total <= hot:
        return rows.join(values, key)
    often = F.broadcast(values.filter(F.col("n") > hot))
    rest = rows.join(often.select(*key), key, "left_anti").join(values.filter(F.col("n") <= hot), key)
    return rows.join(often, key).unionByName(rest)


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = 26, rows: int = 5) -> DataFrame:
    """(id, class_id) for every row of docs: class_id is the smallest id of its near-duplicate class.

    Classes are the components of weighted Jaccard similarity >= least over five-word shingles; texts of equal
    words are always one class, texts without words only if equal, null texts with each other. Ids are unique
    longs; a row with a null id gets a null class. Repeated rows fall in one class. A pair at similarity s shares a
    bucket with probability 1 - (1 - p)^bands, p = s^rows (0.99997 at 0.8 with the defaults); no bucket is too large for
    all its pairs to be settled. What is found is checked exactly. Only doc_id and text are read, whatever other columns
    are named. Empty tables give none.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = keep(docs.filter("id is not null").mapInPandas(released(lambda x: _signed(x, bands, rows)), "id long, words long, one long, two long, bands array<long>"), "dart-signatures")
    copies = keep(signed.groupBy("one", "two").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("words").alias("words"), F.any_value("bands").alias("bands")), "dart-copies")
    buckets = copies.filter("bands is not null").select(F.posexplode("bands").alias("band", "key"), "rep", "words")
    shortest = buckets.groupBy("band", "key").agg(F.min(F.struct("words", "rep")).alias("hub"), F.count("*").alias("n"), F.sum("words").alias("total")).filter("n > 1")
    parts = _parts(F.col("n"), F.col("total"))
    members = keep(buckets.join(shortest, ["band", "key"]).select("band", "key", "rep", "words", F.col("hub.rep").alias("hub"), parts.alias("parts")), "dart-buckets")
    keyed = copies.select("rep", "one", "two")
    labels = members.select(F.col("rep").alias("id"), F.col("rep").alias("root")).distinct()
    pairs = members.filter("rep <> hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    labels = _joined(labels, keep(_verified(docs, keep(pairs, "dart-pairs"), keyed, least), "dart-links"))
    marked = members.join(labels.withColumnRenamed("id", "rep"), "rep")
    mixed = marked.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band", "key")
    mixed = keep(marked.join(mixed, ["band", "key"], "left_semi").select("band", "key", "parts", "rep", "root", "words"), "dart-mixed")
    labels = _joined(labels, keep(_cross_checked(docs, _met(mixed), keyed, least), "dart-cross"))
    classes = copies.select("one", "two", "rep", "n").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("one", "two", "n", F.coalesce("root", "rep").alias("class_id"))
    out = _by_key(signed.select("id", "one", "two"), classes, ["one", "two"], signed.count()).select("id", "class_id")
    return out.unionByName(docs.filter("id is null").select("id", F.lit(None).cast("long").alias("class_id")))


def _parts(n: F.Column, words: F.Column) -> F.Column:
    """Blocks that n texts with so many words are dealt into."""
    return F.greatest(F.ceil(n / _BLOCK_TEXTS), F.ceil(words / _BLOCK_WORDS)).cast("int")


def _met(mixed: DataFrame) -> DataFrame:
    """(pair, id, root): every member of a mixed bucket once for each block pair it is compared in.

    A bucket of one block is one pair. A larger one is dealt into parts: a class of half a block or more has parts of its
    own, all other members share the rest. Every two parts meet, but not two of one class, which have nothing to join;
    a meeting compares all that is in both parts. So any two members of different classes meet at least once.
    """
    small = mixed.filter("parts = 1").select(F.xxhash64("band", "key").alias("pair"), F.col("rep").alias("id"), "root")
    large = mixed.filter("parts > 1")
    sizes = large.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("words").alias("total"))
    sizes = sizes.withColumn("own", (2 * F.col("n") >= _BLOCK_TEXTS) | (2 * F.col("total") >= _BLOCK_WORDS))
    rest = [F.coalesce(F.sum(F.when(~F.col("own"), F.col(c))), F.lit(0)) for c in ("n", "total")]
    alone = F.collect_list(F.when(F.col("own"), F.struct("root", _parts(F.col("n"), F.col("total")).alias("parts"))))
    deals = sizes.groupBy("band", "key").agg(alone.alias("alone"), _parts(*rest).alias("rest"))

    def parts(own: bool, root: F.Column, count: F.Column) -> F.Column:
        numbers = F.filter(F.sequence(F.lit(0), count), lambda i: i < count)
        return F.transform(numbers, lambda i: F.struct(F.lit(own).alias("own"), root.alias("root"), i.alias("part")))

    every = F.concat(F.flatten(F.transform("alone", lambda x: parts(True, x["root"], x["parts"]))), parts(False, F.lit(0).cast("long"), F.col("rest")))
    deals = keep(deals.withColumn("every", every), "dart-deals")
    mine = F.get(F.filter("alone", lambda x: x["root"] == F.col("root")), F.lit(0))
    count = F.coalesce(F.col("mine.parts"), F.col("rest"))
    spot = F.struct(F.col("mine").isNotNull().alias("own"), F.coalesce("mine.root", F.lit(0)).alias("root"), F.pmod(F.xxhash64("rep"), count).cast("int").alias("part"))
    # Large buckets are few, and their parts are about as many as their members by a block.
    placed = large.join(_small(deals, deals.count(), row_bytes=256), ["band", "key"]).withColumn("mine", mine).withColumn("spot", spot)
    others = F.filter("every", lambda p: (p != F.col("spot")) & ~(p["own"] & (p["own"] == F.col("spot.own")) & (p["root"] == F.col("spot.root"))))
    meets = F.transform(others, lambda p: F.xxhash64("band", "key", F.least(p, F.col("spot")), F.greatest(p, F.col("spot"))))
    return keep(small.unionByName(placed.select(F.explode(meets).alias("pair"), F.col("rep").alias("id"), "root")), "dart-met")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, root) after links (a, b) between ids: only the links' roots go through the components."""
    if links.isEmpty():
        return labels
    roots = [labels.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    between = links.join(roots[0], "a").join(roots[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = components(between).select(F.col("id").alias("root"), F.col("root").alias("over"))
    return keep(labels.join(found, "root", "left").select("id", F.coalesce("over", "root").alias("root")), "dart-labels")


def links_within(sets: list[tuple[np.ndarray, np.ndarray]], roots: list[int], least: float) -> list[tuple[int, int]]:
    """Positions (i, j) of pairs at the similarity that join different roots; exact, at most one for each join.

    sets: (shingles, weights). All intersections come from products of 0/1 matrices over shared elements,
    where the second occurrence of a shingle is an element of its own.
    """
    total = np.array([w.sum() for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), [int(t) for t in total])
    element = np.concatenate([mix(np.repeat(g, w.astype(np.int64)) + _occurrence(w) * _STEP) for g, w in sets])
    _, inverse, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    column = (np.cumsum(count > 1) - 1)[inverse[shared]]
    owner, width = owner[shared], int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, width, 2048):
        low, high = np.searchsorted(column, [first, first + 2048])
        matrix = np.zeros((len(sets), min(2048, width - first)), dtype=np.float32)
        matrix[owner[low:high], column[low:high] - first] = 1
        common += matrix @ matrix.T
    group = np.unique(np.array(roots), return_inverse=True)[1]
    rows = []
    for k, n in enumerate(total):  # a row at a time, so that no second square stands beside the first
        whole = n + total - common[k]
        near = np.flatnonzero((common[k] >= least * whole - 1e-6) & (group != group[k]))
        rows.append((np.full(len(near), k), near))
    i, j = (np.concatenate(side) for side in zip(*rows, strict=True))
    parent = list(range(group.max() + 1))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(int(group[x])), top(int(group[y]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _occurrence(weight: np.ndarray) -> np.ndarray:
    n = weight.astype(np.int64)
    return (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)


def _crossed(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by block pair: the shingle sets of one pair of blocks are held and compared as a whole."""
    now, ids, roots, sets = None, [], [], []

    def done() -> pd.DataFrame:
        pairs = links_within(sets, roots, least) if len(set(roots)) > 1 else []
        return pd.DataFrame([(ids[i], ids[j]) for i, j in pairs], columns=["a", "b"], dtype="int64")

    for frame in frames:
        for key, other, root, text, one, two in frame[["pair", "id", "root", "text", "one", "two"]].itertuples(index=False):
            if key != now:
                if ids:
                    yield done()
                now, ids, roots, sets = key, [], [], []
            grams, weight, keys = multiset(text)
            if keys == (one, two):
                ids.append(other)
                roots.append(root)
                sets.append((grams, weight))
    if ids:
        yield done()


def _cross_checked(docs: DataFrame, sent: DataFrame, keyed: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between different classes of the same bucket; a block pair is compared in one task, which holds it only."""
    wanted = keep(sent.select("id").distinct(), "dart-wanted")
    rows = wanted.count()
    texts = docs.join(_small(wanted, rows), "id", "left_semi").join(_small(keyed.join(wanted.withColumnRenamed("id", "rep"), "rep", "left_semi"), rows, row_bytes=40).withColumnRenamed("rep", "id"), "id")
    dealt = sent.join(texts, "id").select("pair", "id", "root", "text", "one", "two").repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInPandas(released(lambda x: _crossed(x, least)), "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, keyed: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity. Each text is sent once for each pair, a hub's once for each part."""
    count = pairs.count()
    part = F.pmod(F.xxhash64("a"), F.lit(64)).cast("int")
    sent = pairs.select(F.col("b").alias("hub"), part.alias("part"), F.lit(1).alias("kind"), F.col("a").alias("id"))
    sent = keep(sent.unionByName(pairs.select(F.col("b").alias("hub"), part.alias("part"), F.lit(0).alias("kind"), F.col("b").alias("id")).distinct()), "dart-sent")
    wanted = sent.select("id").distinct()
    texts = docs.join(_small(wanted, 2 * count), "id", "left_semi")
    texts = texts.join(_small(keyed.join(wanted.withColumnRenamed("id", "rep"), "rep", "left_semi"), 2 * count, row_bytes=40).withColumnRenamed("rep", "id"), "id")
    rows = sent.join(texts, "id").select("hub", "part", "kind", "id", "text", "one", "two")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return rows.mapInPandas(released(lambda x: _compared(x, least)), "a long, b long")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without those rows whose id is not the smallest of its near-duplicate class; all columns stay.

    Rows with a null id stay. Of rows that repeat an id one stays, the same in every run.
    """
    classes = keep(near_duplicate_classes(docs, doc_id, text, **options).filter("id is not null"), "dart-classes")
    gone = classes.filter("id <> class_id").select(F.col("id").alias("__gone")).distinct()
    again = classes.groupBy("id").count().filter("count > 1")
    if not again.isEmpty():
        # Of rows that repeat an id the one with the smallest hash stays, whichever task reads it.
        known = dict(docs.dtypes)
        mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not known[c].startswith(("map", "variant"))])
        nth = Window.partitionBy("__id").orderBy("__mark")
        keyed = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__mark": mark})
        held = keyed.join(_small(again.select(F.col("id").alias("__id")), again.count()), "__id", "left_semi")
        one = held.withColumn("__n", F.row_number().over(nth)).filter("__n = 1")
        rest = keyed.join(_small(again.select(F.col("id").alias("__id")), again.count()), "__id", "left_anti")
        docs = one.select(*[f"`{c}`" for c in docs.columns]).unionByName(rest.select(*[f"`{c}`" for c in docs.columns]))
    return docs.join(_small(gone, gone.count()), docs[doc_id].cast("long") == F.col("__gone"), "left_anti")
