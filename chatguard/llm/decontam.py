"""Benchmark decontamination: shared word pairs find passages, Smith-Waterman alignment scores them.

A word pair is two words side by side or with one word between, so that one replaced, added or lost word leaves
a pair of its neighbours. An alignment that reaches the least score must keep a known number of such pairs
within a known stretch, whatever words were edited; every stretch that does is aligned word by word.

A benchmark of a bounded number of pairs is one broadcast index, and texts are aligned where they are read. A larger
one is a table of pairs that joins the texts' pairs, behind bit filters of fixed size; nothing of it passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatguard.llm.store import keep, released
from chatguard.llm.words import mix, word_hashes

SEED = 4
_FILTER_BITS = 23
_ENTRIES = 1 << 21  # pairs of a benchmark that is broadcast; a larger one is joined
_ROWS = 1 << 21  # index hits looked at in one go
_JOIN_BITS, _MAP_BITS = 26, 15  # bits of the filters of joined pairs (8 MB each), of one of Spark's bitmaps
_HOT, _SALTS = 64, 16  # pairs of one filter bit from which they are salted, and into how many
_BLOCK = 1024  # words of a text that travel together


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _pairs(hashes: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of the ordered word pairs (k, k + apart)."""
    return mix(hashes[:-apart] * np.uint64(0x9E3779B97F4A7C15) + hashes[apart:])


def _items(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ids, texts = frame.iloc[:, 0].tolist(), frame.iloc[:, 1].tolist()
        for first, _, hashes, counts in word_hashes(texts):
            at = np.cumsum(counts) - counts
            rows = [(ids[first + k], hashes[at[k] : at[k] + counts[k]].view(np.int64)) for k in range(len(counts)) if counts[k] >= max(n, 2)]
            yield pd.DataFrame(rows, columns=["item_id", "words"])


def limits(lengths: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, need, reach) of items of these lengths: pairs that an alignment keeps, pairs asked for, its most words.

    An alignment of m matches and e errors scores 2 m - e >= t = 2 least L for an item of L words, so at most
    e / 2 <= m - t / 2 of its m - 1 steps between matches hold two errors or more: t / 2 - 1 steps are pairs, at
    different places of the item and of the text. It covers at most m + e <= 3 L - t words. An item leaves out
    the pairs - need places whose pairs most items share, and asks for so many fewer.
    """
    pairs = np.maximum(1, np.ceil(least * lengths - 1 - 1e-9)).astype(np.int64)
    return pairs, (pairs + 1) // 2, np.ceil((3 - 2 * least) * lengths).astype(np.int64)


def holds(own: np.ndarray, words: np.ndarray, pairs: int) -> bool:
    """Whether a stretch keeps as many pairs and words of the item's own as the least score takes."""
    there = np.concatenate([_pairs(words, 1), _pairs(words, 2)])
    shared = np.isin(_pairs(own, 1), there)
    shared[:-1] |= np.isin(_pairs(own, 2), there)
    return int(shared.sum()) >= pairs and int(np.isin(own, words).sum()) > pairs


class Index:
    """Word pairs of the items of a bounded benchmark."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: float):
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        lengths = np.array([len(w) for w in self.words])
        self.pairs, self.need, self.reach = limits(lengths, least)
        grams = np.concatenate([_pairs(w, apart) for w in self.words for apart in (1, 2)])
        owner = np.repeat(np.arange(len(items)), 2 * lengths - 3)
        place = np.concatenate([np.arange(n - apart) for n in lengths for apart in (1, 2)])
        known, which, held = np.unique(grams, return_inverse=True, return_counts=True)
        begin = np.cumsum(lengths) - lengths
        common = np.zeros(int(lengths.sum()), dtype=np.int64)
        np.add.at(common, begin[owner] + place, held[which])
        of = np.repeat(np.arange(len(items)), lengths)
        last = begin + lengths - 1
        common[last] = -1
        order = np.lexsort((-common, of))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - begin[of]
        kept = rank >= (self.pairs - self.need)[of]
        keep_row = kept[begin[owner] + place]
        entry = np.unique(np.stack([which[keep_row], owner[keep_row]], axis=1), axis=0)
        used, counts = np.unique(entry[:, 0], return_counts=True)
        self.grams, self.counts, self.owner = known[used], counts, entry[:, 1]
        self.first = np.cumsum(counts) - counts
        self.table = np.packbits(np.bincount(_slot(self.grams), minlength=1 << _FILTER_BITS) > 0)


def stretches(index: Index, table: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, low, high): word bounds of the stretches of each text that may hold an item."""
    owner, begin = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    at, which = [], []
    for apart in (1, 2):
        if len(hashes) <= apart:
            continue
        grams = _pairs(hashes, apart)
        hit = np.flatnonzero(table[_slot(grams)] & (owner[:-apart] == owner[apart:]))
        gram = np.searchsorted(index.grams, grams[hit])
        same = index.grams[np.minimum(gram, len(index.grams) - 1)] == grams[hit]
        at.append(hit[same])
        which.append(gram[same])
    if not at:
        return
    order = np.argsort(np.concatenate(at), kind="stable")
    at, which = np.concatenate(at)[order], np.concatenate(which)[order]
    total, longest = np.cumsum(index.counts[which]), int(index.reach.max())
    start = 0
    while start < len(at):
        # Slices overlap by the longest reach, so that no stretch is parted.
        stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + _ROWS)), int(np.searchsorted(at, at[start] + 2 * longest)), start + 1)
        part, row = at[start:stop], which[start:stop]
        n = index.counts[row]
        entry = np.repeat(index.first[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keys = np.unique(index.owner[entry].astype(np.int64) << 40 | np.repeat(part, n))
        item, place = keys >> 40, keys & ((1 << 40) - 1)
        to = np.arange(len(keys)) + index.need[item] - 1
        inside = np.minimum(to, len(keys) - 1)
        good = (to < len(keys)) & (item[inside] == item) & (owner[place[inside]] == owner[place]) & (place[inside] - place < index.reach[item])
        held: tuple[int, int, int, int] | None = None
        for i, g in zip(item[good].tolist(), place[good].tolist(), strict=True):
            k, reach = int(owner[g]), int(index.reach[i])
            low, high = max(0, g - int(begin[k]) - reach), min(int(counts[k]), g - int(begin[k]) + reach + 1)
            if held is not None and held[:2] == (k, i) and low <= held[3]:
                held = (k, i, held[2], high)
                continue
            if held is not None:
                yield held
            held = (k, i, low, high)
        if held is not None:
            yield held
        start = len(at) if stop >= len(at) else max(start + 1, int(np.searchsorted(at, at[stop] - longest)))


def smith_waterman(item: np.ndarray, window: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of item in window; the earliest end, then the latest start."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        slope = gap * np.arange(len(b) + 1)
        last = np.zeros(len(b) + 1, dtype=np.int64)
        top, end = 0, 0
        for word in a:
            step = np.maximum(last[1:] - gap, last[:-1] + np.where(b == word, match, mismatch))
            row = np.concatenate([[0], np.maximum(step, 0)])
            last = np.maximum.accumulate(row + slope) - slope
            j = int(last.argmax())
            if last[j] > top or last[j] == top and j < end:
                top, end = int(last[j]), j
        return top, end

    score, end = best(item, window)
    if not score:
        return 0, 0, 0
    _, back = best(item[::-1], window[:end][::-1])
    return score, end - back, end


def _aligned(frames: Iterator[pd.DataFrame], index: Index, least: float) -> Iterator[pd.DataFrame]:
    table = np.unpackbits(index.table).astype(bool)
    for frame in frames:
        ids, texts, rows = frame.iloc[:, 0].tolist(), frame.iloc[:, 1].tolist(), []
        for first, _, hashes, counts in word_hashes(texts):
            begin = np.cumsum(counts) - counts
            for k, i, low, high in stretches(index, table, hashes, counts):
                part, item = hashes[begin[k] + low : begin[k] + high], index.words[i]
                if holds(item, part, int(index.pairs[i])):
                    score, start, end = smith_waterman(item, part)
                    share = score / (2 * len(item))
                    if share >= least:
                        rows.append((ids[first + k], index.ids[i], share, low + start, low + end))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "start_word", "end_word"])


def _item_pairs(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for item, words in zip(frame["item"].tolist(), frame["words"], strict=True):
            own = np.array(words, dtype=np.int64).view(np.uint64)
            pairs, need, reach = (int(x[0]) for x in limits(np.array([len(own)]), least))
            for apart in (1, 2):
                grams = _pairs(own, apart).view(np.int64)
                rows.append(pd.DataFrame({"gram": grams, "item": item, "place": np.arange(len(grams)), "spare": pairs - need, "need": need, "reach": reach}))
        if rows:
            yield pd.concat(rows)


def seed_table(items: DataFrame, least: float) -> DataFrame:
    """(gram, item, need, reach) of the places that each item keeps: its rarest among all items."""
    schema = "gram long, item long, place int, spare int, need int, reach int"
    pairs = keep(items.mapInPandas(released(lambda x: _item_pairs(x, least)), schema), "bench-pairs")
    shared = pairs.groupBy("gram").agg(F.count("*").alias("held"))
    common = F.sum("held").over(Window.partitionBy("item", "place"))
    rank = F.dense_rank().over(Window.partitionBy("item").orderBy(F.desc("common"), "place"))
    ranked = pairs.join(shared, "gram").repartition("item").withColumn("common", common).withColumn("rank", rank)
    return keep(ranked.filter("rank > spare").select("gram", "item", "need", "reach").distinct(), "bench-seeds")


def _bit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _hits(frames: Iterator[pd.DataFrame], held: Broadcast) -> Iterator[pd.DataFrame]:
    some, hot = (np.frombuffer(x, dtype=np.uint8) for x in held.value)
    for frame in frames:
        ids = frame["doc_id"].to_numpy()
        for first, _, hashes, counts in word_hashes(frame["text"].tolist()):
            owner, begin = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
            for apart in (1, 2):
                if len(hashes) <= apart:
                    continue
                grams = _pairs(hashes, apart)
                slot = (grams >> np.uint64(64 - _JOIN_BITS)).astype(np.int64)
                at = np.flatnonzero(_bit(some, slot) & (owner[:-apart] == owner[apart:]))
                salt = np.where(_bit(hot, slot[at]), (ids[first + owner[at]] + at) % _SALTS, 0)
                yield pd.DataFrame({"doc_id": ids[first + owner[at]], "gram": grams[at].view(np.int64), "salt": salt, "place": at - begin[owner[at]]})


def _blocks(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for first, _, hashes, counts in word_hashes(frame["text"].tolist()):
            begin = np.cumsum(counts) - counts
            rows = [(frame["doc_id"].iat[first + k], frame["version"].iat[first + k], j // size, hashes[begin[k] + j : begin[k] + min(j + size, n)].view(np.int64)) for k, n in enumerate(counts.tolist()) for j in range(0, n, size)]
            yield pd.DataFrame(rows, columns=["doc_id", "version", "block", "words"])


def _scored(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, item, begin, part, own in zip(frame["doc_id"], frame["item_id"], frame["begin"], frame["part"], frame["words"], strict=True):
            part, own = (np.array(x, dtype=np.int64).view(np.uint64) for x in (part, own))
            if holds(own, part, int(limits(np.array([len(own)]), least)[0][0])):
                score, start, end = smith_waterman(own, part)
                if score / (2 * len(own)) >= least:
                    rows.append((doc, item, score / (2 * len(own)), begin + start, begin + end))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "start_word", "end_word"])


def _joined(source: DataFrame, items: DataFrame, least: float, schema: str) -> DataFrame:
    """Alignments by a join of pairs, for a benchmark of any size.

    Texts send the pairs that a filter of the benchmark's pairs lets through. Pairs of a filter bit that many items
    share are salted on both sides. Hits are counted by (text, item, stretch), never gathered; a stretch is as many
    words as an alignment covers at most, counted with its successor. Only the blocks of words that such stretches
    touch travel to the alignment, and items are laid out once for each salt, so that one item in a third of all
    texts is many tasks.
    """
    spark, size = source.sparkSession, _BLOCK
    seeds = seed_table(items, least).withColumn("slot", F.shiftrightunsigned("gram", 64 - _JOIN_BITS))
    filled = seeds.groupBy("slot").agg(F.count("*").alias("n"))
    position = F.expr(f"bitmap_construct_agg(slot % {1 << _MAP_BITS})"), F.expr(f"bitmap_construct_agg(slot % {1 << _MAP_BITS}) filter (where n >= {_HOT})")
    maps = filled.groupBy(F.shiftright("slot", _MAP_BITS).alias("part")).agg(position[0].alias("some"), position[1].alias("hot")).collect()  # 2,048 rows of 8 kB at most
    bits = [bytearray(1 << _JOIN_BITS - 3) for _ in range(2)]
    width = 1 << _MAP_BITS - 3
    for row in maps:
        for whole, name in zip(bits, ("some", "hot"), strict=True):
            if row[name] is not None:
                whole[row["part"] * width : (row["part"] + 1) * width] = row[name]
    held = spark.sparkContext.broadcast(tuple(bytes(x) for x in bits))
    hits = source.mapInPandas(released(lambda x: _hits(x, held)), "doc_id long, gram long, salt int, place int")
    busy = filled.filter(F.col("n") >= _HOT).select("slot", F.lit(_SALTS - 1).alias("last"))
    salted = seeds.join(busy, "slot", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))))).drop("slot", "last")
    stretch = F.floor(F.col("place") / F.col("reach"))
    counted = hits.join(salted, ["gram", "salt"]).withColumn("stretch", F.explode(F.array(stretch - 1, stretch))).groupBy("doc_id", "item", "stretch", "need", "reach").count()
    near = keep(counted.filter(F.col("count") >= F.col("need")).select("doc_id", "item", "stretch", "reach"), "bench-near")
    held.destroy()
    low, high = F.greatest(F.lit(0), (F.col("stretch") - 1) * F.col("reach")), (F.col("stretch") + 2) * F.col("reach")
    touched = near.withColumn("block", F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))).withColumn("block", F.col("block").cast("int"))
    texts = source.join(near.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("version", F.xxhash64("text"))
    blocks = texts.mapInPandas(released(lambda x: _blocks(x, size)), "doc_id long, version long, block int, words array<long>").distinct()
    parts = touched.join(blocks, ["doc_id", "block"]).groupBy("doc_id", "version", "item", "stretch").agg(F.sort_array(F.collect_list(F.struct("block", "words"))).alias("parts"))
    pieces = parts.select("doc_id", "item", (F.col("parts")[0]["block"] * size).alias("begin"), F.flatten("parts.words").alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int").alias("salt"))
    laid = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return pieces.join(laid, ["item", "salt"]).select("doc_id", "item_id", "begin", "part", "words").mapInPandas(released(lambda x: _scored(x, least)), schema)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.5, n: int = SEED, most_broadcast: int = _ENTRIES) -> DataFrame:
    """One row for each (doc_id, item_id) whose alignment reaches `least` of the item's full score.

    score is the local alignment score (match 2, mismatch and gap -1) over twice the item's words: 1 for a
    verbatim copy, about 1 - 1.5 e with a share e of words replaced. start_word and end_word bound the best
    passage. Every pair of text and item that reaches `least` is found (an item of fewer than 2 / least words
    only if two of its words stand at most one apart): the pairs of words asked for follow from the score.
    A benchmark of up to `most_broadcast` word pairs (about 27,000 items of 38 words) is broadcast, under 80 MB of arrays;
    a larger one is joined as a table, with the same scores.
    Items of fewer than n words (two at least) and rows with a null id or text take no part; ids must cast to long;
    repeated ids give one row with the best score. Empty tables give an empty result; other columns are not read.
    No document, seed or partner is capped.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null")
    items = items.mapInPandas(released(lambda x: _items(x, n)), "item_id long, words array<long>").distinct()
    items = keep(items.withColumn("item", F.monotonically_increasing_id()), "bench-items")
    schema = "doc_id long, item_id long, score double, start_word int, end_word int"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    total = items.agg(F.sum(2 * F.size("words"))).first()[0]
    if total is None:
        found = docs.sparkSession.createDataFrame([], schema)
    elif total <= most_broadcast:
        rows = items.orderBy("item_id", "words").collect()  # most_broadcast pairs at most
        held = docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], np.array(r["words"], dtype=np.int64).view(np.uint64)) for r in rows], least))
        found = source.mapInPandas(released(lambda x: _aligned(x, held.value, least)), schema)
    else:
        found = _joined(source, items, least, schema)
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct(F.col("score"), -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows whose id holds a benchmark item; all columns of any names stay, rows with a null id too."""
    gone = "__bad" + "_" * max(map(len, docs.columns))  # longer than any column's name
    bad = keep(contaminated_pairs(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias(gone)).distinct(), "bench-bad")
    small = bad.count() * 16 <= 32 << 20
    return docs.join(F.broadcast(bad) if small else bad, docs[doc_id].cast("long") == bad[gone], "left_anti")
