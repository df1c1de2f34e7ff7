"""The prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

Conversations of one sequence of turns collapse first. The distinct sequences are sorted across range partitions; two
neighbours share a prefix of some length, which is an edge. Inside a partition the edges are taken in descending
depth: an edge joins the components of its ends, and the join is a branching node at that depth. What a partition
knows of a node that also reaches into a neighbouring partition (a prefix of its first or last sequence no longer
than what that neighbour shares) is a partial row: the forest contracts to these, which are then added up by prefix.
All figures add: members, leaves, children that begin in the partition, and (members - 1) x words where the -1 is
charged to the partition in which the node begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatguard.llm.store import keep

_PIECE = 4096  # ids in one piece of a list of members
_NONE = hashlib.sha256(b"").hexdigest()
_NODES = "part int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, open boolean"
_COLUMNS = [c.split()[0] for c in _NODES.split(", ")]


def _turns(conversations: DataFrame) -> DataFrame:
    """(c, turns): the turns of every conversation in order, as structs of a 16-byte hash of (role, text) and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    slim = conversations.select(F.col("conv_id").cast("long").alias("c"), F.struct(F.col("turn").cast("long").alias("turn"), F.unhex(said).alias("hash"), words.alias("words")).alias("t")).filter("c is not null")
    return slim.groupBy("c").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["hash"].alias("hash"), t["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 20, spread: int = 4) -> DataFrame:
    """(c, turns) where the first h turns are those of conversation c - c % block; h = crc32(decimal c) % spread."""
    own = keep(_turns(conversations), "trie-turns")
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % spread).cast("int")
    base = F.col("c") - F.col("c") % block
    heads = own.filter(F.col("c") == base).select(F.col("c").alias("b"), F.slice("turns", 1, spread - 1).alias("head"))
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(turns, 1, 0)"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.withColumns({"h": h, "b0": base}).join(heads, F.col("b0") == F.col("b"), "left").select("c", F.concat(first, rest).alias("turns"))


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's pieces, which come in order and are not held."""
    key, sha = None, None
    for frame in frames:
        out = []
        for k, piece in zip(frame["key"], frame["piece"], strict=True):
            if k != key:
                if key is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        yield pd.DataFrame(out, columns=["key", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "ends"])


def _classes(convs: DataFrame) -> DataFrame:
    """(key, hashes, words, n, low, ends): one row for each distinct sequence of turns, with its members' digest.

    Members are listed in pieces of at most 4,096 ids, made in parallel; one task streams the pieces of a sequence.
    """
    hashes = F.transform("turns", lambda t: t["hash"])
    key = F.unhex(F.md5(F.array_join(F.transform(hashes, lambda x: F.hex(x)), "")))
    rows = keep(convs.select("c", key.alias("key"), hashes.alias("hashes"), F.transform("turns", lambda t: t["words"]).alias("words")), "trie-convs")
    facts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.first("hashes").alias("hashes"), F.first("words").alias("words"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
    pieces = rows.groupBy("key", F.floor(F.col("c") / _PIECE).alias("at")).agg(listed.alias("piece"))
    dealt = pieces.repartition("key").sortWithinPartitions("key", "at").select("key", "piece")
    return facts.join(dealt.mapInPandas(_digests, "key binary, ends string"), "key")


def _shared(a: list[bytes], b: list[bytes]) -> int:
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


class Forest:
    """The branching nodes of sorted distinct sequences; node i < n is the end of sequence i, later ones are merges."""

    def __init__(self, sizes: list[int], edges: list[int]):
        """sizes: lengths of the sequences; edges[i]: what sequences i and i + 1 share."""
        self.depth = list(sizes)
        self.parent = [-1] * len(sizes)
        self.some = list(range(len(sizes)))  # a sequence that begins with the node's prefix
        self.same = list(range(len(sizes)))  # the node that an absorbed node has become
        joined = list(range(len(sizes)))  # union-find over sequences
        top = list(range(len(sizes)))  # the node above all of a component, by root
        for i in sorted(range(len(edges)), key=lambda i: -edges[i]):
            a, b, d = _root(joined, i), _root(joined, i + 1), edges[i]
            x, y = sorted((top[a], top[b]))
            if self.depth[x] == d and self.depth[y] == d:
                node, self.same[y] = x, x  # one prefix; the smaller number may be the end of a sequence and stays
            elif self.depth[x] == d or self.depth[y] == d:
                node, child = (x, y) if self.depth[x] == d else (y, x)
                self.parent[child] = node
            else:
                node = len(self.depth)
                self.depth.append(d)
                self.parent.append(-1)
                self.some.append(i)
                self.same.append(node)
                self.parent[x] = self.parent[y] = node
            joined[b] = a
            top[a] = node
        self.same = [_root(self.same, v) for v in range(len(self.depth))]
        self.parent = [self.same[p] if p >= 0 else -1 for p in self.parent]

    def nodes(self) -> list[int]:
        """Nodes that were not absorbed, deepest first."""
        return sorted((v for v in range(len(self.depth)) if self.same[v] == v), key=lambda v: -self.depth[v])


def _keys(sequence: list[bytes], upto: int) -> list[bytes]:
    """The key of every prefix of up to `upto` turns."""
    running, out = hashlib.md5(b"root"), []
    for k in range(upto + 1):
        out.append(running.digest())
        if k < upto:
            running.update(sequence[k])
    return out


def _part_nodes(part: int, rows: pd.DataFrame, before: list[bytes] | None, after: list[bytes] | None) -> pd.DataFrame:
    """All nodes of one partition; those that a neighbour shares are marked open and hold this partition's share."""
    seqs = [list(x) for x in rows["hashes"]]
    words, n, low, ends = [list(x) for x in rows["words"]], rows["n"].tolist(), rows["low"].tolist(), rows["ends"].tolist()
    last = len(seqs) - 1
    # -1: no neighbour, so that not even the root is shared.
    left, right = (-1 if x is None else _shared(x, y) for x, y in ((before, seqs[0]), (after, seqs[last])))
    forest = Forest([len(s) for s in seqs], [_shared(seqs[i], seqs[i + 1]) for i in range(last)])
    size = len(forest.depth)
    members, least, leaves, saved, children = np.zeros(size, np.int64), [None] * size, np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    holds_first, holds_last = np.zeros(size, bool), np.zeros(size, bool)
    for i in range(last + 1):
        v = forest.same[i]
        members[v], least[v] = n[i], low[i]
        holds_first[v], holds_last[v] = i == 0, i == last
    own_end = {forest.same[i]: ends[i] for i in range(last + 1)}
    first_keys, last_keys = _keys(seqs[0], max(left, 0)), _keys(seqs[last], max(right, 0))
    inner = {forest.parent[v] for v in forest.nodes()}
    if right == len(seqs[last]):
        inner.add(forest.same[last])  # the next partition begins with an extension of the last sequence
    made: dict[int, list] = {}  # by node: its chain, deepest first, as (depth, children, saved)
    for v in forest.nodes():
        leaves[v] += v not in inner
        up, seq = forest.parent[v], forest.some[v]
        top = forest.depth[up] if up >= 0 else -1
        chain, kids = [], int(children[v])
        for d in range(forest.depth[v], top, -1):
            begins = not (holds_first[v] and d <= left)
            saved[v] += (members[v] - begins) * words[seq][d - 1] if d else 0
            chain.append((d, kids, int(saved[v])))
            kids = int(begins)
        made[v] = chain
        if up >= 0:
            members[up] += members[v]
            least[up] = least[v] if least[up] is None else min(least[up], least[v])
            leaves[up] += leaves[v]
            saved[up] += saved[v]
            children[up] += kids
            holds_first[up] |= holds_first[v]
            holds_last[up] |= holds_last[v]

    def key_of(v: int, d: int) -> bytes | None:
        """The key of a node that a neighbour shares."""
        if holds_first[v] and d <= left:
            return first_keys[d]
        return last_keys[d] if holds_last[v] and d <= right else None

    out = []
    for v, chain in made.items():
        up = forest.parent[v]
        for at, (d, kids, sub) in enumerate(chain):
            above = None if d == 0 else v if at + 1 < len(chain) else up
            key = key_of(v, d)
            parent_key = key_of(above, d - 1) if above is not None else None
            parent = None if above is None or parent_key is not None else least[above]
            end = own_end.get(v, _NONE) if at == 0 else _NONE
            out.append((part, key, parent_key, least[v], d, parent, int(members[v]), kids, int(leaves[v]), sub, end, key is not None))
    frame = pd.DataFrame(out, columns=_COLUMNS)
    frame["parent_conv_id"] = frame["parent_conv_id"].astype("Int64")
    return frame


def prefix_trie(conversations: DataFrame, block: int = 20, spread: int = 4, parts: int | None = None) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations, the textless root among them.

    conversations: conv_id, turn (both cast to long), role, text; other columns are not read, whatever their names.
    Turns go by turn, null first; turns of one number by the hash of role and text, so repeated rows are repeated
    turns. Null role or text is empty. Rows with a null conv_id take no part. An empty table gives an empty result.
    The 16-byte turn hashes of one conversation are held together (24 bytes a turn); texts are not moved.
    parts: range partitions of the sorted sequences (default: the session's shuffle partitions).
    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens long, ends_sha256 string.
    """
    classes = _classes(rebuilt(conversations, block, spread))
    spark = conversations.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.repartitionByRange(n, "hashes").sortWithinPartitions("hashes")
    ordered = keep(dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("ord"), "hashes", "words", "n", "low", "ends"), "trie-sorted")
    # One row a partition: its own ends and those of its neighbours.
    edge = ordered.groupBy("part").agg(F.min_by("hashes", "ord").alias("first"), F.max_by("hashes", "ord").alias("last"))
    line = Window.orderBy("part")
    edge = edge.select("part", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))

    def nodes(key: tuple, rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("ord")
        lists = [None if around[c].iloc[0] is None else list(around[c].iloc[0]) for c in ("before", "after")]
        return _part_nodes(int(key[0]), own, *lists)

    found = keep(ordered.groupBy("part").cogroup(edge.groupBy("part")).applyInPandas(nodes, _NODES), "trie-nodes")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    shares = found.filter("open")
    ends: Column = F.coalesce(F.max(F.when(F.col("ends_sha256") != _NONE, F.col("ends_sha256"))), F.lit(_NONE))
    merged = keep(shares.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in figures], ends.alias("ends_sha256")), "trie-merged")
    known = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    # Closed nodes meet their parent within their partition, so that the many children of one prefix stay spread.
    near = shares.select("part", "key").join(merged.select("key", F.col("conv_id").alias("above")), "key").select("part", F.col("key").alias("parent_key"), "above")
    columns = ["conv_id", "depth", "parent_conv_id", *figures, "ends_sha256"]
    closed = found.filter("not open")
    inside = closed.filter("parent_key is null").select(*columns)
    under = closed.filter("parent_key is not null").drop("parent_conv_id").join(near, ["part", "parent_key"]).withColumnRenamed("above", "parent_conv_id").select(*columns)
    across = merged.join(known, "parent_key", "left").withColumnRenamed("above", "parent_conv_id").select(*columns)
    return inside.unionByName(under).unionByName(across)
