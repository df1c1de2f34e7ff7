"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes.

Documents are grouped into blocks (old shard x hash of id and text); only block totals reach the driver, and their
number is bounded by the parameters. A min-cost flow over old and new shards says how many bytes each old shard
sends where (staying is free); blocks then follow the flow, largest first, and slots come from block offsets.
The files of every shard that gains or loses rows are then rewritten, all others are left alone.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatguard.llm.store import free_name, keep


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Units sent from each supply node to each sink at least total cost (successive cheapest augmenting paths)."""
    m, n = len(supply), len(capacity)
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Cheapest paths from any node with supply left, over forward arcs and arcs that give flow back.
        dist: dict[tuple[str, int], float] = {("a", i): 0 for i in range(m) if left[i]}
        back: dict[tuple[str, int], tuple[str, int]] = {}
        changed = True
        while changed:
            changed = False
            for i in range(m):
                if (base := dist.get(("a", i))) is not None:
                    for j in range(n):
                        if base + cost(i, j) < dist.get(("b", j), float("inf")):
                            dist[("b", j)], back[("b", j)], changed = base + cost(i, j), ("a", i), True
            for j in range(n):
                if (base := dist.get(("b", j))) is not None:
                    for i in range(m):
                        if flow[i][j] and base - cost(i, j) < dist.get(("a", i), float("inf")):
                            dist[("a", i)], back[("a", i)], changed = base - cost(i, j), ("b", j), True
        ends = [j for j in range(n) if room[j] and ("b", j) in dist]
        if not ends:
            raise ValueError("the capacities hold less than the supplies")
        end = min(ends, key=lambda j: (dist[("b", j)], j))
        path = [("b", end)]
        while path[-1] in back:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], room[end])
        for x, y in zip(path, path[1:], strict=False):
            if x[0] == "b":
                amount = min(amount, flow[y[1]][x[1]])
        for x, y in zip(path, path[1:], strict=False):
            if x[0] == "a":
                flow[x[1]][y[1]] += amount
            else:
                flow[y[1]][x[1]] -= amount
        left[path[0][1]] -= amount
        room[end] -= amount
    return flow


def place_blocks(blocks: list[tuple[int, int, int]], old_shards: int, new_shards: int) -> tuple[dict[tuple[int, int], int], int]:
    """(old, block) -> new shard for blocks (old, block, bytes), and the bytes that the flow moves at least.

    Blocks follow the flow's transfers; whole blocks do not fit them to the byte, so a few moves then even out.
    """
    supply = [0] * old_shards
    for old, _, size in blocks:
        supply[old] += size
    even, rest = divmod(sum(supply), new_shards)
    capacity = [even + (j < rest) for j in range(new_shards)]
    flow = min_cost_flow(supply, capacity, lambda i, j: 0 if i == j else 1)
    least = sum(n for i, row in enumerate(flow) for j, n in enumerate(row) if i != j)
    place: dict[tuple[int, int], int] = {}
    load = [0] * new_shards
    held: list[dict[tuple[int, int], int]] = [{} for _ in range(new_shards)]
    for old in range(old_shards):
        want = [(-flow[old][j], j) for j in range(new_shards) if flow[old][j]] or [(0, old % new_shards)]
        heapq.heapify(want)
        for _, block, size in sorted((b for b in blocks if b[0] == old), key=lambda b: (-b[2], b[1])):
            need, j = heapq.heappop(want)
            heapq.heappush(want, (need + size, j))
            place[old, block] = j
            load[j] += size
            held[j][old, block] = size
    for _ in range(64 * new_shards):
        big, small = max(range(new_shards), key=lambda j: (load[j], -j)), min(range(new_shards), key=lambda j: (load[j], j))
        gap = load[big] - load[small]
        fit = [(abs(2 * size - gap), key) for key, size in held[big].items() if 0 < size < gap]
        if not fit or gap * 1000 <= even:
            break
        key = min(fit)[1]
        size = held[big].pop(key)
        held[small][key] = size
        place[key] = small
        load[big], load[small] = load[big] - size, load[small] + size
    return place, least


def _long_array(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


@dataclass
class Plan:
    """Where every block goes: shard and first slot by old shard * blocks_per_shard + block."""

    blocks_per_shard: int
    new_shards: int
    shard: list[int]
    offset: list[int]
    shard_bytes: list[int]
    moved_bytes: int  # bytes that change their shard
    least_bytes: int  # what the flow, which may part blocks, moves
    changed: list[int]  # shards that gain or lose rows


def _keys(old_shard: Column, doc_id: str, text: str, blocks_per_shard: int) -> Column:
    """struct of a row's size, crc, old shard and block."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size, crc = (F.octet_length(raw) + 8).cast("long"), F.crc32(raw).cast("long")
    block = F.pmod(F.shiftrightunsigned(F.xxhash64(F.col(doc_id), crc, size), 20), F.lit(blocks_per_shard)).cast("int")
    return F.struct(size.alias("size"), crc.alias("crc"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old"), block.alias("block"))


def plan_reshard(docs: DataFrame, old_shard: Column, doc_id: str = "doc_id", text: str = "text", old_shards: int = 16, new_shards: int = 24, blocks_per_shard: int = 1024) -> tuple[DataFrame, Plan]:
    """(doc_id, size, text_crc32, old_shard, block of every row, the plan); see reshard."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), _keys(old_shard, doc_id, text, blocks_per_shard).alias("key"))
    slim = slim.select("doc_id", "key.size", F.col("key.crc").alias("text_crc32"), F.col("key.old").alias("old_shard"), "key.block")
    slim = keep(slim, "reshard-slim")
    totals = slim.groupBy("old_shard", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # at most old_shards * blocks_per_shard rows
    place, least = place_blocks([(r["old_shard"], r["block"], r["size"]) for r in totals], old_shards, new_shards)
    shard, offset, used = [0] * (old_shards * blocks_per_shard), [0] * (old_shards * blocks_per_shard), [0] * new_shards
    held, moved, changed = [0] * new_shards, 0, set()
    for r in sorted(totals, key=lambda r: (r["old_shard"], r["block"])):
        at, to = r["old_shard"] * blocks_per_shard + r["block"], place[r["old_shard"], r["block"]]
        shard[at], offset[at] = to, used[to]
        used[to] += r["n"]
        held[to] += r["size"]
        if to != r["old_shard"]:
            moved += r["size"]
            changed |= {to, r["old_shard"]}
    return slim, Plan(blocks_per_shard, new_shards, shard, offset, held, moved, least, sorted(changed))


def _placed(rows: DataFrame, plan: Plan, old: str, block: str) -> tuple[Column, Column]:
    """(new shard, first slot) of a row's block."""
    at = F.col(old) * plan.blocks_per_shard + F.col(block) + 1
    return F.element_at(_long_array(plan.shard), at).cast("int"), F.element_at(_long_array(plan.offset), at)


def reshard(docs: DataFrame, old_shard: Column, doc_id: str = "doc_id", text: str = "text", old_shards: int = 16, new_shards: int = 24, blocks_per_shard: int = 1024) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, old_shard, shard and slot (gapless from 0 in a shard).

    size is the UTF-8 length plus 8 (null text: 8). old_shard gives 0 to old_shards - 1, null counts as 0.
    Shard sizes come out near equal; the flow keeps as many bytes as it can in the shard of the same number.
    Repeated rows get slots of their own; ties in a block go by id, size and checksum. Rows with a null id are
    placed by their text. Rows equal in id and text stay in one block. Empty tables give an empty result. At most
    old_shards * blocks_per_shard block totals reach the driver.
    """
    slim, plan = plan_reshard(docs, old_shard, doc_id, text, old_shards, new_shards, blocks_per_shard)
    return assigned(slim, plan)


def assigned(slim: DataFrame, plan: Plan) -> DataFrame:
    """The assignment of reshard from its two halves."""
    shard, first = _placed(slim, plan, "old_shard", "block")
    in_block = Window.partitionBy("old_shard", "block").orderBy("doc_id", "size", "text_crc32")
    return slim.select("doc_id", "size", "text_crc32", "old_shard", shard.alias("shard"), (first + F.row_number().over(in_block) - 1).alias("slot"))


def rewrite_affected(docs: DataFrame, old_shard: Column, plan: Plan, path: str, doc_id: str = "doc_id", text: str = "text", file_bytes: int = 128 << 20, least_files: int = 8) -> tuple[str, str]:
    """Write the rows of every shard in plan.changed under path/new_shard=N; returns the names of the two columns added.

    docs and old_shard are those of the plan. Rows carry all their columns and new_slot; where docs has a column
    new_shard or new_slot of its own, the added one gets underscores at its end. One shuffle, by shard and file:
    a shard of b bytes is dealt over max(least_files, b / file_bytes) files by block. Folders of other shards are
    not touched, a changed shard's folder is replaced as a whole when all its rows are written, and a shard left
    without rows becomes empty. Null and repeated ids are rows like any other.
    """
    shard_name, slot_name = free_name("new_shard", docs.columns), free_name("new_slot", docs.columns)
    key, at, file = (free_name(n, docs.columns) for n in ("__key", "__first", "__file"))
    old, block = f"{key}.old", f"{key}.block"
    keyed = docs.withColumn(key, _keys(old_shard, doc_id, text, plan.blocks_per_shard))
    shard, first = _placed(keyed, plan, old, block)
    files = [max(least_files, -(-b // file_bytes)) for b in plan.shard_bytes]
    keyed = keyed.withColumns({shard_name: shard, at: first}).filter(F.element_at(F.from_json(F.lit(json.dumps([k in plan.changed for k in range(plan.new_shards)])), "array<boolean>"), F.col(shard_name) + 1))
    keyed = keyed.withColumn(file, F.pmod(F.xxhash64(old, block), F.element_at(_long_array(files), F.col(shard_name) + 1)).cast("int"))
    dealt = keyed.repartition(max(1, sum(files[k] for k in plan.changed if k < plan.new_shards)), shard_name, file)
    in_block = Window.partitionBy(shard_name, file, old, block).orderBy(doc_id, f"{key}.size", f"{key}.crc")
    rows = dealt.withColumn(slot_name, F.col(at) + F.row_number().over(in_block) - 1).drop(key, at, file)
    rows.sortWithinPartitions(shard_name, slot_name).write.partitionBy(shard_name).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    for left in plan.changed:
        if left >= plan.new_shards or not plan.shard_bytes[left]:
            rows.drop(shard_name).filter(F.lit(False)).write.mode("overwrite").parquet(f"{path}/{shard_name}={left}")
    return shard_name, slot_name
