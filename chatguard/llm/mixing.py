"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The least-informative document rates r (largest entropy, 0 <= r <= max_rate) that meet one token constraint
for each source are r = min(max_rate, exp(lambda_source * size / mean size)). The multipliers solve a convex
dual; Newton steps for all sources run together over a (source, size, count) histogram, which is exact because
a rate depends on nothing else. Rates become whole copies by systematic rounding over falling sizes.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatguard.llm.store import keep

_OFFSETS = 64
_SALTS = 256
_ROUNDS = 80


def word_count(text: str) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], ratio: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), max_rate: float = 2.0) -> dict[str | None, float]:
    """Token targets: sources by code point (null last) weigh as given, repeating, and share ratio times all sizes.

    No target exceeds max_rate times its source's size; the excess is shared again by weight until none does.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    left, free, out = ratio * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= max_rate * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = max_rate * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def _numbers(values: list[float]) -> Column:
    """A literal array of doubles; one constant however many sources there are."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def _of(values: list[float], number: str = "sno") -> Column:
    return F.element_at(_numbers(values), F.col(number) + 1)


def _solve(hist: DataFrame, means: list[float], targets: list[float], totals: list[float], least: list[float], max_rate: float) -> list[float]:
    """The multipliers by Newton's method with a bracket for each source; one small aggregation a round."""
    n = len(means)
    lam, low, high, done = [0.0] * n, [-math.inf] * n, [math.inf] * n, [False] * n
    for s in range(n):
        if totals[s] <= 0 or targets[s] <= 0:
            done[s] = True
        elif targets[s] >= max_rate * totals[s] * (1 - 1e-12):
            lam[s], done[s] = math.log(max_rate) / (least[s] / means[s]) * (1 + 1e-9), True
    x = F.col("size") / _of(means)
    for _ in range(_ROUNDS):
        if all(done):
            break
        rate = F.exp(F.least(_of(lam) * x, F.lit(700.0)))
        free = rate < max_rate
        got = hist.groupBy("sno").agg(
            F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(float(max_rate)))).alias("tokens"),
            F.sum(F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
        ).collect()  # one row for each source
        for r in got:
            s = r["sno"]
            if done[s]:
                continue
            gap = r["tokens"] - targets[s]
            if abs(gap) <= 1e-9 * targets[s]:
                done[s] = True
                continue
            if gap < 0:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            step = lam[s] - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not low[s] < step < high[s] or abs(step - lam[s]) > 8:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = lam[s] + (-8 if gap > 0 else 8)
                else:
                    step = (low[s] + high[s]) / 2
            lam[s] = step
    return lam


def mix_to_targets(docs: DataFrame, size: str = "size", source: str = "source", ratio: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), max_rate: float = 2.0, max_sources: int = 100_000) -> DataFrame:
    """docs with mix_source_size long, mix_target double and mix_copies int (0 to max_rate) for every row.

    size is a column of non-negative longs (null counts as 0), source a string (null is a source of its own,
    last in order). A document of size 0 is kept once. Repeated rows are documents of their own; reruns give
    the same copies for the same set of rows. An empty table gives an empty result. The tokens taken of a
    source differ from its target by at most about half its largest document, and by far less where the source
    has many. Columns named mix_* are replaced; others pass through whatever their names, but for names that begin
    with two underscores. The number of sources is checked.
    """
    docs = docs.drop("mix_source_size", "mix_target", "mix_copies")
    whole = F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")
    counts = keep(docs.select(F.col(source).alias("source"), whole).groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    stats = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    rows = stats.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if not rows:
        return docs.withColumns({"mix_source_size": F.lit(0).cast("long"), "mix_target": F.lit(0.0), "mix_copies": F.lit(1)})
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = source_targets({r["source"]: r["total"] for r in rows}, ratio, weights, max_rate)
    totals, targets = [float(r["total"]) for r in rows], [float(goal[r["source"]]) for r in rows]
    means = [r["total"] / r["docs"] if r["docs"] else 1.0 for r in rows]
    table = json.dumps([{"source": r["source"], "sno": k} for k, r in enumerate(rows)])
    numbered = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<source:string,sno:int>>"))).withColumnRenamed("source", "__source")
    hist = keep(counts.join(numbered, counts["source"].eqNullSafe(F.col("__source"))).select("sno", "size", "n"), "mix-histogram")
    lam = _solve(hist, means, targets, totals, [float(r["least"] or 1) for r in rows], max_rate)

    rate = F.when(F.col("size") > 0, F.least(F.lit(float(max_rate)), F.exp(F.least(_of(lam) * F.col("size") / _of(means), F.lit(700.0))))).otherwise(1.0)
    falling = Window.partitionBy("sno").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("want", F.col("n") * rate).withColumn("to", F.sum("want").over(falling)).withColumn("from", F.col("to") - F.col("want"))
    run = keep(run, "mix-rates")
    whole_copies = lambda u: F.floor(F.round(F.col("to"), 6) + u) - F.floor(F.round(F.col("from"), 6) + u)
    tried = run.groupBy("sno").agg(*[F.sum(F.col("size") * whole_copies(F.lit(k / _OFFSETS))).alias(f"u{k}") for k in range(_OFFSETS)]).collect()
    offset = [0.5] * len(rows)
    for r in tried:
        offset[r["sno"]] = min(range(_OFFSETS), key=lambda k: (abs(r[f"u{k}"] - targets[r["sno"]]), abs(k - _OFFSETS // 2))) / _OFFSETS
    copies = F.greatest(F.lit(0), F.least(whole_copies(_of(offset)), (F.col("n") * int(max_rate))))
    groups = run.withColumn("copies", copies).select(
        F.col("sno").alias("__sno"), F.col("size").alias("__size"), F.floor(F.col("copies") / F.col("n")).cast("int").alias("__base"), (F.col("copies") % F.col("n")).alias("__extra"), F.col("n").alias("__of")
    )

    marked = docs.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    mine = [c for c in docs.columns if c not in (size, source)]
    mark = F.xxhash64(*[_named(c) for c in [*mine, "__size"] if not dict(docs.dtypes).get(c, "").startswith(("map", "variant"))])
    known = numbered.withColumnRenamed("sno", "__sno")
    marked = marked.withColumn("__mark", mark).join(F.broadcast(known) if len(rows) <= 10_000 else known, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    marked = marked.withColumn("__salt", F.pmod(F.col("__mark"), F.lit(_SALTS)).cast("int"))
    # The copies of a (source, size) group go to salted parts of it, in proportion; the rows of a part are then ranked.
    parts = marked.groupBy("__sno", "__size", "__salt").agg(F.count("*").alias("__part"))
    parts = parts.join(groups, ["__sno", "__size"])
    in_group = Window.partitionBy("__sno", "__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("__upto", F.sum("__part").over(in_group))
    share = lambda upto: F.floor(F.col("__extra") * upto / F.col("__of"))
    parts = parts.select("__sno", "__size", "__salt", "__base", (share(F.col("__upto")) - share(F.col("__upto") - F.col("__part"))).alias("__more"))
    place = Window.partitionBy("__sno", "__size", "__salt").orderBy("__mark")
    ranked = marked.withColumn("__place", F.row_number().over(place)).join(parts, ["__sno", "__size", "__salt"])
    ranked = ranked.withColumns(
        {
            "mix_source_size": F.element_at(F.from_json(F.lit(json.dumps([r["total"] for r in rows])), "array<bigint>"), F.col("__sno") + 1),
            "mix_target": _of(targets, "__sno"),
            "mix_copies": (F.col("__base") + F.when(F.col("__place") <= F.col("__more"), 1).otherwise(0)).cast("int"),
        }
    )
    return ranked.select(*[_named(c) for c in docs.columns], "mix_source_size", "mix_target", "mix_copies")


def _named(column: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")
