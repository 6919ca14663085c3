"""Aggregations: evidence, coverage, ledgers and evaluation metrics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_evidence(evidence: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, kept, total): distinct (path, start, end) of each key in order, the first ``most`` of them listed."""
    one = evidence.select(*keys, "path", "start", "end").distinct()
    w = Window.partitionBy(*keys).orderBy("path", "start", "end")
    ranked = one.withColumn("n", F.row_number().over(w))
    place = F.concat_ws(":", "path", F.col("start").cast("string"), F.col("end").cast("string"))
    return ranked.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= most, F.struct("n", place.alias("p"))))), lambda x: x["p"]).alias("kept"),
        F.count("*").alias("total"),
    )


def line_hits(lines: DataFrame) -> DataFrame:
    """(path, line, hits): hits of repeated records of a line summed."""
    return lines.groupBy("path", "line").agg(F.sum("hits").alias("hits"))


def coverage(hits: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(path, found, hit, rate): lines and hit lines per path, at least the stored counts; null rate without lines."""
    out = hits.groupBy("path").agg(F.count("*").alias("found"), F.count_if(F.col("hits") > 0).alias("hit"))
    if stored is not None:
        out = out.join(stored, "path", "full_outer").select("path", F.greatest("found", "stored_found").alias("found"), F.greatest("hit", "stored_hit").alias("hit"))
    rate = F.when(F.col("found") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("hit") / F.col("found"))))
    return out.withColumn("rate", rate)


def islands(hits: DataFrame, most: int = 32) -> DataFrame:
    """(path, start, end): runs of consecutive lines without a hit, the first ``most`` of each path.

    Reading stops as the last range opens, so that one's end is its start.
    """
    missed = hits.where("hits = 0")
    w = Window.partitionBy("path").orderBy("line")
    runs = missed.withColumn("run", F.col("line") - F.row_number().over(w)).groupBy("path", "run").agg(F.min("line").alias("start"), F.max("line").alias("end"))
    ranked = runs.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("start"))).where(F.col("n") <= most)
    return ranked.select("path", "start", F.when(F.col("n") == most, F.col("start")).otherwise(F.col("end")).alias("end"))


def mean_of_means(df: DataFrame, family: str, value: str) -> DataFrame:
    """(mean): the mean over families of each family's mean, nulls left out."""
    return df.groupBy(family).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))


def recall(hit: Column, expected: Column) -> Column:
    """Hits over expected; 1 where nothing was expected."""
    return F.when(expected == 0, F.lit(1.0)).otherwise(hit / expected)


def agreement(a: list, b: list) -> float | None:
    """Mean over all pairs of the product of the signs of both differences, in n log n steps: no pair is listed."""
    n = len(a)
    if n < 2:
        return None
    rank = {v: i + 1 for i, v in enumerate(sorted(set(b)))}
    tree, total, seen = [0] * (len(rank) + 1), 0, 0

    def up_to(i: int) -> int:
        k = 0
        while i:
            k, i = k + tree[i], i & (i - 1)
        return k

    rows = sorted(zip(a, (rank[v] for v in b)))
    at = 0
    while at < n:
        end = at
        while end < n and rows[end][0] == rows[at][0]:
            end += 1
        for _, r in rows[at:end]:  # against rows of smaller a
            total += up_to(r - 1) - (seen - up_to(r))
        for _, r in rows[at:end]:
            while r < len(tree):
                tree[r] += 1
                r += r & -r
        seen, at = end, end
    return total / (n * (n - 1) / 2)


def kendall_tau(ranked: DataFrame, group: str, item: str, a: str, b: str) -> DataFrame:
    """(group, tau) of two rankings of each group's item set: the mean agreement of all pairs; groups of one are left out.

    A group's two rank columns go to one task, as rankings of one list do.
    """
    name = ranked.schema[group]

    def tau(table):
        value = agreement(table.column("a").to_pylist(), table.column("b").to_pylist())
        rows = [] if value is None else [value]
        return pa.table({group: table.column(group).slice(0, len(rows)), "tau": pa.array(rows, pa.float64())})

    return ranked.select(group, F.col(a).alias("a"), F.col(b).alias("b")).groupBy(group).applyInArrow(tau, f"{group} {name.dataType.simpleString()}, tau double")


def nearest_rank(value: str, p: float) -> Column:
    """Percentile by nearest rank: the value at place ceil(p n) of the ascending order."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def median_or_zero(value: str) -> Column:
    return F.coalesce(F.median(value), F.lit(0.0))


def settle_ledger(events: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, amount, state) of reserved, settled and released events (type, ts, amount).

    The first settlement wins; a release drops what is only reserved; settlements of unknown requests count for nothing.
    """
    is_ = lambda k: F.col("type") == k
    per = events.groupBy(request).agg(
        F.max(F.when(is_("reserved"), F.col("amount"))).alias("reserved"),
        F.min_by(F.when(is_("settled"), F.col("amount")), F.when(is_("settled"), F.struct("ts", "amount"))).alias("settled"),
        F.bool_or(is_("released")).alias("released"),
    )
    known = per.where("reserved IS NOT NULL AND NOT (released AND settled IS NULL)")
    return known.select(request, F.coalesce("settled", "reserved").alias("amount"), F.when(F.col("settled").isNotNull(), "settled").otherwise("reserved").alias("state"))


def confusion(df: DataFrame, truth: Column, said: Column, by: list[str]) -> DataFrame:
    """Counts, accuracy, false acceptance and false alarm per group."""
    n = lambda c: F.count_if(c)
    out = df.groupBy(*by).agg(F.count("*").alias("n"), n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(~truth & ~said).alias("tn"), n(truth & ~said).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b)
    return out.select(*by, "n", share(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), share(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_acceptance"), share(F.col("fn"), F.col("fn") + F.col("tp")).alias("false_alarm"))
