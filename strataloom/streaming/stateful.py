"""Windows that start at a key's first event, debounce, dedupe, daily admission, patches and playback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import sorted_fold


def admit_fixed(times: list[float], window: float, limit: int, start: float | None = None, used: int = 0) -> tuple[list[bool], float | None, int]:
    """Which events a fixed-window limiter admits; its window starts at the first admitted event, refused ones don't count."""
    out = []
    for t in times:
        if start is None or t - start >= window:
            start, used = t, 0
        ok = used < limit
        used += ok
        out.append(ok)
    return out, start, used


def limiter(events: DataFrame, key: str, ts: str, ident: str, window_s: float, limit: int) -> DataFrame:
    """(key, id, admitted). A key's events are folded in order; a limiter without its key's order has no meaning."""

    def start():
        since, used = None, 0

        def fold(t):
            nonlocal since, used
            (ok,), since, used = admit_fixed([t], window_s, limit, since, used)
            return ok

        return fold

    rows = events.select(key, ident, F.col(ts).cast("timestamp").cast("double").alias("_t"))
    return sorted_fold(rows, key, ["_t", ident], ["_t"], start, "admitted", T.BooleanType()).drop("_t")


class LimiterProcessor(StatefulProcessor):
    """The limiter over a stream of (key, ts, id): its state per key is the start of the window and the count."""

    def __init__(self, window_s: float, limit: int):
        self.window_s, self.limit = window_s, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start double, used int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "id"])
        start, used = self.state.get() if self.state.exists() else (None, 0)
        times = [t.timestamp() for t in pdf["ts"]]
        ok, start, used = admit_fixed(times, self.window_s, self.limit, start, used)
        self.state.update((start, used))
        yield pd.DataFrame({"key": [key[0]] * len(pdf), "id": pdf["id"].to_numpy(), "admitted": ok})

    def close(self) -> None:
        pass


def limiter_stream(events: DataFrame, window_s: float, limit: int) -> DataFrame:
    """(key, id, admitted) of a stream (key string, ts, id long)."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=LimiterProcessor(window_s, limit), outputStructType="key string, id long, admitted boolean", outputMode="Append", timeMode="None")


def debounce(events: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """(key, start, last, events): bursts parted by more than ``gap_s`` quiet seconds, an event right at the gap still joins.

    Works on batches and on streams with a watermark.
    """
    return events.groupBy(key, F.session_window(ts, f"{gap_s} seconds").alias("s")).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("events")).drop("s")


def _cuts_below(ends: Column, n: int, at: Column) -> Column:
    """How many of ``n`` ascending cuts lie below a value, bisected; none for null."""
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda k, step: F.when(F.get(ends, k + step - 1) < at, k + step).otherwise(k))


def dedupe_recent(events: DataFrame, key: str, order: str, keep: int = 512, chunk_rows: int = 50_000, most_chunks: int = 2000) -> DataFrame:
    """Events whose key is not among the ``keep`` keys that came last; a key that comes again counts as new from then on.

    Deliveries have one order over all keys. It is cut into chunks, ``most_chunks`` at most; the keys that a chunk ends
    with need no more than its last ``keep`` distinct ones, so what each chunk starts from follows from a fold over these
    few rows, and then all chunks are folded side by side. Rows of equal ``order`` go by key. Null keys are one key; rows
    with a null ``order`` come first.
    """
    at = F.col(order).cast("double")
    n = events.count()
    parts = min(most_chunks, -(-n // chunk_rows))
    cuts = sorted(set(events.agg(F.percentile_approx(at, [j / parts for j in range(1, parts)], 10_000).alias("c")).first().c or [])) if parts > 1 else []
    ends = F.array(*(F.lit(float(c)) for c in cuts)) if cuts else F.array().cast("array<double>")
    rows = events.withColumns({"_k": F.to_json(F.struct(F.col(key).alias("k"))), "_chunk": _cuts_below(ends, len(cuts), at)})
    w = Window.partitionBy("_chunk").orderBy(F.desc_nulls_last("_o"), F.desc("_k"))
    last = rows.groupBy("_chunk", "_k").agg(F.max(order).alias("_o")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).select("_chunk", "_k", "_n")

    def entering(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[str, None] = {}
        out = []
        keys = {c: list(k) for c, k in pdf.sort_values("_n", ascending=False).groupby("_chunk")["_k"]}
        for chunk in range(len(cuts) + 1):
            out += [(chunk, k, i) for i, k in enumerate(seen)]
            for k in keys.get(chunk, ()):
                seen.pop(k, None)
                seen[k] = None
            seen = dict(list(seen.items())[-keep:])
        return pd.DataFrame(out, columns=["_chunk", "_k", "_n"])

    # most_chunks * keep rows at most.
    start = last.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(entering, "_chunk int, _k string, _n int")

    def fold(held, new):
        seen = dict.fromkeys(held.sort_by("_n").column("_k").to_pylist())
        new = new.sort_by([(order, "ascending"), ("_k", "ascending")]) if new.num_rows else new
        fresh = []
        for k in new.column("_k").to_pylist():
            fresh.append(k not in seen)
            seen.pop(k, None)
            seen[k] = None
            if len(seen) > keep:
                del seen[next(iter(seen))]
        return new.filter(pa.array(fresh, pa.bool_())).drop_columns(["_k", "_chunk"])

    return start.groupBy("_chunk").cogroup(rows.groupBy("_chunk")).applyInArrow(fold, events.schema)


def dedupe_stream(events: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """The stream's counterpart, bounded by time instead of by count."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def admit_daily(events: DataFrame, account: str, ts: str, ident: str, per_day: int = 5) -> DataFrame:
    """(account, id, day, admitted): the first ``per_day`` requests of each account and UTC day."""
    day = F.to_date(ts)
    w = Window.partitionBy(account, "day").orderBy(ts, ident)
    out = events.withColumn("day", day).withColumn("_n", F.row_number().over(w))
    return out.select(account, ident, "day", (F.col("_n") <= per_day).alias("admitted"))


def apply_patches(base: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, value, revision) after patches (revision, op, id, value), the latest per id; removals drop the id."""
    old = base.select("id", "value", F.lit(0).cast("long").alias("revision"), F.lit("upsert").alias("op"))
    every = old.unionByName(patches.select("id", "value", F.col("revision").cast("long").alias("revision"), "op"))
    last = every.groupBy("id").agg(F.max_by(F.struct("value", "op", "revision"), F.struct("revision", "op")).alias("x")).select("id", "x.*")
    return last.where("op <> 'remove'").drop("op")


def patch_status(patches: DataFrame, scene: str = "scene", start: int = 0) -> DataFrame:
    """``patches`` (scene, base_revision, revision) with ``status``: applied, revisionMismatch or nonIncreasing.

    A scene starts at revision ``start``. Patches come in order of ``arrival``; one applies only to the revision that its
    scene is at, and must raise it; a refused one changes nothing. The fold needs one number per scene.
    """

    def begin():
        at = start

        def fold(base, revision):
            nonlocal at
            if base != at:
                return "revisionMismatch"
            if revision <= base:
                return "nonIncreasing"
            at = revision
            return "applied"

        return fold

    return sorted_fold(patches, scene, ["arrival"], ["base_revision", "revision"], begin, "status", T.StringType())


def lod_levels(samples: DataFrame, key: str, order: str, zoom: str, edges: tuple[float, ...], slack: float) -> DataFrame:
    """(key, order, level): level of detail with hysteresis; it changes only past an edge by ``slack``."""

    def start():
        level = None

        def fold(z):
            nonlocal level
            if level is None:
                level = sum(z >= e for e in edges)
            while level < len(edges) and z >= edges[level] + slack:
                level += 1
            while level and z < edges[level - 1] - slack:
                level -= 1
            return level

        return fold

    return sorted_fold(samples.select(key, order, zoom), key, [order], [zoom], start, "level", T.IntegerType()).drop(zoom)


def backoff_seconds(base: float, attempt: int) -> float:
    """Pause before a retry."""
    return base * 2**attempt


def cap_threads(turns: DataFrame, thread: str, order: str, most: int = 50) -> DataFrame:
    """The last ``most`` turns of each thread."""
    w = Window.partitionBy(thread).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def carry_unfinished(attempts: DataFrame, scope: str, order: str, ok: str) -> DataFrame:
    """(scope, action): what the next run does: done, retry, or drop after two failures in a row."""
    last = attempts.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct((-F.col(order)).alias("o"), F.col(ok).alias("ok")))).alias("h"))
    one, two = F.get("h", F.lit(0))["ok"], F.get("h", F.lit(1))["ok"]
    return last.select(scope, F.when(one, "done").when(~F.coalesce(two, F.lit(True)), "drop").otherwise("retry").alias("action"))
