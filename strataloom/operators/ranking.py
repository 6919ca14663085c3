"""Ranks, top-k, pages and budgets."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import sorted_fold


def rank_within(df: DataFrame, parts: list[str], order: list, most: int | None = None, name: str = "rank") -> DataFrame:
    """Rows with their rank in each part; only the first ``most``, which Spark cuts before the shuffle too."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    return out if most is None else out.where(F.col(name) <= most)


def top_with_rest(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows, each with ``omitted``: how many rows were left out."""
    total = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("omitted"))
    return df.orderBy(*order).limit(n).crossJoin(total)  # a row of one


def encode_cursor(scope: str, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([scope, offset], separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None, scope: str) -> int:
    """Offset of a cursor; ValueError("invalid-cursor") for one that is broken or of another scope."""
    if not cursor:
        return 0
    try:
        got, offset = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (ValueError, TypeError) as e:
        raise ValueError("invalid-cursor") from e
    if got != scope or not isinstance(offset, int) or offset < 0:
        raise ValueError("invalid-cursor")
    return offset


def page(df: DataFrame, order: list, scope: str, cursor: str | None = None, limit: int | None = None) -> tuple[DataFrame, str]:
    """(rows of one page, cursor of the next page); the limit is 20 unless given, and lies between 1 and 50.

    The page is a sorted limit over offset + limit rows, so only those leave the tasks; the last page is the one that has
    fewer rows than its limit.
    """
    at, n = decode_cursor(cursor, scope), min(50, max(1, limit or 20))
    return df.orderBy(*order).offset(at).limit(n), encode_cursor(scope, at + n)


def natural_key(name: Column, digits: int = 12) -> Column:
    """Sort key that orders numbers within names by value: runs of digits padded with zeros."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, digits, "0")).otherwise(p)), "")


def pack_to_budget(rows: DataFrame, key: str, order: str, size: str, ident: str, budget: int, least_left: int = 200, most: int = 40, floor: float = 0.06, score: str | None = None) -> DataFrame:
    """(key, id, position): sections taken in rank order while they fit.

    One that doesn't fit is passed over and smaller ones may still come, until fewer than ``least_left`` bytes are left,
    ``most`` are taken, or the score falls under ``floor`` of the best.
    """

    def start():
        used, taken, top, over = 0, 0, None, False

        def fold(n, value=None):
            nonlocal used, taken, top, over
            if score and top is None:
                top = value
            over = over or taken >= most or bool(score) and (value is None or value <= 0 or value < top * floor)
            if over:
                return None
            if used + n > budget:
                over = budget - used < least_left
                return None
            used, taken = used + n, taken + 1
            return taken

        return fold

    cols = [key, order, size, ident, *([score] if score else [])]
    packed = sorted_fold(rows.select(*cols), key, [order], [size, *([score] if score else [])], start, "position", T.IntegerType())
    return packed.where("position IS NOT NULL").select(key, ident, "position")


def batches_by_size(rows: DataFrame, key: str, order: str, size: str, ident: str, most_bytes: int, most_rows: int) -> DataFrame:
    """(key, id, batch): rows in order, a new batch when bytes or rows would overflow; oversize rows get batch -1."""

    def start():
        batch, used, count = 0, 0, 0

        def fold(n):
            nonlocal batch, used, count
            if n > most_bytes:
                return -1
            if count and (used + n > most_bytes or count >= most_rows):
                batch, used, count = batch + 1, 0, 0
            used, count = used + n, count + 1
            return batch

        return fold

    return sorted_fold(rows.select(key, order, size, ident), key, [order], [size], start, "batch", T.IntegerType()).select(key, ident, "batch")


def blob_chunks(rows: DataFrame, key: str, order: str, size: str, ident: str, most_bytes: int) -> DataFrame:
    """(key, id, chunk): rows in order, a new chunk where the next size does not fit; a larger one is a chunk of its own."""

    def start():
        chunk, used = -1, None

        def fold(n):
            nonlocal chunk, used
            if used is None or used + n > most_bytes:
                chunk, used = chunk + 1, 0
            used += n
            return chunk

        return fold

    return sorted_fold(rows.select(key, order, size, ident), key, [order], [size], start, "chunk", T.IntegerType()).select(key, ident, "chunk")


def prefix_within(df: DataFrame, parts: list[str], order: list, size: str, budget: int) -> DataFrame:
    """The longest prefix of each part whose sizes sum to the budget at most."""
    w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def flows_within_caps(edges: DataFrame, key: str, most_edges: int, most_nodes: int) -> DataFrame:
    """(key, id): edges in id order, each kept while edge and node caps hold; one that breaks a cap is passed over."""

    def start():
        nodes, kept = set(), 0

        def fold(a, b):
            nonlocal nodes, kept
            more = nodes | {a, b}
            if kept >= most_edges or len(more) > most_nodes:
                return False
            nodes, kept = more, kept + 1
            return True

        return fold

    return sorted_fold(edges.select(key, "id", "from_id", "to_id"), key, ["id"], ["from_id", "to_id"], start, "kept", T.BooleanType()).where("kept").select(key, "id")


def number_collisions(df: DataFrame, ident: str, order: list) -> DataFrame:
    """``df`` with ``unique_id``: repeated ids get -2, -3 ...; a suffixed id that is taken already is passed over.

    The n-th row of an id takes the n-th free suffix. Suffixes that given ids occupy are numbered first, so each row finds
    its own by counting the occupied ones below it: no rounds.
    """
    w = Window.partitionBy(ident).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(w))
    # Given ids of the form stem-number occupy that number of their stem.
    given = df.select(F.col(ident).alias("_given")).distinct()
    form = r"^(.*)-([1-9][0-9]{0,17})$"
    held = given.where(F.col("_given").rlike(form)).select(F.regexp_extract("_given", form, 1).alias("_stem"), F.regexp_extract("_given", form, 2).try_cast("long").alias("_at")).where("_at >= 2")
    held = held.join(given.select(F.col("_given").alias("_stem")), "_stem", "left_semi")
    # The k-th occupied number moves a row on if its place, counted among free numbers, lies at or beyond it.
    k = F.row_number().over(Window.partitionBy("_stem").orderBy("_at"))
    held = held.select("_stem", (F.col("_at") - k + 1).alias("_from"))
    steps = held.groupBy("_stem").agg(F.sort_array(F.collect_list("_from")).alias("_steps"))
    out = numbered.join(steps, F.col(ident) == F.col("_stem"), "left")
    passed = F.coalesce(F.size(F.filter("_steps", lambda x: x <= F.col("_n"))), F.lit(0))
    number = F.when(F.col("_steps").isNull(), F.col("_n")).otherwise(F.col("_n") + passed)
    unique = F.when(F.col("_n") == 1, F.col(ident)).otherwise(F.concat(ident, F.lit("-"), number.cast("string")))
    return out.withColumn("unique_id", unique).drop("_n", "_stem", "_steps")
