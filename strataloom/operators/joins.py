"""Joins with more than an equality: patterns, prefixes, suffixes, ranges, diffs and merges of deltas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What the parts of an ownership glob stand for; other text stands for itself.
_GLOB = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(pattern: str) -> str:
    """Regular expression of an ownership glob: ``*`` within a segment, ``**`` over segments, a final slash for folders."""
    body = pattern.strip("/")
    if not body.strip("*"):
        return "^.*$"
    inner = "".join(_GLOB.get(part) or re.escape(part) for part in re.findall(r"\*\*/|\*\*|[*?]|[^*?]+", body))
    start = "^" if "/" in pattern.rstrip("/") else "^(?:.*/)?"
    return start + inner + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def last_match(paths: DataFrame, rules: DataFrame, path_col: str = "path", most_rules: int = 2000) -> DataFrame:
    """(path, rule_no, owners): the last rule (rule_no, pattern_regex, owners) that matches; one without owners clears.

    Rules are the lines of one file. They become one CASE per path, so no row is multiplied and nothing is shuffled; a file
    of more than ``most_rules`` is refused before its rules are collected.
    """
    if (n := rules.limit(most_rules + 1).count()) > most_rules:
        raise ValueError(f"more than {most_rules} rules ({n})")
    ordered = sorted(rules.select("rule_no", "pattern_regex", "owners").collect(), key=lambda r: r.rule_no)
    number, owners = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    for r in ordered:
        hit = F.col(path_col).rlike(r.pattern_regex)
        number = F.when(hit, r.rule_no).otherwise(number)
        owners = F.when(hit, F.array(*map(F.lit, r.owners)) if r.owners else F.lit(None)).otherwise(owners)
    out = paths.select(path_col, number.alias("rule_no"), owners.alias("owners"))
    return out.where("owners IS NOT NULL")


def prefixes(path: Column) -> Column:
    """All ancestor folders of a path, the path itself included, shortest first; the root is the empty string."""
    parts = F.split(path, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.concat(F.array(F.lit("")), steps)


def suffixes(path: Column) -> Column:
    """All trailing parts of a path that begin at a segment."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def longest_prefix(files: DataFrame, dirs: DataFrame, path_col: str = "path", dir_col: str = "dir") -> DataFrame:
    """(path, dir): the deepest directory that holds each file; files below none are left out."""
    steps = files.select(path_col, F.explode(prefixes(F.col(path_col))).alias("_at"))
    hit = steps.join(dirs.select(F.col(dir_col).alias("_at")).distinct(), "_at")
    return hit.groupBy(path_col).agg(F.max_by("_at", F.length("_at")).alias(dir_col))


def longest_suffix(paths: DataFrame, known: DataFrame, path_col: str = "path", known_col: str = "known") -> DataFrame:
    """(path, known): the longest known path that a path ends with, at a segment."""
    steps = paths.select(path_col, F.explode(suffixes(F.col(path_col))).alias("_at"))
    hit = steps.join(known.select(F.col(known_col).alias("_at")).distinct(), "_at")
    return hit.groupBy(path_col).agg(F.max_by("_at", F.length("_at")).alias(known_col))


def innermost(spans: DataFrame, points: DataFrame, keys: list[str], bucket: int = 64, order: Column | None = None) -> DataFrame:
    """(point_id, span_id): the narrowest span (start, end) around each point (at), ties by id; or the least by ``order``.

    Spans are dealt over buckets of ``bucket`` lines, so the join is on equality; the range is checked after it.
    """
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    p = points.withColumn("_b", F.floor(F.col("at") / bucket))
    hit = p.join(s, [*keys, "_b"]).where((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end")))
    return hit.groupBy("point_id").agg(F.min_by("span_id", F.struct(F.col("end") - F.col("start"), "span_id") if order is None else F.struct(order, "span_id")).alias("span_id"))


def keyed_diff(before: DataFrame, after: DataFrame, key: str, compare: list[str], place: str | None = None) -> DataFrame:
    """(key, status): added, removed, changed, moved or same; a change outranks a move (column ``place``)."""
    mark = F.sha2(F.to_json(F.struct(*compare), {"ignoreNullFields": "false"}), 256)
    at = F.col(place) if place else F.lit(None).cast("string")
    side = lambda df, s: df.select(F.col(key).alias(f"k_{s}"), mark.alias(f"m_{s}"), at.alias(f"p_{s}"))
    both = side(before, "a").join(side(after, "b"), F.col("k_a") == F.col("k_b"), "full_outer")
    status = (
        F.when(F.col("k_a").isNull(), "added")
        .when(F.col("k_b").isNull(), "removed")
        .when(F.col("m_a") != F.col("m_b"), "changed")
        .when(~F.col("p_a").eqNullSafe(F.col("p_b")), "moved")
        .otherwise("same")
    )
    return both.select(F.coalesce("k_a", "k_b").alias(key), status.alias("status"))


def merge_deltas(base: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` under the authored ``upserts`` (non-null values win), without deleted keys."""
    cols = [c for c in base.columns if c != key]
    up = upserts.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in cols if c in upserts.columns))
    both = base.join(up, base[key] == up["_k"], "full_outer")
    out = both.select(F.coalesce(base[key], F.col("_k")).alias(key), *((F.coalesce(F.col(f"_{c}"), base[c]) if c in upserts.columns else base[c]).alias(c) for c in cols))
    return out.join(deletes.select(key), key, "left_anti")


def bucket_stars(items: DataFrame, bucket: str, key: str) -> DataFrame:
    """(first, member, size): each member of a bucket of two or more beside its least member; linear in the items."""
    head = items.groupBy(bucket).agg(F.min(key).alias("first"), F.count("*").alias("size")).where("size > 1")
    return items.join(head, bucket).select("first", F.col(key).alias("member"), "size")


def resolve_imports(imports: DataFrame, files: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """(specifier, path): the first of specifier + ending that is a file, in the order of the endings."""
    tries = imports.select("specifier", F.posexplode(F.array(*(F.concat("specifier", F.lit(e)) for e in endings))).alias("_n", "path"))
    return tries.join(files.select("path"), "path").groupBy("specifier").agg(F.min_by("path", "_n").alias("path"))


def nearby_tests(sources: DataFrame, files: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, path) of the first ``most`` test files (path) beside each source (key, path), in the order of their endings.

    Paths are alike and compress well, so tasks are given as a number: sized by compressed bytes they would hold too many.
    """
    from ..functions.text import test_paths

    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tries = sources.select(key, F.posexplode(test_paths(F.col("path"))).alias("_k", "path")).repartition(n, "path")
    hit = tries.join(files.select("path").repartition(n, "path").distinct().hint("merge"), "path")
    w = Window.partitionBy(key).orderBy("_k")
    return hit.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select(key, "path")
