"""Line dedup over overlapping three-line windows, in DataFrame operations only.

Each three consecutive lines are hashed to 96 bits; a window that is found twice or more anywhere keeps its first place
(least document id, then position) and is removed elsewhere. Windows of one document overlap, so the lines to remove are
the merged positions that removed windows cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: DuckDB SQL for :func:`line_dedup` over ``documents``; it compares the lines themselves instead of hashes.
ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 0))) AS pos FROM d),
w AS (SELECT doc_id, pos, [trim(lines[pos + 1], ' '), trim(lines[pos + 2], ' '), trim(lines[pos + 3], ' ')] AS k FROM p),
f AS (SELECT *, count(*) OVER (PARTITION BY k) AS found, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS place FROM w WHERE k <> ['', '', '']),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM f WHERE found > 1 AND place > 1),
l AS (SELECT doc_id, lines, unnest(range(0, len(lines))) AS line FROM d),
k AS (SELECT l.doc_id, l.line, lines[l.line + 1] AS body, c.line IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.line = c.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text
FROM k GROUP BY doc_id
"""


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc, body_hash, pos, h1, h2) for each window that isn't blank throughout."""
    trimmed = docs.select("doc", "body_hash", F.transform(_lines(F.col("body")), lambda x: F.trim(x)).alias("t")).where(F.size("t") >= size)

    def window(i: Column) -> Column:
        own = [F.get("t", i + j) for j in range(size)]
        return F.struct(i.alias("pos"), F.xxhash64(*own).alias("h1"), F.hash(F.lit(7), *own).alias("h2"), F.greatest(*map(F.length, own)).alias("most"))

    made = F.transform(F.sequence(F.lit(0), F.size("t") - size), window)
    return trimmed.select("doc", "body_hash", F.explode(made).alias("w")).where("w.most > 0").select("doc", "body_hash", "w.pos", "w.h1", "w.h2")


def line_dedup(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` cleaned, and (n_lines, n_removed) beside them.

    Lines end at line feeds and are compared without blanks at their ends. Texts of fewer than ``size`` lines, null and
    empty ones stay as they are (null becomes the empty text: one line); windows of blank lines alone count for nothing.
    A row is told by its id and its text: repeated rows are one place and stay alike. Null ids come before all others. A
    text of any length is one row's work; its windows are rows of a few numbers.
    Columns of ``docs`` named like the two counts are replaced by them. An empty table gives no rows.
    """
    names = {c: f"__own_{k}" for k, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in names.items()))
    body = F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))
    own = own.withColumns({"doc": F.col(names[id_col]), "body": body, "body_hash": F.xxhash64(body)})
    windows = _windows(own.select("doc", "body", "body_hash"), size)
    # Partial sums before the shuffle: a window that a third of all documents share costs one row per task.
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("found"), F.min(F.struct("doc", "pos", "body_hash")).alias("first")).where("found > 1").drop("found")
    later = windows.join(repeated, ["h1", "h2"]).where(~F.struct("doc", "pos", "body_hash").eqNullSafe(F.col("first")))
    covered = later.groupBy(F.col("doc").alias("r_doc"), F.col("body_hash").alias("r_hash")).agg(F.collect_set("pos").alias("starts"))
    joined = own.join(covered, F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("body_hash") == F.col("r_hash")), "left")
    lines = _lines(F.col("body"))
    gone = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (size - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    joined = joined.withColumn("lines", lines).withColumn("kept", F.when(F.col("starts").isNotNull(), kept))
    clean = F.when(F.col("kept").isNull(), F.col("body")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    counts = {"n_lines", "n_removed"}
    return joined.select(
        *((clean if c == text_col else F.col(a)).alias(c) for c, a in names.items() if c not in counts),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
    )
