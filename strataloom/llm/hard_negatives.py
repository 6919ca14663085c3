"""Hard-negative mining by distributed radix selection.

Anchors are worked on page by page; a page has a fixed number of anchors at most, which bounds what is broadcast. For each
anchor-positive window of scores, tasks score their own rows in blocks and count them in integer histograms: a window's
undecided range is cut into 256 buckets, the counts of all tasks are added, and the bucket that holds the kth score becomes
the next range, until it holds few rows or a single score. Rows that tie at a single score are told apart in the same way by
the digits of their ids. Only then are rows gathered: those above the range and those in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, scratch_dir

#: Anchors of a page, rows of a block, buckets of a histogram, rows that a window may leave undecided when they are gathered.
PAGE, BLOCK, BUCKETS, SLACK = 2048, 1024, 256, 64

#: Scores beyond these stay at them, so that percentages of a score fit in a long.
MOST = 1 << 55

_ROWS = "id long, label long, v array<bigint>, anchor boolean"


def _prepared(rows: DataFrame, anchors: Column, scale: int, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, v, anchor): integer vectors of the rows that take part, one row for each id."""
    x = F.col(f"`{vector_col}`")
    sound = F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(2.0**60)), F.lit(-(2.0**60)))))
    made = rows.where(sound).select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 50_000))
    return made.repartition(tasks, "id").groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("x")).select("id", "x.label", "x.v", "x.anchor")


def _matrix(column: pa.ListArray, dims: int, kind: type) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are padded with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(kind)
    out = np.zeros((len(sizes), dims), kind)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


@dataclass
class Scores:
    """Exact inner products with the anchors of a page, in the cheapest number type that holds them."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    dims: int
    largest: int  # of the components of all rows

    def __post_init__(self):
        most = self.dims * self.largest * self.largest
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        self.matrix = self.vectors.astype(self.kind).T

    def of(self, column: pa.ListArray) -> np.ndarray:
        """(rows, anchors)."""
        made = _matrix(column, self.dims, np.int64).astype(self.kind, copy=False) @ self.matrix
        return np.clip(made, -MOST, MOST).astype(np.int64) if self.kind in (np.int64, object) else made


@dataclass
class Windows:
    """Windows of the anchors of a page in layers: layer j has a window for each anchor, of scores low to high.

    ``k`` rows are looked for from the top. Scores bottom to top are undecided; where they are one score, ids first to last.
    Rows above are taken, ``need`` of the undecided ones are wanted. Ids count from the least id, without sign.
    """

    low: np.ndarray
    high: np.ndarray
    k: int
    same_label: bool
    least_id: int
    most_id: int
    extra: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        shape = self.low.shape
        self.bottom, self.top = self.low.copy(), self.high.copy()
        self.need = np.full(shape, self.k, np.int64)
        self.open = self.low <= self.high
        self.by_id = np.zeros(shape, bool)
        self.first = np.zeros(shape, np.uint64)
        self.last = np.full(shape, self.most_id - self.least_id, np.uint64)

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.top - self.bottom) // BUCKETS + 1, (self.last - self.first) // np.uint64(BUCKETS) + np.uint64(1)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        return ids.view(np.uint64) - np.array(self.least_id, np.int64).view(np.uint64)

    def narrow(self, layer: np.ndarray, anchor: np.ndarray, bucket: np.ndarray, count: np.ndarray, before: np.ndarray) -> None:
        """Take the bucket of the kth row of each window named; the other open windows have fewer rows and take all."""
        found = np.zeros(self.open.shape, bool)
        found[layer, anchor] = True
        self.open &= found
        step, id_step = self.steps()
        for j, a, b, n, less in zip(*(x.tolist() for x in (layer, anchor, bucket, count, before))):
            if self.by_id[j, a]:
                self.first[j, a] += np.uint64(b) * id_step[j, a]
                self.last[j, a] = min(self.last[j, a], self.first[j, a] + (id_step[j, a] - np.uint64(1)))
            else:
                self.top[j, a] -= b * step[j, a]
                self.bottom[j, a] = max(self.bottom[j, a], self.top[j, a] - step[j, a] + 1)
                self.by_id[j, a] = self.bottom[j, a] == self.top[j, a]
            self.need[j, a] -= less
            self.open[j, a] = n > max(SLACK, self.need[j, a])


def _blocks(batches, scores: Scores, same_label: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores, which of them count) of blocks of rows; an anchor never meets itself."""
    for whole in batches:
        for b in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            alike = labels[:, None] == scores.labels
            yield ids, scores.of(b.column(2)), alike & (ids[:, None] != scores.ids) if same_label else ~alike


def _count(batches, scores: Scores, w: Windows) -> Iterator[pa.RecordBatch]:
    """(window, need, bucket, n) of a task's rows, as far down as the task's own kth row: the kth of all can't lie below."""
    layers, anchors = w.open.shape
    step, id_step = w.steps()
    counts = np.zeros((layers, anchors, BUCKETS), np.int64)
    bottom = w.bottom.copy()
    seen, due = 0, 1
    for ids, s, counting in _blocks(batches, scores, w.same_label):
        offsets = w.offsets(ids)
        for j in range(layers):
            row, a = np.nonzero(counting & w.open[j] & (s >= bottom[j]) & (s <= w.top[j]))
            by_id = w.by_id[j, a]
            bucket = (w.top[j, a] - s[row, a].astype(np.int64)) // step[j, a]
            if by_id.any():
                at = offsets[row]
                inside = ~by_id | (at >= w.first[j, a]) & (at <= w.last[j, a])
                bucket = np.where(by_id, ((at - w.first[j, a]) // id_step[j, a]).astype(np.int64), bucket)[inside]
                a = a[inside]
            counts[j] += np.bincount(a * BUCKETS + bucket, minlength=anchors * BUCKETS).reshape(anchors, BUCKETS)
        seen += 1
        if seen == due:  # what lies below the kth row so far needs no more counting
            due *= 2
            kth = (counts.cumsum(2) < w.need[..., None]).sum(2)
            bottom = np.where(w.by_id, bottom, np.maximum(bottom, w.top - (kth + 1) * step + 1))
    kth = (counts.cumsum(2) < w.need[..., None]).sum(2)
    j, a, bucket = np.nonzero((counts > 0) & (np.arange(BUCKETS) <= kth[..., None]))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (j.astype(np.int32), a.astype(np.int32), w.need[j, a], bucket.astype(np.int32), counts[j, a, bucket])], names=["layer", "anchor", "need", "bucket", "n"])


def _gather(batches, scores: Scores, w: Windows) -> Iterator[pa.RecordBatch]:
    """The rows above the undecided range of each window and those in it."""
    names = ["anchor_id", *w.extra, "other_id", "score"]
    for ids, s, counting in _blocks(batches, scores, w.same_label):
        offsets = w.offsets(ids)
        for j in range(len(w.low)):
            row, a = np.nonzero(counting & (s >= w.bottom[j]) & (s <= w.high[j]))
            score = s[row, a].astype(np.int64)
            keep = ~w.by_id[j, a] | (score > w.bottom[j, a]) | (offsets[row] <= w.last[j, a])
            row, a, score = row[keep], a[keep], score[keep]
            columns = [scores.ids[a], *(x[j, a] for x in w.extra.values()), ids[row], score]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)


def _select(rows: DataFrame, scores: Scores, w: Windows) -> DataFrame:
    """(anchor_id, extra columns, rank, other_id, score): the first k rows of each window, higher scores and smaller ids first."""
    spark = rows.sparkSession
    own = rows.select("id", "label", "v")
    while w.open.any():
        held = spark.sparkContext.broadcast((scores, w))  # a page: PAGE vectors and a few numbers for each window

        def count(batches, held=held):
            return _count(batches, *held.value)

        found = own.mapInArrow(count, "layer int, anchor int, need long, bucket int, n long").groupBy("layer", "anchor", "need", "bucket").agg(F.sum("n").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("layer", "anchor").orderBy("bucket"))
        kth = found.withColumn("before", so_far - F.col("n")).where("before < need AND before + n >= need").select("layer", "anchor", "bucket", "n", "before")
        t = kth.toArrow()  # one row for each window of the page at most
        w.narrow(*(t.column(c).to_numpy() for c in t.column_names))
        held.destroy()
    held = spark.sparkContext.broadcast((scores, w))

    def gather(batches):
        return _gather(batches, *held.value)

    rank = F.row_number().over(Window.partitionBy("anchor_id", *w.extra).orderBy(F.desc("score"), "other_id"))
    made = own.mapInArrow(gather, ", ".join(f"{c} long" for c in ("anchor_id", *w.extra, "other_id", "score")))
    return made.withColumn("rank", rank).where(F.col("rank") <= w.k)


def _page(anchors: DataFrame, after: int | None, page: int) -> pa.Table:
    rest = anchors if after is None else anchors.where(F.col("id") > after)
    return rest.orderBy("id").limit(page).toArrow()


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256, page: int = PAGE, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows named by ``anchors``.

    Components become floor(scale * x), scores are integer inner products, and higher scores come first, ties by smaller id. An
    anchor's positives are its first ``positives`` other rows of the same label; its negatives for each are the first
    ``negatives`` rows of other labels with low_percent * p <= 100 * n <= high_percent * p; all, where there are fewer.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. An id names a row: of rows that
    repeat one, that with the least (label, vector) counts. Shorter vectors count as padded with zeros. Scores beyond 2^55 stay at
    it. Copies of one vector, however many, are told apart by the digits of their ids. Without anchors, or in an empty table,
    there are no rows; other columns are neither read nor returned, whatever their names. Vectors are the only long values, and
    rows of any length are scored whole.
    """
    spark: SparkSession = rows.sparkSession
    label = F.col("label") if label is None else label
    own = materialize(_prepared(rows, anchors, scale, id_col, label, vector_col), "vectors")
    asked = materialize(own.where("anchor").select("id", "label", "v").repartitionByRange("id").sortWithinPartitions("id"), "anchors")
    out = T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    size = own.agg(
        F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest"), F.min("id").alias("first"), F.max("id").alias("last"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("square"),
    ).first()
    folder, after, pages = scratch_dir(spark, "negatives"), None, 0
    while len(ids := (table := _page(asked, after, page)).column("id").to_numpy()):
        after = int(ids[-1])
        dims, largest = size.dims, int(size.largest or 0)
        vectors = _matrix(table.column("v").combine_chunks(), dims, np.int64)
        scores = Scores(ids, table.column("label").to_numpy(), vectors, dims, largest)
        limit = min(MOST, int(size.square * 1.001) + 1)  # no score is larger than the square of the longest vector
        bound = np.full((1, len(ids)), limit, np.int64)
        near = _select(own, scores, Windows(-bound, bound, positives, True, size.first, size.last)).toArrow()  # positives * page rows at most
        place = {i: k for k, i in enumerate(ids.tolist())}
        low, high = np.ones((positives, len(ids)), np.int64), np.zeros((positives, len(ids)), np.int64)
        extra = {"positive_id": np.zeros_like(low), "positive_score": np.zeros_like(low)}
        for a, other, score, rank in zip(*(near.column(c).to_pylist() for c in ("anchor_id", "other_id", "score", "rank"))):
            at = rank - 1, place[a]
            low[at], high[at] = -(-low_percent * score // 100), high_percent * score // 100
            extra["positive_id"][at], extra["positive_score"][at] = other, score
        found = _select(own, scores, Windows(low, high, negatives, False, size.first, size.last, extra))
        found.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(folder)
        pages += 1
    return spark.read.schema(out).parquet(folder) if pages else spark.createDataFrame([], out)


#: DuckDB SQL for the registered query.
ORACLE = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
"""
