"""Near-duplicate detection with bottom-k sketches of one hash function.

1. Every document becomes the set of its 5-word shingles, hashed to 64 bits; equal sets fall into one class at once.
2. The least values of a class's set are its bottom-k sketch. Inverted lists of retained values give the overlaps. A pair
   over the threshold shares many retained values, so a class enters only the lists of its rarest ones (prefix filter):
   values of passages that thousands of unlike documents hold are passed over unless little else is left.
3. In a few rounds each list pairs one pivot with its members of other components. The union sketch of a pair estimates
   its similarity; pairs far below the threshold go, the rest are verified on the full sets, and links join components.
   Lists that overlap choose the same pivots, so a group of thousands of near copies costs a few pairs per member.
4. Lists that still lie in several components are joined into groups by the class that leads them. The members outside
   a group's main component are held against all others, in blocks within a task: first by sketches, then by full sets.
   A task hands out true links only, so no link between components is lost, and no pairs are listed.

Lists, pivots and the centres of components that hold many rows are dealt over several tasks, in proportion to rows that
are counted first; the joins of list values and of set keys leave hot keys to the engine's skew join.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import arrow_rows, blocks, drop_dirs, materialize, release

#: Values kept of each set, and values that may make lists. The more of the sketch a similar pair must share, the fewer
#: lists of common values a class has to enter, so all of it is listed.
SKETCH = LISTED = 64
#: Chances that a similar pair shares fewer listed values than asked for, and that its estimate falls short.
LIST_RISK, ESTIMATE_RISK = 4e-8, 4e-7
#: Cells of the map of wanted ids that goes to all tasks, a bit each: a fixed size.
CELLS = 1 << 24
#: Rows of one key that one task may meet in a join, and the most keys beyond that for which rows are told apart.
KEY_ROWS, HOT_KEYS = 128, 2000
#: Orders of the classes from which lists choose their pivots after the first round.
ORDERS = 8
#: Rows of a partition of the block search.
BLOCK_ROWS = 4096


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHash()


def _word_hashes(text: str) -> np.ndarray:
    out = []
    for block in blocks(text):
        if len(_WORDS) > 200_000:
            _WORDS.clear()
        words = block.encode("utf-8", "surrogatepass").lower().split()
        out.append(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle."""
    w = _word_hashes(text or "")
    if not len(w):
        return np.zeros(0, np.int64)
    size = min(words, len(w))
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        acc = np.full(n, size, np.uint64)
        for j in range(size):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
            acc ^= acc >> np.uint64(29)
        acc = (acc ^ (acc >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        acc = (acc ^ (acc >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        acc ^= acc >> np.uint64(31)
    return np.unique(acc.view(np.int64))


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            n, key, sketch = [], [], []
            for v in b.column(1):
                s = shingle_set(v.as_py(), words)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append(s[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc", "n", "set_key", "sketch"],
            )

    return docs.mapInArrow(run, "doc long, n long, set_key binary, sketch array<long>")


@cache
def _sure_hits(draws: int, percent: int, risk: float) -> int:
    """The most hits that ``draws`` of a share of ``percent`` miss with a chance under ``risk``. Draws without replacement
    miss them more rarely."""
    p, low, hits = percent / 100, 0.0, 0
    while hits < draws and (low := low + comb(draws, hits) * p**hits * (1 - p) ** (draws - hits)) < risk:
        hits += 1
    return hits


def _least_shared(k: int, percent: int) -> int:
    """Listed values that a class with ``k`` of them shares with any similar class, at the least.

    Under LISTED the set is listed whole. A similar one that is listed whole too holds ``percent`` of it. One of n values,
    more than LISTED, lists LISTED of them, among these at worst all n - both that it has alone; where chance promises
    more than this bound, that is taken.
    """
    sure = max(1, _sure_hits(LISTED, percent, LIST_RISK))
    if k >= LISTED:
        return sure
    least = -(-k * percent // 100)
    for n in range(LISTED + 1, 100 * k // percent + 1):
        both = -(-percent * (k + n) // (100 + percent))
        least = min(least, max(LISTED - n + both, sure))
    return least


def _estimate(percent: int) -> float:
    """Union-sketch estimates below this come of similar pairs with a chance under ESTIMATE_RISK."""
    return _sure_hits(SKETCH, percent, ESTIMATE_RISK) / SKETCH


def _list_keys(classes: DataFrame, percent: int) -> DataFrame:
    """(v, rep, n): the lists that each class enters, and its size."""
    vals = classes.select("rep", "n", F.least("n", F.lit(LISTED)).alias("k"), F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    often = vals.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    mine = vals.join(often, "v").groupBy("rep", "n", "k").agg(F.collect_list(F.struct("df", "v")).alias("own"))
    # Both sides of a similar pair ask for no more than it shares, so their rarest values meet.
    shared = F.element_at(F.array(*(F.lit(_least_shared(k, percent)) for k in range(1, LISTED + 1))), F.col("k").cast("int"))
    take = F.col("k") - shared + 1 - (F.col("k") - F.size("own"))
    return mine.select("rep", "n", F.explode(F.slice(F.array_sort("own"), F.lit(1), F.greatest(take, F.lit(0)).cast("int"))).alias("x")).select("x.v", "rep", "n")


def _copies(rows) -> Column:
    """Over how many tasks the rows of a key go."""
    return F.ceil(rows / KEY_ROWS).cast("int")


def _lot(copies, by: str) -> Column:
    return F.pmod(F.xxhash64(by), copies).cast("int")


def _dealt(copies) -> Column:
    """One row for each of the tasks that meet a key."""
    return F.explode(F.sequence(F.lit(0), copies - 1)).alias("lot")


def _of_pivots(pairs: DataFrame, heads: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs`` with the row of ``table`` (column a) for their pivot; a pivot of many pairs meets them in ``copies`` tasks."""
    own = heads.select("a", _dealt(F.col("copies"))).join(table, "a")
    return pairs.withColumn("lot", _lot(F.col("copies"), "b")).join(own, ["a", "lot"]).drop("lot")


def _near_enough(pairs: DataFrame, heads: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, copies) whose sizes and union sketch allow the threshold."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = _of_pivots(pairs, heads, side("a")).join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    return both.where(shared >= _estimate(percent) * F.size(union)).select("a", "b", "copies")


def _full_sets(docs: DataFrame, wanted_ids: DataFrame, words: int) -> DataFrame:
    """(rep, full): the shingle sets, as bytes, of the documents with the wanted ids (column rep)."""
    # A map of fixed size lets a scan skip most other texts before they are cut; the join is exact.
    cells = wanted_ids.select((F.pmod(F.xxhash64("rep"), F.lit(CELLS)) + 1).alias("c"))
    maps = cells.groupBy(F.bitmap_bucket_number("c").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
    wanted = np.zeros((CELLS // 32768, 4096), np.uint8)
    for r in maps.collect():  # CELLS / 32768 rows of 4 KB at most
        wanted[r.k - 1] = np.frombuffer(r.bits, np.uint8)
    wanted = wanted.ravel()

    def sets(batches):
        for b in batches:
            cell = np.asarray(b.column(2))
            at = np.flatnonzero(wanted[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
            for lo in range(0, len(at), 512):
                part = at[lo : lo + 512]
                made = [shingle_set(b.column(1)[int(i)].as_py(), words).tobytes() for i in part]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part)), pa.array(made, pa.binary())], names=["rep", "full"])

    scanned = docs.where("doc IS NOT NULL").withColumn("cell", F.pmod(F.xxhash64("doc"), F.lit(CELLS))).mapInArrow(sets, "rep long, full binary")
    return scanned.join(wanted_ids, "rep", "left_semi")


def _verify(pairs: DataFrame, heads: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full shingle sets are similar."""
    side = lambda x: full.select(F.col("rep").alias(x), F.col("full").alias(f"f{x}"))
    both = _of_pivots(pairs, heads, side("a")).join(side("b"), "b")

    def compare(batches):
        for b in batches:
            keep, last, left = [], None, None
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                raw = x.as_py()
                if raw != last:
                    last, left = raw, np.frombuffer(raw, np.int64)
                if _similar(left, np.frombuffer(y.as_py(), np.int64), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return both.select("a", "b", "fa", "fb").mapInArrow(compare, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * inter >= percent * (len(x) + len(y) - inter) > 0


def _beside(rows: DataFrame, table: DataFrame, key: str, count: str, most: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key`` and tells its number of rows in ``count``.

    Keys of more than ``most`` rows are broadcast, and the caller sees to it that they are few; the others meet their rows
    in a shuffle. So no task holds all rows of a hot key.
    """
    hot = F.broadcast(table.where(F.col(count) > most))
    plain = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) <= most), key)
    return rows.join(hot, key).unionByName(plain)


def connected_components(edges: DataFrame, rounds: int = 60, made: list[str] | None = None) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) can reach.

    Large-star and small-star steps; every round is written to the shared folder, so no lineage grows. Hot centres, at
    most twice HOT_KEYS, are broadcast, so no task holds all arcs of one. Null ends, loops and repeated edges say nothing.
    """
    made = []
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(ends.where("a > b").distinct(), "components", made)
    for _ in range(rounds):
        # Done when each node points at one other, or is pointed at, but not both: a star has its least node as centre.
        told = now.groupBy("a").agg(F.count("*").alias("up")).unionAll(now.select("b", F.lit(0)).distinct()).groupBy("a")
        told = told.agg(F.sum("up").alias("up"), F.min("up").alias("least"))
        state = told.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count_if((F.col("up") > 1) | (F.col("up") > F.col("least"))).alias("open")).first()
        if not state.open:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        n = state.n
        most = max(KEY_ROWS, n // HOT_KEYS)
        arcs = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("d"))
        large = _beside(arcs.where("b > a"), low, "a", "d", most).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now b < a in each row.
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d"))
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        small = _beside(large, down, "a", "d", most).select(F.explode(F.array(pair("b"), pair("a"))).alias("e"))
        now = materialize(small.select("e.*").where("a <> b").distinct(), "components", made)
        drop_dirs(edges.sparkSession, made, keep=1)
    raise RuntimeError("components did not settle")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence blocks of bounded width."""
    flat = [np.concatenate(side) for side in (left, right)]
    values = np.intersect1d(*flat)  # what one side alone holds meets nothing
    sides = []
    for sets, all_values in zip((left, right), flat):
        at = np.searchsorted(values, all_values)
        at[at == len(values)] = 0
        who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        on = values[at] == all_values if len(values) else np.zeros(len(at), bool)
        at, who = at[on], who[on]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], who[order], len(sets)))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(values), wide):
        held = []
        for at, who, n in sides:
            i, j = np.searchsorted(at, [lo, lo + wide])
            block = np.zeros((n, min(wide, len(values) - lo)), np.float32)
            block[who[i:j], at[i:j] - lo] = 1
            held.append(block)
        out += held[0] @ held[1].T
    return out


def _may_link(comp, outside, size, short, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, table of pairs): rows of either role, and which pairs their sizes and sketches allow."""
    left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
    lo, hi = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
    ok = (comp[left][:, None] != comp[right][None, :]) & (100 * lo >= percent * hi)
    rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    if len(rows):
        part = np.ix_(rows, cols)
        held = np.minimum(size, SKETCH)
        least = _estimate(percent) * np.minimum.outer(held[left[rows]], held[right[cols]]) * 0.9
        ok[part] &= _overlaps([short[i] for i in left[rows]], [short[i] for i in right[cols]]) >= least
    return left, right, ok


def _block_links(rep, comp, outside, sets, percent: int) -> list[tuple[int, int]]:
    """Links between components found in one block, without those that earlier ones make needless."""
    size = np.array([len(s) for s in sets], np.int64)
    left, right, ok = _may_link(comp, outside, size, [s[:SKETCH] for s in sets], percent)
    # Pair by pair, or all at once, whichever is cheaper; both are exact.
    i, j = np.nonzero(ok)
    if not len(i):
        return []
    by_pair = len(i) * 2e-5 + (size[left][i] + size[right][j]).sum() * 2e-8
    rows, cols = np.unique(i), np.unique(j)
    at_once = len(rows) * len(cols) * (size[left][rows].sum() + size[right][cols].sum()) * 1e-10
    if by_pair > at_once:
        inter = np.zeros(ok.shape, np.float32)
        inter[np.ix_(rows, cols)] = _overlaps([sets[left[k]] for k in rows], [sets[right[k]] for k in cols])
        ok &= 100 * inter >= percent * (size[left][:, None] + size[right][None, :] - inter)
        found = zip(*np.nonzero(ok))
    else:
        found = ((x, y) for x, y in zip(i, j) if _similar(sets[left[x]], sets[right[y]], percent))
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for x, y in found:
        a, b = top(int(comp[left[x]])), top(int(comp[right[y]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(rep[left[x]]), int(rep[right[y]])))
    return out


def _between(placed: DataFrame, full: DataFrame, percent: int, made: list[str], block: int = 512, values: int = 1 << 19) -> DataFrame:
    """Links (a, b) between classes that share a list but lie in different components.

    Lists that one class leads are searched as one group: copies of a text share dozens of lists, and its least copy leads
    most of them, so they meet once. A block holds about ``block`` classes and ``values`` shingles of either side of a
    group, so long texts make small blocks; a task hands out true links only.
    """
    order = F.struct(F.xxhash64(F.lit(-1), "rep"), "rep")
    open_lists = placed.groupBy("v").agg(F.min_by("rep", order).alias("lead"), F.first("m").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    leads = open_lists.select("v", "lead", _dealt(_copies(F.col("m"))))
    groups = placed.withColumn("lot", _lot(_copies(F.col("m")), "rep")).join(leads, ["v", "lot"]).select("lead", "rep", "n", "component").distinct()
    groups = materialize(groups, "groups", made)
    per = groups.groupBy("lead", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    # Groups of two were compared in the first round.
    main = F.max_by(F.struct("component", "c", "n"), F.struct("c", "component")).alias("main")
    sizes = per.groupBy("lead").agg(main, F.sum("c").alias("m"), F.sum("n").alias("n")).where("m > 2")
    count = lambda m, n: F.ceil(F.greatest(m / block, n / values)).cast("int")
    rest = F.col("m") - F.col("main.c")
    sizes = sizes.select("lead", F.col("main.component").alias("main"), "m", rest.alias("out"), count(F.col("m"), F.col("n")).alias("nb"), count(rest, F.col("n") - F.col("main.n")).alias("nc"))
    sizes = materialize(sizes, "group-sizes", made)
    told = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.col("m") * F.col("nc") + F.col("out") * F.col("nb")), F.lit(0)).alias("n")).first()
    # As many partitions as the rows call for, so that a task's share stays the same however much there is.
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-told.n // BLOCK_ROWS))
    rows = _beside(groups, sizes, "lead", "m", max(KEY_ROWS, told.m // HOT_KEYS)).join(full, "rep")
    outside = F.col("component") != F.col("main")
    deal = lambda of: F.pmod(F.xxhash64("rep"), of).cast("int")
    place = lambda x, y, role: F.struct(x.alias("x"), y.alias("y"), F.lit(role).alias("role"))
    inner = F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda c: place(deal(F.col("nb")), c, False))
    outer = F.when(outside, F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: place(b, deal(F.col("nc")), True))).otherwise(F.slice(inner, 1, 0))
    rows = rows.select("lead", "rep", "component", "full", F.explode(F.concat(inner, outer)).alias("p")).select("lead", "p.*", "rep", "component", "full")

    def search(pdf):
        sets = [np.frombuffer(x, np.int64) for x in pdf["full"]]
        links = _block_links(pdf["rep"].to_numpy(), pdf["component"].to_numpy(), pdf["role"].to_numpy(), sets, percent)
        return pd.DataFrame({"a": [x for x, _ in links], "b": [y for _, y in links]}, dtype="int64")

    return rows.repartition(tasks, "lead", "x", "y").groupBy("lead", "x", "y").applyInPandas(search, "a long, b long").distinct()


def _place(keys: DataFrame, parts: DataFrame) -> DataFrame:
    return keys.join(parts, "rep", "left").select("v", "rep", "n", "m", F.coalesce("component", "rep").alias("component"))


def _join_parts(parts: DataFrame, links: DataFrame, made: list[str]) -> DataFrame:
    """(rep, component) after more links."""
    edges = parts.where("rep <> component").select(F.col("rep").alias("a"), F.col("component").alias("b")).unionAll(links)
    return connected_components(edges, made=made).withColumnRenamed("node", "rep")


def _components_of(source: DataFrame, words: int, percent: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their set keys, classes, components of classes), all written to the shared folder."""
    spark, made, placed_in = source.sparkSession, [], []
    rows = materialize(_sketches(spread(source), words), "sketches")
    able = rows.where("n > 0 AND doc IS NOT NULL")
    classes = materialize(able.groupBy("set_key").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    shape = classes.select("rep", "n", "sketch")
    keys = _list_keys(shape, percent)
    # Copies of one text share dozens of values: lists of the same members, told by two hashes, are one list.
    told = [F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"told_{k}") for k in range(2)]
    shared_lists = keys.groupBy("v").agg(F.count("*").alias("m"), *told).where("m > 1").groupBy("m", "told_0", "told_1").agg(F.min("v").alias("v")).select("v", "m")
    keys = materialize(keys.join(shared_lists, "v"), "list-keys", made)
    full = materialize(_full_sets(source, keys.select("rep").distinct(), words), "full-sets", made)
    parts = spark.createDataFrame([], "rep long, component long")
    release(spark)
    for turn in range(rounds):
        placed = _place(keys, parts)
        # First one order of the classes for all lists: lists of one group choose the same pivot. What it leaves apart meets
        # several, as lists go by different orders.
        turn_hash = F.xxhash64(F.lit(turn), F.pmod("v", F.lit(ORDERS if turn else 1)), "rep")
        pivot = placed.groupBy("v").agg(F.min_by(F.struct("rep", "component"), F.struct(turn_hash, "rep")).alias("p"), F.first("m").alias("m"))
        pivot = pivot.select("v", F.col("p.rep").alias("a"), F.col("p.component").alias("its"), "m")
        # A class is in few lists, but it may lead some of many members.
        heads = materialize(pivot.groupBy("a").agg(_copies(F.sum("m")).alias("copies")), "heads", made)
        leads = pivot.join(heads, "a").select("v", "a", "its", "copies", _dealt(_copies(F.col("m"))))
        pairs = placed.withColumn("lot", _lot(_copies(F.col("m")), "rep")).join(leads, ["v", "lot"]).where("component <> its").select("a", F.col("rep").alias("b"), "copies").distinct()
        links = materialize(_verify(_near_enough(pairs, heads, shape, percent), heads, full, percent), "links", made)
        parts = _join_parts(parts, links, placed_in)
        release(spark)
    late = materialize(_between(_place(keys, parts), full, percent, made), "links-between", made)
    parts = _join_parts(parts, late, placed_in)
    drop_dirs(spark, made)
    release(spark)
    return rows, classes, parts


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    Words are maximal runs without white space (blank, tab, line ends), A-Z in lower case. Two documents are linked if
    the intersection of their shingle sets is at least ``percent`` per cent of the union; ``component_id`` is the least id
    that links reach. Null, empty and wordless texts have an empty set and are linked with nothing. Rows with a null id
    get a null component and are kept. An id names one document: rows that repeat it are one node of the graph, each with
    the links of its own text, and share its component. A text of any length is one row's work; equal sets, however many,
    are one class. An empty table gives no rows; other columns are neither read nor returned, whatever their names. Ids
    must be integers.

    ``rounds`` of pivots change the cost, not the result. Sketches may lose a link: a pair right at the threshold, both
    sets of more than LISTED shingles, misses the lists with a chance under LIST_RISK and the estimate with one under
    ESTIMATE_RISK, more similar pairs far more rarely; smaller sets ask for the worst case, and equal sets are joined
    exactly. Links that are returned are always true, being verified on the full sets.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("body"))
    with arrow_rows(spark, 500):
        rows, classes, parts = _components_of(source, words, percent, rounds)
    placed = classes.select("set_key", "rep").join(parts, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc", "n", "set_key").join(placed.withColumnRenamed("set_key", "its_key"), (F.col("set_key") == F.col("its_key")) & (F.col("n") > 0) & F.col("doc").isNotNull(), "left")
    component = F.coalesce("component", "doc")
    return out.select(
        F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )
