"""Graph operators over entities (id, kind, rank, parent_id, name) and relations (id, from_id, to_id, kind, ...)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The rank of each kind, coarse to fine.
KIND_RANKS = {"person": 0, "softwareSystem": 0, "externalSystem": 0, "boundary": 0, "container": 1, "dataStore": 1, "queue": 1, "component": 2, "code": 3}
BANDS = ("context", "container", "component", "code")
#: Nodes of a frontier that are few enough to be sent to all tasks.
FEW_NODES = 10_000


def kind_rank(kind: Column) -> Column:
    """Rank of a kind; null for an unknown one."""
    out = F.lit(None).cast("int")
    for k, r in KIND_RANKS.items():
        out = F.when(kind == k, r).otherwise(out)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder in the shared one that ``spark.checkpoint.dir`` names, or below the warehouse, which executors share too,
    where the setting is missing."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def shared(df: DataFrame) -> DataFrame:
    """Cut the lineage of rows that are read again and again: a checkpoint in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like :func:`shared` as columns in Parquet: for many rows, of which readers want some columns."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chains(entities: DataFrame) -> DataFrame:
    """(id, chain, back): each entity and its ancestors, nearest first; ``back`` is the ancestor that would come twice.

    Chains are doubled each round by joining each with that of its last ancestor, until none grows any more: a tree of any
    height takes the logarithm of it in rounds. Where ids repeat, each row has its own chain.
    """
    parents = entities.select(F.col("parent_id").alias("id")).distinct()
    # Only what has children is climbed; leaves, most of a tree, are hung below it once.
    top = _climbed(entities.join(parents, "id", "left_semi"))
    far = top.select(F.col("id").alias("f_id"), F.col("chain").alias("f_chain"), "back")
    leaves = entities.join(parents, "id", "left_anti").select("id", "parent_id").join(far, F.col("parent_id") == F.col("f_id"), "left")
    own = F.array("id")
    return shared(top.unionByName(leaves.select("id", F.when(F.col("f_id").isNotNull(), F.concat(own, "f_chain")).otherwise(own).alias("chain"), "back")))


def _climbed(entities: DataFrame) -> DataFrame:
    """:func:`chains` by doubling."""
    now = entities.select("id", F.array("id").alias("chain"), F.col("parent_id").alias("up"), F.lit(None).cast(entities.schema["id"].dataType).alias("back"))
    turn = 0
    while True:
        far = now.select(F.col("id").alias("f_id"), F.col("chain").alias("f_chain"), F.col("up").alias("f_up"), F.col("back").alias("f_back"))
        step = now.join(far, F.col("up") == F.col("f_id"), "left")
        # The first ancestor that is in the chain already ends it.
        step = step.withColumn("again", F.filter("f_chain", lambda x: F.array_contains("chain", x)))
        twice = F.get("again", F.lit(0))
        more = F.when(twice.isNull(), F.col("f_chain")).otherwise(F.slice("f_chain", F.lit(1), F.array_position("f_chain", twice).cast("int") - 1))
        grown = F.col("f_id").isNotNull()
        now = step.select(
            "id",
            F.when(grown, F.concat("chain", more)).otherwise(F.col("chain")).alias("chain"),
            F.when(grown & twice.isNull(), F.col("f_up")).alias("up"),  # an unknown parent ends the chain
            F.when(grown, F.coalesce(twice, F.col("f_back"))).otherwise(F.col("back")).alias("back"),
        )
        turn += 1
        if turn < 3:
            continue  # the usual four levels take two rounds and one that finds the roots
        now = shared(now)
        if now.where("up IS NOT NULL").isEmpty():
            return now.select("id", "chain", "back")


def closure(entities: DataFrame) -> DataFrame:
    """(id, ancestor_id, depth), each entity being its own ancestor at depth 0. A cycle ends where it meets an entity again."""
    return chains(entities).select("id", F.posexplode("chain").alias("depth", "ancestor_id")).select("id", "ancestor_id", "depth")


def band_representatives(entities: DataFrame, ranks: list[int]) -> DataFrame:
    """(id, reps): for each of ``ranks`` the struct (i, r) of the nearest ancestor or self no finer than it and no boundary and of its
    rank; else of the topmost one."""
    up = closure(entities)
    own = entities.select(F.col("id").alias("ancestor_id"), F.col("rank").alias("a_rank"), F.col("kind").alias("a_kind"))
    # Others are looked up among what has children; all entities meet only themselves, merged by id.
    inner = own.join(entities.select(F.col("parent_id").alias("ancestor_id")).distinct(), "ancestor_id", "left_semi")
    up = up.where("depth = 0").join(own.hint("merge"), "ancestor_id").unionByName(up.where("depth > 0").join(inner, "ancestor_id"))

    def nearest(rank: int) -> Column:
        fits = (F.col("a_rank") <= rank) & (F.col("a_kind") != "boundary")
        # Fitting ancestors first, nearest of them; without one the farthest.
        order = F.struct(F.when(fits, 0).otherwise(1), F.when(fits, F.col("depth")).otherwise(-F.col("depth")))
        return F.min_by(F.struct(F.col("ancestor_id").alias("i"), F.col("a_rank").alias("r")), order).alias(f"x{rank}")

    return up.groupBy("id").agg(*map(nearest, ranks)).select("id", F.array(*(f"x{r}" for r in ranks)).alias("reps"))


def representatives(entities: DataFrame, rank: int) -> DataFrame:
    """(id, rep, rep_rank): the nearest ancestor or self no finer than ``rank`` and no boundary; else the topmost one."""
    x = F.get("reps", F.lit(0))
    return band_representatives(entities, [rank]).select("id", x["i"].alias("rep"), x["r"].alias("rep_rank"))


#: What several relations of a kind are called.
PLURALS = {
    "uses": "uses", "calls": "calls", "reads": "reads", "writes": "writes", "publishes": "publications", "subscribes": "subscriptions",
    "contains": "containment relationships", "dependsOn": "dependencies", "returns": "returns", "duplicates": "duplicates",
}


def lifted_bands(relations: DataFrame, entities: DataFrame, ranks: list[int]) -> DataFrame:
    """Relations at each band (band) of ``ranks`` with (rep_from, rep_to): dangling, coarser and self relations gone, clones only on
    the code band. The tree is climbed once and both ends are merged by id, once for all bands and never broadcast."""
    ends = band_representatives(entities, ranks).join(entities.select("id", "rank").hint("merge"), "id")
    side = lambda end: ends.select(F.col("id").alias(f"{end}_id"), F.col("reps").alias(f"reps_{end}"), F.col("rank").alias(f"rank_{end}")).hint("merge")
    # Tasks are given as a number: rows weigh many times their compressed bytes.
    n = int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = relations.repartition(n, "from_id").join(side("from"), "from_id").repartition(n, "to_id").join(side("to"), "to_id")
    bands = [F.struct(F.lit(r).alias("band"), F.get("reps_from", F.lit(k))["i"].alias("rep_from"), F.get("reps_to", F.lit(k))["i"].alias("rep_to")) for k, r in enumerate(ranks)]
    each = both.withColumn("b", F.explode(F.array(*bands))).select(*relations.columns, "rank_from", "rank_to", "b.*")
    each = each.where((F.greatest("rank_from", "rank_to") >= F.col("band")) & (F.col("rep_from") != F.col("rep_to")))
    return each.where((F.col("band") == KIND_RANKS["code"]) | (F.col("kind") != "duplicates"))


def lifted(relations: DataFrame, entities: DataFrame, rank: int) -> DataFrame:
    """Relations with (rep_from, rep_to) at a band; see :func:`lifted_bands`."""
    return lifted_bands(relations, entities, [rank]).drop("band")


def visual_edges(relations: DataFrame, entities: DataFrame, rank: int) -> DataFrame:
    """One row per (rep_from, rep_to, kind) at a band: count, kinds, labels, technologies, optional count, label."""
    up = lifted(relations, entities, rank)
    named = F.trim("label")
    named = F.when(named != "", named)
    out = up.groupBy("rep_from", "rep_to", "kind").agg(
        F.count("*").alias("count"),
        F.sort_array(F.collect_set(named)).alias("labels"),
        F.sort_array(F.collect_set("technology")).alias("technologies"),
        F.count_if("optional").alias("optional_count"),
        F.count(named).alias("named"),
        F.min("id").alias("first_id"),
    )
    plural = F.element_at(F.create_map(*(F.lit(x) for kv in PLURALS.items() for x in kv)), F.col("kind"))
    label = (
        F.when((F.size("labels") == 1) & (F.col("named") == F.col("count")), F.get("labels", F.lit(0)))
        .when(F.col("count") == 1, F.coalesce(F.get("labels", F.lit(0)), F.col("kind")))
        .otherwise(F.concat_ws(" ", F.col("count").cast("string"), F.coalesce(plural, F.col("kind"))))
    )
    return out.withColumn("label", label).drop("named")


def incident(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, direction, id, kind) of relations at the given nodes (column node); a self relation comes once."""
    out = relations.join(nodes, F.col("from_id") == F.col("node")).select("node", F.col("to_id").alias("other"), F.lit("out").alias("direction"), "id", "kind")
    back = relations.where("from_id <> to_id").join(nodes, F.col("to_id") == F.col("node")).select("node", F.col("from_id").alias("other"), F.lit("in").alias("direction"), "id", "kind")
    return out.unionAll(back)


def neighborhood(entities: DataFrame, relations: DataFrame, focus: str, max_rank: int) -> DataFrame:
    """(id, role): the focus's ancestors, its subtree down to ``max_rank`` and the roots, as a slice of the tree."""
    up = closure(entities)
    above = up.where((F.col("id") == focus) & (F.col("depth") > 0)).select(F.col("ancestor_id").alias("id"), F.lit("ancestor").alias("role"))
    below = up.where(F.col("ancestor_id") == focus).join(entities.where(F.col("rank") <= max_rank).select("id"), "id").select("id", F.lit("subtree").alias("role"))
    roots = entities.where("parent_id IS NULL").select("id", F.lit("root").alias("role"))
    order = F.when(F.col("role") == "subtree", 0).when(F.col("role") == "ancestor", 1).otherwise(2)
    return below.unionAll(above).unionAll(roots).groupBy("id").agg(F.min_by("role", order).alias("role"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, node, hops, path): for each source (column source) the canonical shortest path to each node it reaches.

    Fewest hops, then the least sequence of ids. One round per hop: the paths of the frontier are numbered in their order,
    so the least path to a node is the least number among those that lead to it, and paths themselves are neither compared
    nor carried along the edges. Nodes are dealt over blocks: the arcs to the nodes of a block meet there the numbers of the nodes
    they come from, which are sent once for each block, not for each arc. There the least are taken, and nodes that were reached
    before are dropped; only nodes that arcs lead on from are numbered again. Ends when there are none, or after ``max_hops``
    where that is given; the driver sees only counts.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = lambda c: F.pmod(F.hash(c), F.lit(n))
    arcs = written(edges.where("from_id <> to_id").groupBy("from_id", block("to_id").alias("block")).agg(F.collect_set("to_id").alias("to")))
    out = written(arcs.groupBy("from_id").agg(F.collect_set("block").alias("blocks")))
    start = lambda source, number: F.struct(source.alias("source"), number.cast("long").alias("number"))
    none, alone = F.lit(None), lambda c: F.array(F.col(c))
    frontier = sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops"), F.array("source").alias("path"), F.lit(True).alias("on")).distinct()
    seen = frontier.drop("on")
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        # Numbers ascend over sorted partitions; they are written down, as another run might cut the partitions elsewhere.
        at = written(frontier.where("on").orderBy("path").select("source", "node", "path", F.monotonically_increasing_id().alias("number")))
        starts = at.groupBy(F.col("node").alias("from_id")).agg(F.collect_list(start(F.col("source"), F.col("number"))).alias("starts")).join(out, "from_id")
        # Where few nodes are left, all else is dropped before it is dealt.
        own = arcs.join(F.broadcast(at.select(F.col("node").alias("from_id")).distinct()), "from_id", "left_semi") if at.count() <= FEW_NODES else arcs
        # What meets in a block: numbers of nodes (0), arcs of these nodes (1), pairs reached before (2), nodes to go on from (3).
        kinds = [
            starts.select(F.explode("blocks").alias("block"), "from_id", F.lit(0).alias("kind"), "starts", none.cast(arcs.schema["to"].dataType).alias("to")),
            own.select("block", "from_id", F.lit(1), none, "to"),
            seen.select(block("node"), "node", F.lit(2), F.array(start(F.col("source"), none)), alone("node")),
            out.select(block("from_id"), "from_id", F.lit(3), F.array(start(none, none)), alone("from_id")),
        ]
        rows = kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).unionAll(kinds[3]).repartitionById(n, F.col("block"))
        known = F.last(F.when(F.col("kind") == 0, F.col("starts")), True).over(Window.partitionBy("block", "from_id").orderBy("kind"))
        each = rows.withColumn("starts", F.when(F.col("kind") == 1, known).otherwise(F.col("starts"))).where("kind > 0 AND starts IS NOT NULL")
        each = each.select("block", "kind", "starts", F.explode("to").alias("next")).select("block", "kind", "next", F.explode("starts").alias("s"))
        least = each.groupBy("block", "next", "s.source").agg(F.min("s.number").alias("number"), F.max("kind").alias("kind"))
        step = least.withColumn("on", F.bool_or(F.col("kind") == 3).over(Window.partitionBy("block", "next"))).where("kind = 1").drop("block", "kind")
        grown = step.select("next", "number", "on").join(at.select("source", "path", "number"), "number")
        frontier = written(grown.select("source", F.col("next").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array("next")).alias("path"), "on"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier.drop("on"))
        if frontier.where("on").isEmpty():
            return seen
        if hop % 4 == 0:
            seen = written(seen)
    return seen


def path_status(edges: DataFrame, source: str, target: str, max_hops: int, known: DataFrame, partial: bool = False) -> DataFrame:
    """One row (status, reason, path) that says whether and how ``target`` is reached from ``source``.

    Checks in order: the query, unknown ends, equal ends, no edges, then the search, which runs past ``max_hops`` so that a
    longer path is told from none. ``known``: ids that exist (column id).
    """
    spark = edges.sparkSession
    row = lambda status, reason, path: spark.createDataFrame([(status, reason, path)], "status string, reason string, path array<string>")
    if not source or not target or max_hops < 1:
        return row("unavailable", "invalidQuery", None)
    have = {r.id for r in known.where(F.col("id").isin(source, target)).distinct().collect()}  # two rows at most
    for end, reason in ((source, "unknownFromEntity"), (target, "unknownToEntity")):
        if end not in have:
            return row("unavailable", "endpointNotLoaded" if partial else reason, None)
    if source == target:
        return row("found", None, [source])
    if edges.isEmpty():
        return row("unavailable", "noEligibleRelations", None)
    start = spark.createDataFrame([(source,)], "source string")
    hit = shortest_paths(edges, start).where(F.col("node") == target)
    none = row("unavailable", "partialGraph", None) if partial else row("unreachable", None, None)
    long = F.col("hops") > max_hops
    found = hit.select(F.when(long, "unavailable").otherwise("found").alias("status"), F.when(long, "hopLimit").alias("reason"), F.when(~long, F.col("path")).alias("path"))
    return found.unionAll(none.join(hit.select("node"), F.lit(True), "left_anti"))


def subtree_counts(entities: DataFrame) -> DataFrame:
    """(id, children, descendants), zero where there are none."""
    up = closure(entities).where("depth > 0")
    counts = up.groupBy(F.col("ancestor_id").alias("id")).agg(F.count_if(F.col("depth") == 1).alias("children"), F.count("*").alias("descendants"))
    return entities.select("id").join(counts, "id", "left").na.fill(0, ["children", "descendants"])


def degrees(relations: DataFrame) -> DataFrame:
    """(id, degree): relations at each node; a self relation counts once."""
    ends = relations.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def forest(entities: DataFrame) -> DataFrame:
    """(id, root, level, path): the containment forest; ``path`` leads from the root and sorts in preorder, children by id.

    An entity without a known parent is a root; so is the least id of each cycle, the rest of which hang below it.
    """
    c = chains(entities)
    ring = F.slice("chain", F.array_position("chain", F.col("back")).cast("int"), F.size("chain"))
    top = F.when(F.col("back").isNotNull(), F.array_min(ring))
    whole = F.when(F.col("back").isNotNull(), F.slice("chain", F.lit(1), F.array_position("chain", top).cast("int"))).otherwise(F.col("chain"))
    c = c.select("id", F.reverse(whole).alias("path"))
    return c.select("id", F.get("path", F.lit(0)).alias("root"), (F.size("path") - 1).alias("level"), "path")


def regroup(entities: DataFrame, relations: DataFrame, moves: DataFrame) -> DataFrame:
    """Relations after entities were merged by ``moves`` (old, new): ends rewritten, self relations gone, counted again."""
    side = lambda end: moves.select(F.col("old").alias(f"{end}_old"), F.col("new").alias(f"{end}_new"))
    both = relations.join(side("from"), F.col("from_id") == F.col("from_old"), "left").join(side("to"), F.col("to_id") == F.col("to_old"), "left")
    ends = both.select(F.coalesce("from_new", "from_id").alias("from_id"), F.coalesce("to_new", "to_id").alias("to_id"), "kind", "id")
    return ends.where("from_id <> to_id").groupBy("from_id", "to_id", "kind").agg(F.count("*").alias("count"), F.min("id").alias("first_id"))


def alias_fixpoint(links: DataFrame, rounds: int = 32) -> DataFrame:
    """(name, target, ambiguous): where chains of (name, target) links end; a name with several ends is ambiguous.

    Chains are doubled each round, so ``rounds`` of 32 reach any length; names on a cycle end nowhere and are left out.
    """
    now = links.select("name", "target").distinct()
    ends = now.select(F.col("target").alias("e")).distinct().join(now.select(F.col("name").alias("n")).distinct(), F.col("e") == F.col("n"), "left_anti")
    for _ in range(rounds):
        hop = now.select(F.col("name").alias("mid"), F.col("target").alias("far"))
        nxt = now.join(hop, F.col("target") == F.col("mid"), "left").select("name", F.coalesce("far", "target").alias("target")).distinct()
        nxt = shared(nxt)
        left = nxt.join(ends, F.col("target") == F.col("e"), "left_anti")
        same = nxt.exceptAll(now).isEmpty()
        now = nxt
        if left.isEmpty() or same:
            break
    done = now.join(ends, F.col("target") == F.col("e"), "left_semi")
    return done.groupBy("name").agg(F.min("target").alias("target"), (F.count_distinct("target") > 1).alias("ambiguous"))


def over(parts: list[str], order: list) -> Window:
    """A window spec by names and sort keys."""
    return Window.partitionBy(*parts).orderBy(*order)
