"""Layout of containment trees: grids of children, sizes from the leaves up, places from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import closure, shared

#: The most columns of a plain grid, how far an owner's shape may be from a square, the space between roots.
MAX_COLUMNS, MOST_ASPECT, ROOT_GAP = 3, 2.2, 100


def plain_columns(n: Column, most: int = MAX_COLUMNS) -> Column:
    """Columns of a grid of ``n`` items: about as many as rows, ``most`` at the most."""
    return F.least(n, F.lit(most), F.greatest(F.lit(1), F.ceil(F.sqrt(n)))).cast("int")


def columns_for_aspect(n: Column, cell_w: Column, cell_h: Column, target: float, gap: float, pad_x: float, pad_y: float, cap: float = MOST_ASPECT) -> Column:
    """Columns that bring a grid of equal cells nearest to the shape ``target`` (width by height), in logarithms.

    Tried are the closed form and its two neighbours, the least of equals; if the best lies beyond ``cap``, the nearest of
    all counts within it, where there is one.
    """

    def aspect(c: Column) -> Column:
        rows = F.ceil(n / c)
        return (c * cell_w + gap * (c - 1) + pad_x) / (rows * cell_h + gap * (rows - 1) + pad_y)

    off = lambda c: F.abs(F.log(aspect(c)) - F.log(F.lit(target)))
    within = lambda c: aspect(c).between(1 / cap, cap)
    nearest = lambda cs: F.array_min(F.transform(cs, lambda c: F.struct(off(c).alias("off"), c.cast("int").alias("c"))))["c"]
    seed = F.least(n, F.greatest(F.lit(1), F.floor(F.sqrt(target * n * cell_h / cell_w) + 0.5))).cast("int")
    best = nearest(F.filter(F.array(seed - 1, seed, seed + 1), lambda c: (c >= 1) & (c <= n)))
    capped = nearest(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), within))
    return F.when(n <= 1, n.cast("int")).when(within(best), best).otherwise(F.coalesce(capped, best))


def grid(items: DataFrame, owner: str, gap: float, columns=plain_columns) -> DataFrame:
    """``items`` (owner, id, width, height) with (col, row, at_x, at_y, content_w, content_h), row by row in id order.

    Columns are as wide as their widest item, rows as high as their highest, and an item lies in the middle of its cell.
    No group is gathered: places come from windows over the owner's columns and rows.
    """
    w = Window.partitionBy(owner)
    own = items.withColumns({"_i": F.row_number().over(w.orderBy("id")) - 1, "_n": F.count("*").over(w)})
    own = own.withColumn("_c", columns(F.col("_n"))).withColumns({"col": F.col("_i") % F.col("_c"), "row": F.floor(F.col("_i") / F.col("_c")).cast("int")})

    def along(cell: str, size: str, name: str) -> DataFrame:
        per = own.groupBy(F.col(owner).alias("_o"), F.col(cell).alias(f"_{cell}")).agg(F.max(size).alias(f"_{name}"))
        line = Window.partitionBy("_o").orderBy(f"_{cell}")
        before = F.coalesce(F.sum(F.col(f"_{name}") + gap).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum(f"_{name}").over(Window.partitionBy("_o")) + gap * (F.count("*").over(Window.partitionBy("_o")) - 1)
        return per.select(F.col("_o").alias(f"_o{name}"), f"_{cell}", f"_{name}", before.alias(f"_b{name}"), total.alias(f"content_{name}"))

    both = own.join(along("col", "width", "w"), (F.col(owner) == F.col("_ow")) & (F.col("col") == F.col("_col")))
    both = both.join(along("row", "height", "h"), (F.col(owner) == F.col("_oh")) & (F.col("row") == F.col("_row")))
    return both.select(
        *items.columns,
        "col",
        "row",
        (F.col("_bw") + (F.col("_w") - F.col("width")) / 2).alias("at_x"),
        (F.col("_bh") + (F.col("_h") - F.col("height")) / 2).alias("at_y"),
        "content_w",
        "content_h",
    )


def containment_layout(entities: DataFrame, leaf: tuple[float, float], pad: float, gap: float) -> DataFrame:
    """(id, depth, x, y, width, height) of each entity (id, parent_id) of a tree.

    An owner is as large as the grid of its children with ``pad`` on all sides, an entity without children as ``leaf``.
    Sizes go up level by level, one join each; a place is the sum of the places within all owners, so it takes no walk
    down. Roots stand side by side in id order. Entities on a cycle have no root and are left out.
    """
    up = shared(closure(entities))
    known = entities.select("id")
    roots = entities.join(known.withColumnRenamed("id", "k"), F.col("parent_id") == F.col("k"), "left_anti").select(F.col("id").alias("ancestor_id"))
    depth = up.join(roots, "ancestor_id", "left_semi").select("id", F.col("depth").alias("level"))
    tree = shared(entities.select("id", "parent_id").join(depth, "id"))
    deepest = tree.agg(F.max("level")).first()[0]
    if deepest is None:
        return tree.select("id", F.col("level").alias("depth"), *(F.lit(0.0).alias(c) for c in ("x", "y", "width", "height")))
    plain = {"width": F.lit(float(leaf[0])), "height": F.lit(float(leaf[1]))}
    placed, below = None, None
    for level in range(deepest, -1, -1):
        own = tree.where(F.col("level") == level)
        if below is None:
            sized = own.withColumns(plain)
        else:
            size = below.groupBy(F.col("parent_id").alias("p")).agg((F.first("content_w") + 2 * pad).alias("w"), (F.first("content_h") + 2 * pad).alias("h"))
            sized = own.join(size, F.col("id") == F.col("p"), "left").select("id", "parent_id", "level", F.coalesce("w", plain["width"]).alias("width"), F.coalesce("h", plain["height"]).alias("height"))
        if level:
            sized = shared(grid(sized, "parent_id", gap))
            below = sized
            here = sized.select("id", "level", "width", "height", (F.col("at_x") + pad).alias("dx"), (F.col("at_y") + pad).alias("dy"))
        else:
            line = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)  # roots alone
            here = sized.select("id", "level", "width", "height", F.coalesce(F.sum(F.col("width") + ROOT_GAP).over(line), F.lit(0.0)).alias("dx"), F.lit(0.0).alias("dy"))
        placed = here if placed is None else placed.unionAll(here)
    placed = shared(placed)
    steps = up.join(placed.select(F.col("id").alias("ancestor_id"), "dx", "dy"), "ancestor_id").groupBy("id").agg(F.sum("dx").alias("x"), F.sum("dy").alias("y"))
    return placed.select("id", F.col("level").alias("depth"), "width", "height").join(steps, "id").select("id", "depth", "x", "y", "width", "height")
