"""Order MinHash fingerprints, in DataFrame operations only.

The k-mers of a text are runs of consecutive words, numbered by occurrence so that repeats count. All numbered k-mers are
hashed onto one circle. Each of ``parts`` points on it starts a rotated order of the circle; the least ``keep`` k-mers of
that order are selected, put back into their order in the text, and the tuple of their hashes is hashed to one component
of the signature. The share of equal components tells how near two texts are in edit distance: exchanging passages
changes the order within tuples, which sets of k-mers alone would not show. (Marcais, DeBlasio, Pandey and Kingsford,
"Locality-sensitive hashing for the edit distance"; the rotated orders are those of densified one-permutation hashing.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .common import cuts_below, id_bounds

#: A hash of 36 bits and a position of 27 bits share one non-negative long: sorting longs is fast, and ties go by position.
_POS_BITS = 27
_POS_MASK = (1 << _POS_BITS) - 1
_HASH_BITS = 63 - _POS_BITS


def _packed(hashed: Column, pos: Column) -> Column:
    """36 bits of a hash above 27 bits of a position."""
    return F.shiftleft(hashed.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)), _POS_BITS).bitwiseOR(pos.cast("long").bitwiseAND(F.lit(_POS_MASK)))


def signature(text: Column, name: str, k: int = 3, parts: int = 32, keep: int = 2) -> list[tuple[str, Column]]:
    """Columns, to be added in this order, that end in ``name``: the signature as an array of ``parts`` integers.

    A text of fewer than ``k`` words is one k-mer; a text without words has no k-mers, and every component is 0.
    """
    c = lambda s: F.col(f"{name}_{s}")
    words = F.filter(F.split(F.lower(text), r"[\s]+"), lambda w: w != "")
    n = F.size(c("w"))
    hashes = F.transform(c("w"), lambda w: F.xxhash64(w))
    kmer = lambda i: F.xxhash64(*(F.coalesce(F.get(c("h"), i + j), F.lit(j).cast("long")) for j in range(k)))
    count = F.greatest(n - (k - 1), F.least(n, F.lit(1)))
    upto = lambda size: F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    sorted_ = F.sort_array(F.transform(upto(count), lambda i: _packed(kmer(i), i)))
    high = lambda x: F.shiftright(x, _POS_BITS)
    # Runs of one k-mer begin where the hash differs from the one before.
    size = F.size(c("s"))
    runs = F.filter(upto(size), lambda i: (i == 0) | (high(F.get(c("s"), i)) != high(F.get(c("s"), i - 1))))
    numbered = lambda x, occurrence: _packed(F.xxhash64(high(x), occurrence), x.bitwiseAND(F.lit(_POS_MASK)))
    single = F.transform(c("s"), lambda x: numbered(x, F.lit(0)))
    several = F.flatten(
        F.transform(
            c("r"),
            lambda a, j: F.transform(
                F.sequence(F.lit(0), F.coalesce(F.get(c("r"), j + 1), size) - a - 1), lambda o: numbered(F.get(c("s"), a + o), o)
            ),
        )
    )
    # The points of the circle are sorted in with the k-mers; each finds its place once.
    points = [((1 << 63) // parts * p) & ~_POS_MASK for p in range(parts)]
    lits = F.array(*(F.lit(p).cast("long") for p in points))
    first_at = F.transform(lits, lambda p: F.array_position(c("m"), p))  # from 1
    real = F.size(c("g"))
    # Before point number j there are j other points: the least k-mers at or after it begin at first_at - 1 - j in c("g").
    starts = F.transform(c("f"), lambda at, j: (at - 1 - j).cast("int"))

    def component(start: Column) -> Column:
        chosen = F.array(*(F.get(c("g"), (start + j) % real) for j in range(keep)))
        # A text of fewer k-mers than a tuple holds selects some of them again.
        swapped = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_POS_MASK)), _HASH_BITS).bitwiseOR(high(x))))
        return F.hash(F.transform(swapped, lambda x: x.bitwiseAND(F.lit((1 << _HASH_BITS) - 1))))

    return [
        (f"{name}_w", words),
        (f"{name}_h", hashes),
        (f"{name}_s", sorted_),
        (f"{name}_r", runs),
        (f"{name}_g", F.sort_array(F.when(F.size(c("r")) == size, single).otherwise(several))),
        (f"{name}_m", F.sort_array(F.concat(c("g"), lits))),
        (f"{name}_f", first_at),
        (name, F.when(real == 0, F.array_repeat(F.lit(0), parts)).otherwise(F.transform(starts, component))),
    ]


def with_signature(df: DataFrame, text: Column, name: str, **how) -> DataFrame:
    """``df`` with the signature of a text in column ``name``."""
    made = signature(text, name, **how)
    for col, expr in made:
        df = df.withColumn(col, expr)
    return df.drop(*(col for col, _ in made[:-1]))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def fingerprint_text(sig: Column) -> Column:
    """A signature as eight hexadecimal digits a component."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_next(df: DataFrame, order: str, cols: dict[str, str], rows_per_bucket: int = 4096) -> DataFrame:
    """Add columns of the row with the next lower value of ``order``, after the last row those of the first.

    ``cols``: new name by column. Ranges of ``order`` are dealt into buckets of about ``rows_per_bucket`` rows; the first
    row of each bucket is also sent to the one before, so no window reaches over a whole table. Nulls come last; equal
    values go by ``__tie``, a column that the caller adds. Nulls, and values that fill buckets alone, have no order of
    their own: they are dealt over as many buckets as they need by ``__tie``, and follow it; rows that are equal in both
    stay together.
    """
    at = F.col(order)
    many = df.groupBy(order).agg(F.count("*").alias("n")).where(F.col("n") > 4 * rows_per_bucket)
    heavy = {r[order]: r.n for r in many.collect()}  # a row for each 4 * rows_per_bucket of the table at most
    cuts = id_bounds(df, order, rows_per_bucket)
    ends = len(cuts)
    # Buckets descend: 0 holds the largest ids, the last ones the smallest and then the nulls. No join is needed to find them.
    own = df.withColumn("__bucket", F.when(at.isNull(), F.lit(ends + 1)).otherwise(F.lit(ends) - cuts_below(cuts, at)))
    if heavy:
        parts = -(-max(heavy.values()) // rows_per_bucket)
        known = F.array(*(F.lit(h).cast("long") for h in sorted(h for h in heavy if h is not None)))
        alone = F.array_contains(known, at) if len(heavy) > (None in heavy) else F.lit(False)
        alone = F.coalesce(alone, F.lit(None in heavy))
        # Above, within and below each value that has buckets of its own, descending like the rest.
        place = F.lit(parts - 1) - F.floor((F.shiftrightunsigned("__tie", 1) / float(1 << 63)) * parts)
        larger = F.coalesce(F.size(F.filter(known, lambda x: x > at)), F.lit(0))
        own = own.withColumn("__part", (larger * (parts + 1) + F.when(alone, place + 1).otherwise(0)).cast("int"))
        own = own.withColumn("__only", F.when(alone, F.shiftrightunsigned("__tie", 1)))
        own = own.withColumn("__tie", F.when(alone, F.col("__only")).otherwise(F.col("__tie")))
    else:
        own = own.withColumns({"__part": F.lit(0), "__only": F.lit(None).cast("long")})
    tops = own.groupBy("__bucket", "__part").agg(F.max(order).alias("top"), F.max("__only").alias("only")).orderBy("__bucket", "__part").collect()  # a row per bucket
    if not tops:
        return df.withColumns({new: F.lit(None).cast(df.schema[c].dataType) for c, new in cols.items()}).drop("__tie")
    # One row per bucket: id_bounds and rows_per_bucket bound the broadcast.
    before = [tops[k - 1] for k in range(len(tops))]
    marks = df.sparkSession.createDataFrame([(t.top, t.only, p["__bucket"], p["__part"]) for t, p in zip(tops, before)], "__top long, __least long, __to_bucket int, __to_part int")
    placed = own.join(F.broadcast(marks), at.eqNullSafe(F.col("__top")) & F.col("__only").eqNullSafe(F.col("__least")), "left")
    here = F.struct(F.col("__bucket").alias("b"), F.col("__part").alias("p"), F.lit(False).alias("ghost"))
    there = F.struct(F.col("__to_bucket").alias("b"), F.col("__to_part").alias("p"), F.lit(True).alias("ghost"))
    placed = placed.withColumn("__at", F.explode(F.when(F.col("__to_bucket").isNull(), F.array(here)).otherwise(F.array(here, there))))
    w = Window.partitionBy("__at.b", "__at.p").orderBy(F.col("__at.ghost"), at.desc_nulls_last(), F.col("__tie").desc())
    out = placed.withColumns({new: F.lead(c).over(w) for c, new in cols.items()})
    return out.where(~F.col("__at.ghost")).drop("__bucket", "__part", "__only", "__top", "__least", "__to_bucket", "__to_part", "__at", "__tie")


def order_minhash(docs: DataFrame, k: int = 3, parts: int = 32, keep: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, whose last third is taken from the next document.

    Returns (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The next document
    has the next lower id; after the last comes the first. Null texts count as empty; empty texts are alike (1.0). Rows
    with a null id come last; these, and rows of one id, go by a hash of their texts, equal rows in any order among
    themselves. A single row is its own next. A text of any length is one row's work, up to 2^27 words. An empty table
    gives no rows; other columns are neither read nor returned, whatever their names.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = spread(docs.select(F.col(id_col).alias("doc"), body.alias("body"))).withColumn("__tie", F.xxhash64("body"))
    how = {"k": k, "parts": parts, "keep": keep}
    own = with_signature(own, F.col("body"), "sig", **how)
    both = with_next(own, "doc", {"body": "next_body", "sig": "next_sig"})
    n = F.char_length("body")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - cut), F.substring(F.col("next_body"), F.lit(1), cut))
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    made = with_signature(both, F.col("edited"), "edited_sig", **how)
    return made.select(
        F.col("doc").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("sig")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
