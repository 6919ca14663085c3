"""Claims of explanations: what they cite is resolved, and stored ones are held against the prose and evidence they came from.

Explanations are (id, summary, key_points, claims); a claim is (id, text, origin, index, evidence), and evidence a list of
(entity_id, path, start_line, end_line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Claims of an explanation, evidence of a claim, and the least characters of a sentence that claims something.
MOST_CLAIMS, MOST_EVIDENCE, LEAST_CHARS = 8, 3, 12
_REF = ("entity_id", "path", "start_line", "end_line")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_sentences(summary: Column, text: Column) -> Column:
    """Whether a text is whole sentences of a summary, blanks aside: a fragment can turn what is said into its opposite.

    It begins the summary or follows the end of a sentence, and it ends a sentence or the summary.
    """
    quoted = F.concat(F.lit(r"\Q"), F.replace(collapsed(text), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return (F.length(collapsed(text)) >= LEAST_CHARS) & F.rlike(collapsed(summary), F.concat(F.lit(r"(?:^|[.!?] )"), quoted, F.lit(r"(?:\z|(?<=[.!?]) )")))


def claim_id(origin: Column, text: Column, evidence: Column) -> Column:
    """The name of a claim: a hash of its origin, its words and its evidence, wherever in the prose it stands."""
    refs = F.transform(evidence, lambda e: F.struct(*(e[c].alias(c) for c in sorted(_REF))))
    return F.concat(F.lit("c"), F.substring(F.sha2(F.to_json(F.struct(refs.alias("evidence"), origin.alias("origin"), text.alias("text"))), 256), 1, 20))


def revalidate(explanations: DataFrame) -> DataFrame:
    """(id, position, claim, state) of all stored claims: valid, or why not.

    States: too many (beyond the eighth), malformed, evidence (none, or more than three), key point (not the one at its index),
    sentence (not whole sentences of the summary), or id (not that of its words and evidence). Explanations without claims
    have no rows; a null summary or list holds nothing.
    """
    each = explanations.select("id", "summary", "key_points", F.posexplode("claims").alias("position", "c"))
    c = F.col("c")
    broken = c.isNull() | c["id"].isNull() | c["text"].isNull() | c["index"].isNull() | ~F.coalesce(c["origin"].isin("keyPoint", "summary"), F.lit(False))
    said = F.coalesce(F.get("key_points", c["index"].cast("int")) == c["text"], F.lit(False)) & (c["index"] >= 0)
    state = (
        F.when(F.col("position") >= MOST_CLAIMS, "too many").when(broken, "malformed").when(~F.coalesce(F.size(c["evidence"]).between(1, MOST_EVIDENCE), F.lit(False)) | F.exists(c["evidence"], lambda e: e.isNull()), "evidence")
        .when((c["origin"] == "keyPoint") & ~said, "key point").when((c["origin"] == "summary") & ~F.coalesce(is_sentences(F.col("summary"), c["text"]), F.lit(False)), "sentence")
        .when(c["id"] != claim_id(c["origin"], c["text"], c["evidence"]), "id").otherwise("valid")
    )
    return each.select("id", "position", c["id"].alias("claim"), state.alias("state"))


def resolve_evidence(cited: DataFrame, allowed: DataFrame) -> DataFrame:
    """``cited`` (id, n, entity_id, path, start_line, end_line) with ``found``: the allowed reference (same columns without n) it means.

    An equal one first. Else those of its entity whose lines equal the given ones and whose path does, hyphens and underscores
    being one; of several, the only one with its very lines, then the only one with its very path. Otherwise null.
    References are joined by explanation and entity; one without an entity must be equal.
    """
    a = allowed.select(F.col("id").alias("a_id"), F.struct(*_REF).alias("a")).distinct()
    own = cited.withColumn("r", F.struct(*_REF))
    r, x = F.col("r"), F.col("a")
    both = own.join(a, (F.col("id") == F.col("a_id")) & r["entity_id"].eqNullSafe(x["entity_id"]), "left")
    fold = lambda c: F.translate(c, "_", "-")
    same = lambda c: r[c].eqNullSafe(x[c])
    lines = lambda c: r[c].isNull() | F.coalesce(r[c] == x[c], F.lit(False))
    fits = x.isNotNull() & r["entity_id"].isNotNull() & lines("start_line") & lines("end_line") & (r["path"].isNull() | F.coalesce(fold(r["path"]) == fold(x["path"]), F.lit(False)))
    equal = x.isNotNull() & same("path") & same("start_line") & same("end_line")
    pick = lambda when: F.min(F.when(when, x))
    near = fits & same("start_line") & same("end_line")
    named = fits & same("path")
    groups = both.groupBy("id", "n", "r").agg(
        pick(equal).alias("equal"), F.count_if(fits).alias("n_fits"), pick(fits).alias("fit"), F.count_if(near).alias("n_near"), pick(near).alias("near"), F.count_if(named).alias("n_named"), pick(named).alias("named")
    )
    found = F.when(F.col("equal").isNotNull(), F.col("equal")).when(F.col("n_fits") == 1, F.col("fit")).when(F.col("n_near") == 1, F.col("near")).when(F.col("n_named") == 1, F.col("named"))
    return groups.select("id", "n", *(r[c].alias(c) for c in _REF), found.alias("found"))


def map_claims(cited: DataFrame, allowed: DataFrame, statements: DataFrame) -> DataFrame:
    """(id, origin, index, text, state, claim, evidence): statements of an answer as claims over resolved evidence.

    ``statements`` are (id, origin, index, text, summary, refs): ``refs`` are places in the answer's own ``cited`` list (n, from
    0). Evidence is that of its references, in their order, each once. States: no evidence, too much evidence, evidence (a
    reference that is not cited or means nothing allowed), sentence, repeated (an earlier claim has the same id), too many
    (beyond eight), or valid.
    """
    found = resolve_evidence(cited, allowed).select(F.col("id").alias("f_id"), F.col("n").alias("f_n"), "found")
    s = statements.withColumn("size", F.coalesce(F.size("refs"), F.lit(0)))
    refs = s.select("id", "origin", "index", F.posexplode("refs").alias("k", "n")).join(found, (F.col("id") == F.col("f_id")) & (F.col("n") == F.col("f_n")), "left")
    held = refs.groupBy("id", "origin", "index").agg(F.sort_array(F.collect_list(F.when(F.col("found").isNotNull(), F.struct("k", "found")))).alias("got"))
    both = s.join(held, ["id", "origin", "index"], "left").withColumn("evidence", F.array_distinct(F.transform(F.coalesce("got", F.array().cast("array<struct<k: int, found: struct<entity_id: string, path: string, start_line: int, end_line: int>>>")), lambda g: g["found"])))
    spoken = F.when(F.col("origin") == "summary", collapsed(F.col("text"))).otherwise(F.col("text"))
    first = (
        F.when((F.col("origin") == "summary") & ~F.coalesce(is_sentences(F.col("summary"), F.col("text")), F.lit(False)), "sentence")
        .when(F.col("size") == 0, "no evidence").when(F.col("size") > MOST_EVIDENCE, "too much evidence").when(F.size("got") < F.col("size"), "evidence")
    )
    both = both.withColumn("text", spoken).withColumn("fault", first).withColumn("claim", F.when(F.col("fault").isNull(), claim_id(F.col("origin"), F.col("text"), F.col("evidence"))))
    # Sentences come before key points; an id counts once, and eight ids in all.
    order = [F.col("origin").desc(), "index"]
    both = both.withColumn("again", F.row_number().over(Window.partitionBy("id", "claim").orderBy(*order)))
    state = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("again") > 1, "repeated")
    both = both.withColumn("state", state).withColumn("nth", F.count_if(F.col("state").isNull()).over(Window.partitionBy("id").orderBy(*order)))
    return both.select("id", "origin", "index", "text", F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("nth") > MOST_CLAIMS, "too many").otherwise("valid").alias("state"), "claim", "evidence")
