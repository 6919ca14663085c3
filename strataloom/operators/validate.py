"""Constraints as queries: each returns violations (path, message); no rows mean that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import KIND_RANKS, chains

RELATION_KINDS = ("uses", "calls", "reads", "writes", "publishes", "subscribes", "contains", "dependsOn", "returns", "duplicates")


def issue(df: DataFrame, path: Column, message: str) -> DataFrame:
    return df.select(path.alias("path"), F.lit(message).alias("message"))


def at(table: str, key: str) -> Column:
    return F.concat(F.lit(f"{table}/"), F.coalesce(F.col(key).cast("string"), F.lit("null")))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def unique(df: DataFrame, table: str, key: str) -> DataFrame:
    return issue(df.groupBy(key).count().where("count > 1"), at(table, key), "duplicate id")


def foreign(df: DataFrame, table: str, key: str, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    known = parents.select(F.col(parent_key).alias("_k")).distinct()
    lost = df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_k"), "left_anti")
    return issue(lost, at(table, key), f"unknown {column}")


def holds(df: DataFrame, table: str, key: str, rule: Column, message: str) -> DataFrame:
    """Rows for which a rule is false; null passes, absent values being checked on their own."""
    return issue(df.where(~F.coalesce(rule, F.lit(True))), at(table, key), message)


def acyclic(entities: DataFrame) -> DataFrame:
    """Entities on or below a containment cycle, of any length: those whose chain of ancestors comes back to one of them."""
    lost = chains(entities).where("back IS NOT NULL").select("id").distinct()
    return issue(lost, at("entities", "id"), "containment cycle")


def snapshot(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """All rules of a snapshot: ids, parents, ends, kinds, cycles, clone pairs."""
    kinds = entities.select(F.col("id").alias("k"), F.col("kind").alias("k_kind"))
    clones = relations.where("kind = 'duplicates'").join(kinds, F.col("from_id") == F.col("k")).withColumnRenamed("k_kind", "from_kind").drop("k").join(kinds, F.col("to_id") == F.col("k"))
    return all_of(
        unique(entities, "entities", "id"),
        unique(relations, "relations", "id"),
        foreign(entities, "entities", "id", "parent_id", entities, "id"),
        foreign(relations, "relations", "id", "from_id", entities, "id"),
        foreign(relations, "relations", "id", "to_id", entities, "id"),
        holds(entities, "entities", "id", F.col("kind").isin(*KIND_RANKS), "unknown kind"),
        holds(entities, "entities", "id", F.col("parent_id") != F.col("id"), "contains itself"),
        holds(relations, "relations", "id", F.col("kind").isin(*RELATION_KINDS), "unknown kind"),
        holds(clones, "relations", "id", (F.col("from_kind") == "code") & (F.col("k_kind") == "code"), "duplicates joins code only"),
        acyclic(entities),
    )


def increasing(df: DataFrame, table: str, parts: list[str], order: str, key: str) -> DataFrame:
    """Rows whose value does not exceed the one before it, in the order of ``key``."""
    from pyspark.sql import Window

    before = F.lag(order).over(Window.partitionBy(*parts).orderBy(key))
    return issue(df.withColumn("_b", before).where(F.col("_b") >= F.col(order)), at(table, key), f"{order} must increase")


def accepted(docs: DataFrame, violations: DataFrame, key: str) -> DataFrame:
    """Documents without a violation (column ``key``): all of a document is taken or none."""
    return docs.join(violations.select(key).distinct(), key, "left_anti")


#: Bounds of an extraction, the parents that each kind may have, and the first part of its ids.
LIMITS = {"id": 192, "name": 160, "responsibility": 2000, "label": 240, "technology": 120}
PARENT_KINDS = {"container": ("softwareSystem",), "dataStore": ("softwareSystem",), "queue": ("softwareSystem",), "component": ("container", "dataStore", "queue"), "code": ("component",)}
ID_PREFIXES = {"person": ("person", "actor"), "softwareSystem": ("system",), "container": ("container",), "component": ("component",), "code": ("code",), "externalSystem": ("external",), "dataStore": ("data", "data-store"), "queue": ("queue",)}
STABLE_ID = r"^[a-z][a-z0-9]*(:[a-z0-9]+(-[a-z0-9]+)*)+$"


def _text(df: DataFrame, table: str, column: str, most: int, required: bool = False) -> DataFrame:
    rule = F.length(column) <= most
    if required:
        rule = F.coalesce(rule & (F.trim(column) != ""), F.lit(False))
    return holds(df, table, "id", rule, f"{column} is missing or too long" if required else f"{column} is too long")


def extraction(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """The gate of an extraction: entities (id, kind, parent_id, name, responsibility), relations (id, from_id, to_id, kind,
    label, technology, evidence).

    Ids, kinds and lengths; the hierarchy of kinds, its cycles; ends of relations, self relations other than calls, evidence,
    and containment that the hierarchy tells already.
    """
    kind = F.col("kind")
    prefix = F.split_part("id", F.lit(":"), F.lit(1))
    fits = F.lit(False)
    for k, prefixes in ID_PREFIXES.items():
        fits = fits | ((kind == k) & prefix.isin(*prefixes))
    parents = entities.select(F.col("id").alias("p"), F.col("kind").alias("p_kind"), F.col("parent_id").alias("pp")).dropDuplicates(["p"])
    under = entities.join(parents, F.col("parent_id") == F.col("p"), "left")
    nested, allowed = kind.isin(*PARENT_KINDS), F.lit(False)
    for k, kinds in PARENT_KINDS.items():
        allowed = allowed | ((kind == k) & F.col("p_kind").isin(*kinds))
    both = relations.join(parents.select(F.col("p").alias("from_id"), F.col("pp").alias("from_parent")), "from_id", "left").join(parents.select(F.col("p").alias("to_id"), F.col("pp").alias("to_parent")), "to_id", "left")
    told = F.coalesce((kind == "contains") & ((F.col("to_parent") == F.col("from_id")) | (F.col("from_parent") == F.col("to_id"))), F.lit(False))
    return all_of(
        unique(entities, "entities", "id"),
        unique(relations, "relations", "id"),
        holds(entities, "entities", "id", F.coalesce(kind.isin(*ID_PREFIXES), F.lit(False)), "unknown kind"),
        holds(entities.where(kind.isin(*ID_PREFIXES)), "entities", "id", F.col("id").rlike(STABLE_ID) & fits & (F.length("id") <= LIMITS["id"]), "malformed id"),
        _text(entities, "entities", "name", LIMITS["name"], required=True),
        _text(entities, "entities", "responsibility", LIMITS["responsibility"]),
        holds(under, "entities", "id", ~nested | F.col("parent_id").isNotNull(), "needs a parent"),
        foreign(entities, "entities", "id", "parent_id", entities, "id"),
        holds(under.where(nested & F.col("p").isNotNull()), "entities", "id", allowed, "wrong kind of parent"),
        holds(entities, "entities", "id", nested | F.col("parent_id").isNull(), "must be at the top"),
        acyclic(entities),
        foreign(relations, "relations", "id", "from_id", entities, "id"),
        foreign(relations, "relations", "id", "to_id", entities, "id"),
        holds(relations, "relations", "id", F.coalesce(kind.isin(*RELATION_KINDS), F.lit(False)), "unknown kind"),
        _text(relations, "relations", "label", LIMITS["label"]),
        _text(relations, "relations", "technology", LIMITS["technology"]),
        holds(relations, "relations", "id", (F.col("from_id") != F.col("to_id")) | (kind == "calls"), "joins an entity with itself"),
        holds(relations, "relations", "id", F.coalesce(F.col("evidence") >= 1, F.lit(False)), "has no evidence"),
        holds(relations, "relations", "id", F.col("evidence") <= 64, "has too much evidence"),
        holds(both, "relations", "id", ~told, "repeats the hierarchy"),
    )


def view(entities: DataFrame, relations: DataFrame, shown: DataFrame, edges: DataFrame, nodes: DataFrame, routes: DataFrame, root: str) -> DataFrame:
    """Rules of a view on a snapshot: ``shown`` (id), ``edges`` (id), ``nodes`` (id, x, y, width, height), ``routes`` (id, points).

    The root and all that is shown are known and shown once, have a place of positive size, edges join shown entities, and
    nothing has a place or route that is not shown.
    """
    lone = entities.sparkSession.createDataFrame([(root,)], "id string")
    ends = edges.select("id").join(relations.select("id", "from_id", "to_id"), "id")
    seen = shown.select(F.col("id").alias("s")).distinct()
    apart = ends.join(seen, F.col("from_id") == F.col("s"), "left_anti").select("id").unionAll(ends.join(seen, F.col("to_id") == F.col("s"), "left_anti").select("id")).distinct()
    lost = lambda df, table, message, known: issue(df.join(known.select(F.col("id").alias("k")).distinct(), F.col("id") == F.col("k"), "left_anti"), at(table, "id"), message)
    return all_of(
        lost(lone, "root", "is not in the snapshot", entities),
        lost(lone, "root", "is not shown", shown),
        unique(shown, "shown", "id"),
        lost(shown, "shown", "unknown entity", entities),
        lost(shown, "nodes", "has no place", nodes),
        lost(nodes, "nodes", "is not shown", shown),
        holds(nodes, "nodes", "id", F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & ~F.isnan(F.col("x") + F.col("y")), F.lit(False)), "bad rectangle"),
        lost(edges, "edges", "unknown relation", relations),
        issue(apart, at("edges", "id"), "ends are not shown"),
        lost(routes, "routes", "is not shown", edges),
        holds(routes, "routes", "id", F.col("points") >= 2, "needs two points"),
    )


#: What dependency facts may say.
ECOSYSTEMS = ("npm", "cargo")


def dependency_facts(packages: DataFrame, declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """Rules of packages (id, ecosystem, name, manifest), declarations (id, ecosystem, dependency, declared_in, line) and
    imports (id, ecosystem, dependency, path, imported_by, start_line, end_line)."""
    from ..functions.text import safe_path

    named = lambda df, table, c: holds(df, table, "id", F.coalesce(F.trim(c) != "", F.lit(False)) & ~F.col(c).rlike(r"[\x00-\x1F\x7F]"), f"{c} is missing")
    known = lambda df, table: holds(df, table, "id", F.coalesce(F.col("ecosystem").isin(*ECOSYSTEMS), F.lit(False)), "unknown ecosystem")
    return all_of(
        known(packages, "packages"),
        known(declarations, "declarations"),
        known(imports, "imports"),
        named(packages, "packages", "name"),
        named(declarations, "declarations", "dependency"),
        named(imports, "imports", "dependency"),
        holds(packages, "packages", "id", F.coalesce(safe_path(F.col("manifest")), F.lit(False)), "unsafe path"),
        holds(imports, "imports", "id", F.coalesce(safe_path(F.col("path")), F.lit(False)), "unsafe path"),
        foreign(declarations, "declarations", "id", "declared_in", packages, "manifest"),
        foreign(imports, "imports", "id", "imported_by", packages, "manifest"),
        holds(declarations, "declarations", "id", F.col("line") >= 1, "line must be positive"),
        holds(imports, "imports", "id", (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), "bad lines"),
    )


def excerpt_matches(excerpt: Column, ref: Column) -> Column:
    """Whether an excerpt (path, revision, symbol, start, end, source_start, source_end) is that of a source reference (path,
    revision, symbol, start, end): a cut one keeps the whole range that it was cut from."""
    e, r = (lambda f: excerpt[f]), (lambda f: ref[f])
    same = (e("path") == r("path")) & (e("revision") == r("revision")) & (F.coalesce(e("symbol"), F.lit("")) == F.coalesce(r("symbol"), F.lit("")))
    whole = (r("start") == e("start")) & (r("end") == e("end"))
    cut = e("source_start").isNotNull() & e("source_end").isNotNull() & (e("source_start") >= 1) & (e("source_start") <= e("start")) & (e("source_end") >= e("end"))
    cut = cut & (r("start") == e("source_start")) & (r("end") == e("source_end"))
    plain = e("source_start").isNull() & e("source_end").isNull()
    return F.coalesce(same & F.when(plain, whole).otherwise(cut), F.lit(False))


#: Bounds of an explanation's prose, diagram and table.
SUMMARY_CHARS, SUMMARY_BULLETS, KEY_POINTS, KEY_POINT_CHARS = 600, 6, (2, 5), 220
DIAGRAM_NODES, DIAGRAM_LINES, DIAGRAM_CHARS = 12, 40, 2000
CAPTION_CHARS, TABLE_COLUMNS, HEADING_CHARS, TABLE_ROWS, CELL_CHARS = 120, (2, 4), 40, (1, 8), 160
#: Elements that act without attributes, and other known ones.
ACTIVE = "script style iframe frame frameset object embed applet svg math noscript marquee template base meta portal xmp plaintext"
KNOWN = (
    "a abbr address area article aside audio b bdi bdo blockquote body br button canvas caption cite code col colgroup data datalist dd del details dfn dialog div dl dt em fieldset figcaption figure font"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html i img input ins kbd label legend li link main map mark menu meter nav ol optgroup option output p param picture pre progress q rp rt ruby s samp"
    " search section select slot small source span strong sub summary sup table tbody td textarea tfoot th thead time title tr track u ul var video wbr"
)
_ELEMENT = lambda names: "(?:" + "|".join(names.split()) + ")"


def active_markup(text: Column) -> Column:
    """Whether a text, code spans aside, holds markup that acts: comments, acting elements, or tags with attributes.

    A bare mention of another element is a word.
    """
    bare = F.regexp_replace(text, r"`[^`\n]*`", " ")
    acting = rf"</?{_ELEMENT(ACTIVE)}(?:[\s/][^<>]*)?>"
    valued = r"</?[a-z][a-z0-9-]*(?:[\s/][^<>]*)?[\s/][a-z_:][-\w:.]*\s*=[^<>]*>"
    filled = rf"</?{_ELEMENT(KNOWN + ' ' + ACTIVE)}[\s/][\s/]*[^\s/<>][^<>]*>"
    return bare.rlike(f"(?i)<!--|{acting}|{valued}|{filled}")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def first_fault(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that is broken; null where none is."""
    out = F.when(F.lit(False), "")
    for broken, name in rules:
        out = out.when(F.coalesce(broken, F.lit(False)), name)
    return out


def explanations(df: DataFrame) -> DataFrame:
    """(id, fault) of explanations (id, summary, key_points): missing or too long prose, too many bullets, markup, key points."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    points = F.filter(F.transform("key_points", lambda p: F.regexp_replace(plain(p), r"^(?:[-*•]|\d+[.)])\s+", "")), lambda p: p != "")
    text = _trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace("summary", "\r\n?", "\n"), r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))
    bullets = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*]\s+"), F.lit(0)))
    d = df.withColumns({"_text": text, "_points": points, "_bullets": bullets})
    fault = first_fault(
        (F.col("_text").isNull() | (F.col("_text") == ""), "no summary"), (active_markup(F.col("_text")), "markup"), (F.length("_text") > SUMMARY_CHARS, "long summary"), (F.col("_bullets") > SUMMARY_BULLETS, "bullets"),
        (F.col("key_points").isNull(), "no key points"), (F.exists("_points", active_markup), "markup"), (F.exists("_points", lambda p: F.length(p) > KEY_POINT_CHARS), "long key point"), (~F.size("_points").between(*KEY_POINTS), "key points"),
    )
    return d.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def tables(df: DataFrame) -> DataFrame:
    """(id, fault) of tables (id, caption, columns, rows): bounds of caption, headings, rows and cells, equal widths, no markup."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    d = df.withColumns({"_head": F.transform("columns", plain), "_rows": F.transform("rows", lambda r: F.transform(r, plain)), "_caption": plain(F.coalesce("caption", F.lit("")))})
    texts = F.concat(F.array("_caption"), F.col("_head"), F.flatten("_rows"))
    fault = first_fault(
        (F.col("columns").isNull() | F.col("rows").isNull(), "parts"), (F.length("_caption") > CAPTION_CHARS, "caption"), (~F.size("_head").between(*TABLE_COLUMNS), "columns"),
        (F.exists("_head", lambda h: h.isNull() | (h == "") | (F.length(h) > HEADING_CHARS)), "headings"), (~F.size("_rows").between(*TABLE_ROWS), "rows"),
        (F.exists("_rows", lambda r: r.isNull() | (F.size(r) != F.size("_head"))), "widths"), (F.exists("_rows", lambda r: F.exists(r, lambda c: c.isNull() | (F.length(c) > CELL_CHARS))), "cells"), (F.exists(texts, active_markup), "markup"),
    )
    return d.select("id", fault.alias("fault")).where("fault IS NOT NULL")


#: What a flow chart may not hold, by name.
_FORBIDDEN = {
    "directive": "%%", "shape data": r"@\{", "shorthand": ":::", "address": r"(?i)\b(https?|ftp|file|data|javascript)\s*:|//",
    "styling": r"(?im)(^|;)\s*(click|style|class|classDef|linkStyle)\b",
}


def flowcharts(df: DataFrame) -> DataFrame:
    """(id, fault) of diagrams (id, source): one flow chart, left to right or top down, plain, labelled for readers, and small."""
    clean = _trimmed(F.regexp_replace("source", "\r\n?", "\n"))
    inner = F.regexp_extract(clean, r"(?s)\A```(?:mermaid)?[ \t]*\n(.*?)\n```\z", 1)
    lines = F.filter(F.transform(F.split(F.when(inner != "", _trimmed(inner)).otherwise(clean), "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: F.trim(x) != "")
    d = df.withColumn("_lines", lines).withColumn("_rest", F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))).withColumn("_all", F.array_join("_lines", "\n"))
    # Names of nodes are what is left of a statement without labels, texts and arrows.
    said = F.filter(F.transform("_rest", lambda x: F.trim(x)), lambda x: ~x.rlike(r"^(subgraph|end|direction)\b"))
    bare = F.transform(said, lambda x: F.regexp_replace(x, r'"[^"]*"|\|[^|]*\||\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|--[^->]*?-->|<?[-=.]{2,}>?|[&;]', " "))
    nodes = F.array_distinct(F.flatten(F.transform(bare, lambda x: F.regexp_extract_all(x, F.lit(r"[A-Za-z_][\w-]*"), F.lit(0)))))
    any_tag = rf"(?i)<!--|</?{_ELEMENT(KNOWN + ' ' + ACTIVE)}(?:[\s/][^<>]*)?>"
    fault = first_fault(
        (F.col("source").isNull(), "no source"), (~F.coalesce(F.trim(F.get("_lines", F.lit(0))).rlike(r"^flowchart\s+(LR|TB|TD)\s*;?$"), F.lit(False)), "header"), (F.length("_all") > DIAGRAM_CHARS, "characters"), (F.size("_lines") > DIAGRAM_LINES, "lines"),
        *((F.col("_all").rlike(p), name) for name, p in _FORBIDDEN.items()), (F.exists("_rest", lambda x: x.rlike(r"(?i)(^|;)\s*(flowchart|graph)\b")), "second header"),
        (F.col("_all").rlike(any_tag) | active_markup(F.col("_all")), "markup"), (F.col("_all").rlike(r"\b(system|container|component|code|external|softwareSystem|externalSystem|relation):[\w./-]+"), "ids"), (F.size(nodes) > DIAGRAM_NODES, "nodes"),
    )
    return d.select("id", fault.alias("fault")).where("fault IS NOT NULL")
