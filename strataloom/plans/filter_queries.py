"""Projections, filters and predicates (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as X
from ..operators import graph as G
from .registry import query

_E, _R = f"WITH {A.ENTITIES} ", f"WITH {A.RELATIONS} "


@query("f1_kind_bands", _E + "SELECT kind, rank, CASE rank WHEN 0 THEN 'context' WHEN 1 THEN 'container' WHEN 2 THEN 'component' ELSE 'code' END AS band, count(*)::BIGINT AS n FROM entities GROUP BY ALL")
def _(t):
    e = A.entities(t)
    band = F.get(F.array(*map(F.lit, G.BANDS)), G.kind_rank(F.col("kind")))
    return e.groupBy("kind", G.kind_rank(F.col("kind")).alias("rank"), band.alias("band")).agg(F.count("*").alias("n"))


@query("f2_band_cut", _E + "SELECT id, kind FROM entities WHERE rank <= 2")
def _(t):
    return A.entities(t).where("rank <= 2").select("id", "kind")


@query("f3_strip_excerpts", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    return t.documents.drop("text")


@query(
    "f4_eligible_relations",
    f"WITH {A.ENTITIES}, {A.RELATIONS} SELECT count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL)::BIGINT AS eligible, count(*) FILTER (WHERE a.id IS NULL OR b.id IS NULL)::BIGINT AS dangling"
    " FROM relations r LEFT JOIN (SELECT id FROM entities WHERE id NOT LIKE '%7') a ON r.from_id = a.id LEFT JOIN entities b ON r.to_id = b.id WHERE r.kind IN ('uses')",
)
def _(t):
    known = A.entities(t).where(~F.col("id").endswith("7")).select("id")
    r = A.relations(t).where(F.col("kind").isin("uses"))
    ends = A.entities(t).select(F.col("id").alias("b"))
    seen = r.join(known.withColumnRenamed("id", "a"), F.col("from_id") == F.col("a"), "left").join(ends, F.col("to_id") == F.col("b"), "left")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    return seen.agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("dangling"))


@query("f5_type_only_filter", "SELECT l_suppkey AS package, count(*) FILTER (WHERE l_returnflag <> 'N')::BIGINT AS kept, count(*) FILTER (WHERE l_returnflag = 'N')::BIGINT AS excluded FROM lineitem GROUP BY 1")
def _(t):
    only = F.col("l_returnflag") == "N"
    return t.lineitem.groupBy(F.col("l_suppkey").alias("package")).agg(F.count_if(~only).alias("kept"), F.count_if(only).alias("excluded"))


@query("f6_name_match", "SELECT p_partkey, n = 'brand-12' OR replace(n, '-', '_') = 'brand_12' AND p_size % 2 = 0 OR n = '@types/x__y' AND false AS same, n = '@brand/12' AS typed FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN replace(lower(p_brand), '#', '-') WHEN 1 THEN replace(lower(p_brand), '#', '_') ELSE '@' || replace(lower(p_brand), '#', '/') END AS n FROM part)")
def _(t):
    m, b = F.col("p_partkey") % 3, F.lower("p_brand")
    name = F.when(m == 0, F.translate(b, "#", "-")).when(m == 1, F.translate(b, "#", "_")).otherwise(F.concat(F.lit("@"), F.translate(b, "#", "/")))
    system = F.when(F.col("p_size") % 2 == 0, "cargo").otherwise("npm")
    return t.part.select("p_partkey", X.name_matches(name, F.lit("brand-12"), system).alias("same"), X.name_matches(name, F.lit("@types/brand__12"), F.lit("npm")).alias("typed"))


@query("f7_all_words", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'ing')")
def _(t):
    return t.documents.where(X.has_all_words(F.col("text"), ["the", "AND", "ing"])).select("doc_id")


@query("f8_first_matches", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '7') ORDER BY c_custkey LIMIT 20")
def _(t):
    return t.customer.where(F.contains(F.lower("c_name"), F.lit("7"))).orderBy("c_custkey").limit(20).select("c_custkey", "c_name")


@query("f9_word_start", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}])then')")
def _(t):
    return t.documents.where(X.word_start(F.col("text"), "then")).select("doc_id")


@query("f10_mentions", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(is|of)($|[^a-z0-9])') OR contains(lower(text), 'license')")
def _(t):
    return t.documents.where(X.mentions(F.col("text"), "is|of|license")).select("doc_id")


@query("f11_scope_filter", _E + "SELECT id, name FROM entities WHERE kind = 'code' AND contains(lower(name || ' ' || id), 'cust') AND contains(lower(name || ' ' || id), '9')")
def _(t):
    hay = F.concat_ws(" ", "name", "id")
    return A.entities(t).where((F.col("kind") == "code") & X.has_all_words(hay, ["cust", "9"])).select("id", "name")


@query("f12_excerpt_window", "SELECT l_orderkey, min(l_linenumber)::INTEGER AS first_line, count(*)::BIGINT AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY l_orderkey ORDER BY l_orderkey LIMIT 8")
def _(t):
    return t.lineitem.where(F.col("l_linenumber").between(2, 4)).groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line"), F.count("*").alias("n")).orderBy("l_orderkey").limit(8)


@query(
    "f13_safe_path",
    "SELECT page_id, NOT (p = '' OR starts_with(p, '/') OR contains(p, chr(92)) OR len(list_filter(string_split(p, '/'), lambda s: s IN ('', '.', '..'))) > 0) AS safe"
    " FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 5 = 0 THEN '/../x' ELSE '' END AS p FROM pages)",
)
def _(t):
    p = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.when(F.col("page_id") % 5 == 0, "/../x").otherwise(""))
    return t.pages.select("page_id", X.safe_path(p).alias("safe"))


@query("f14_excluded_path", "SELECT page_id, page_id % 3 = 0 AS excluded FROM pages")
def _(t):
    m = F.col("page_id") % 6
    path = F.when(m == 0, "testdata/a.go").when(m == 3, "src/testdata/b/c.go").when(m == 1, "src/mytestdata/d.go").when(m == 2, "src/testdata.go").otherwise(F.regexp_replace("url", "testdata/", ""))
    return t.pages.select("page_id", X.test_data_path(path).alias("excluded"))


@query(
    "f15_service_boundary",
    "SELECT p_partkey, ['@lib/sdk', 'react-sdk', 'lodash.get', '@cloud/anything', 'payments', 'foo-sdk', '@org/sdk-node', 'x-api-client', 'sdkish', '@org/plain', '@cloud/fonts'][p_partkey % 11 + 1] AS package, p_partkey % 11 IN (3, 4, 5, 6, 7) AS service FROM part",
)
def _(t):
    names = ("@lib/sdk", "react-sdk", "lodash.get", "@cloud/anything", "payments", "foo-sdk", "@org/sdk-node", "x-api-client", "sdkish", "@org/plain", "@cloud/fonts")
    package = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 11 + 1).cast("int"))
    return t.part.select("p_partkey", package.alias("package"), X.service_boundary(package, ["@lib"], ["fonts"], ["@cloud"], ["payments"]).alias("service"))


@query("f16_complexity_flag", "SELECT o_orderkey, n > 6 AS flagged FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def _(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") > 6).alias("flagged"))


@query("f17_rect_overlap", "SELECT p_partkey FROM part WHERE p_retailprice < 1200 AND p_retailprice + 40 > 1000 AND p_size * 10 < 300 AND p_size * 10 + 20 > 100")
def _(t):
    from ..operators.spatial import rect_overlaps

    box = {"x": F.col("p_retailprice"), "y": F.col("p_size") * 10, "w": F.lit(40), "h": F.lit(20)}
    return t.part.where(rect_overlaps(box, (1000, 100, 200, 200))).select("p_partkey")


@query(
    "f18_visible_objects",
    _E + "SELECT e.id, CASE WHEN p.rank BETWEEN 1 AND 2 THEN e.parent_id END AS visible_parent FROM entities e LEFT JOIN entities p ON p.id = e.parent_id WHERE e.rank BETWEEN 1 AND 2",
)
def _(t):
    e = A.entities(t)
    seen = e.where("rank BETWEEN 1 AND 2")
    parents = seen.select(F.col("id").alias("p"))
    return seen.join(parents, F.col("parent_id") == F.col("p"), "left").select("id", F.col("p").alias("visible_parent"))


@query("f19_accepted_fresh", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0")
def _(t):
    good = t.labels.where("quality = 1 AND toxic = 0").select("doc_id")
    return t.documents.join(good, "doc_id", "left_semi").select("doc_id")


@query("f20_third_party_order", "SELECT s_suppkey, row_number() OVER (ORDER BY (s_nationkey % 5 = 0)::INT, s_name)::BIGINT AS position FROM supplier ORDER BY position LIMIT 50")
def _(t):
    # The context flag sorts last; ranks are given to the 50 rows that the limit leaves.
    top = t.supplier.orderBy(F.col("s_nationkey") % 5 == 0, "s_name").limit(50)
    w = G.over([], [F.col("s_nationkey") % 5 == 0, F.col("s_name")])
    return top.select("s_suppkey", F.row_number().over(w).cast("long").alias("position"))
