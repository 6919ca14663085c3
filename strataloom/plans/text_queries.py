"""Text retrieval (T) and scalar functions (X)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import secrets as Z
from ..functions import text as X
from ..functions import versions as N
from ..operators import answers as Q
from ..operators import code_facts as C
from ..operators import retrieval as R
from ..operators import sections as S
from ..sources.code_tokens import code_tokens
from .registry import Tables, query

_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
_CUT = "regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"


def _stem_sql(table: str, keys: str, passes: int = 4) -> str:
    """CTEs that stem column term of a table, one per step; the last is named st."""
    out, last = [], table
    for k in range(passes):
        a = f"CASE WHEN length(term) > 4 AND term LIKE '%ies' THEN left(term, -3) || 'y' WHEN length(term) > 4 AND term LIKE '%sses' THEN left(term, -2) WHEN length(term) > 3 AND term LIKE '%s' AND NOT regexp_matches(term, '(ss|us|is)$') THEN left(term, -1) ELSE term END"
        out.append(f"a{k} AS (SELECT {keys}, {a} AS term FROM {last})")
        out.append(f"b{k} AS (SELECT {keys}, term <> cut AS did, cut AS term FROM (SELECT {keys}, term, CASE WHEN length(term) > 5 AND term LIKE '%ing' THEN left(term, -3) WHEN length(term) > 4 AND term LIKE '%ed' THEN left(term, -2) WHEN length(term) > 5 AND term LIKE '%er' THEN left(term, -2) ELSE term END AS cut FROM a{k}))")
        out.append(f"c{k} AS (SELECT {keys}, CASE WHEN did AND length(term) > 3 AND right(term, 1) = substr(term, length(term) - 1, 1) AND regexp_matches(term, '[b-df-hj-km-np-rtv-z]$') AND NOT regexp_matches(term, '(ll|ss|zz)$') THEN left(term, -1) ELSE term END AS term FROM b{k})")
        last = f"d{k}"
        out.append(f"{last} AS (SELECT {keys}, CASE WHEN length(term) > 4 AND term LIKE '%e' THEN left(term, -1) ELSE term END AS term FROM c{k})")
    out.append(f"st AS (SELECT * FROM {last} WHERE length(term) >= 2 AND term NOT IN ({_STOP}))")
    return ", ".join(out)


def _tokens_sql(source: str, keys: str, text: str) -> str:
    raw = f"raw AS (SELECT {keys}, unnest(string_split(lower({_CUT.format('chunk')}), ' ')) AS term FROM (SELECT {keys}, unnest(regexp_split_to_array({text}, '[^A-Za-z0-9]+')) AS chunk FROM {source}) WHERE chunk <> '')"
    return f"{raw}, w AS (SELECT * FROM raw WHERE length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ({_STOP})), " + _stem_sql("w", keys)


_NAMES = "(SELECT p_partkey AS doc, p_type || '_' || p_name || ' getURLParts WASMBridge' AS text FROM part)"


@query("t1_tokens", f"WITH {_tokens_sql(_NAMES, 'doc', 'text')} SELECT term, count(*)::BIGINT AS n FROM st GROUP BY 1")
def _(t):
    named = t.part.select(F.col("p_partkey").alias("doc"), F.concat("p_type", F.lit("_"), "p_name", F.lit(" getURLParts WASMBridge")).alias("text"))
    return R.tokens(named, ["doc"], F.col("text")).groupBy("term").agg(F.count("*").alias("n"))


_WORDS = "(SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents) WHERE length(term) > 2)"


@query("t2_stems", f"WITH w0 AS {_WORDS}, w AS (SELECT term AS word, term FROM w0), {_stem_sql('w', 'word').rpartition(', st AS')[0]} SELECT word, term FROM d3")
def _(t):
    words = t.documents.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") > 2).distinct()
    return words.withColumn("term", R.stem(F.col("word")))


#: Plain tokens, and pairs of words that some token is the joined form of, taken from left to right without overlaps.
_ASKED = f"""WITH RECURSIVE z0 AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda x: x <> '') AS cs FROM benchmark), z AS (SELECT item_id, unnest(range(1, len(cs) + 1)) AS pos, unnest(cs) AS chunk FROM z0),
 n AS (SELECT *, lower(chunk) AS low, lead(lower(chunk)) OVER (PARTITION BY item_id ORDER BY pos) AS ahead FROM z), raw AS (SELECT item_id, 0 AS kind, 0 AS pos, unnest(string_split(lower({_CUT.format('chunk')}), ' ')) AS term FROM z),
 w AS (SELECT * FROM raw WHERE length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ({_STOP}) UNION ALL SELECT item_id, 1, pos, low || ahead FROM n WHERE length(low || ahead) >= 6 AND low NOT IN ({_STOP}) AND ahead NOT IN ({_STOP})), {_stem_sql('w', 'item_id, kind, pos')},
 known AS (SELECT item_id, pos, term FROM st WHERE kind = 1 AND term IN (SELECT term FROM st WHERE kind = 0)), k AS (SELECT n.item_id, n.pos, known.term FROM n LEFT JOIN known USING (item_id, pos)),
 r(item_id, pos, term) AS (SELECT item_id, pos, term FROM k WHERE pos = 1 UNION ALL SELECT k.item_id, k.pos, CASE WHEN r.term IS NULL THEN k.term END FROM r JOIN k ON k.item_id = r.item_id AND k.pos = r.pos + 1)
 SELECT DISTINCT item_id, term FROM st WHERE kind = 0 UNION SELECT item_id, term FROM r WHERE term IS NOT NULL"""


@query("t3_question_tokens", _ASKED)
def _(t):
    asked = t.benchmark.select(F.col("item_id").alias("q"), "text")
    known = R.tokens(asked, ["q"], F.col("text")).select("term").distinct()
    return R.question_tokens(asked, known).select(F.col("q").alias("item_id"), F.col("token").alias("term"))


def _fields(t: Tables):
    d = t.documents
    one = lambda f, c: d.select(F.col("doc_id").alias("doc"), F.lit(f).alias("field"), c.alias("text"))
    return one("name", F.concat_ws(" ", "source", "lang")).unionAll(one("excerpt", F.col("text")))


_FIELDS = "(SELECT doc_id AS doc, 'name' AS field, source || ' ' || lang AS text FROM documents UNION ALL SELECT doc_id, 'excerpt', text FROM documents)"
_INDEX = (
    _tokens_sql(f"{_FIELDS} x", "doc, field", "text")
    + """, tf AS (SELECT doc, field, term, count(*) AS tf FROM st GROUP BY ALL), len AS (SELECT doc, field, sum(tf) AS len FROM tf GROUP BY ALL), size AS (SELECT count(*) AS n FROM documents),
 mean AS (SELECT field, greatest(sum(len) / (SELECT n FROM size), 1) AS mean FROM len GROUP BY 1), k AS (SELECT * FROM (VALUES ('name', 3.0::DOUBLE, 0.3::DOUBLE), ('excerpt', 0.6::DOUBLE, 0.75::DOUBLE)) v(field, weight, b)),
 postings AS (SELECT term, doc, sum(weight * tf / (1 - b + b * len / mean)) AS wtf FROM tf JOIN len USING (doc, field) JOIN mean USING (field) JOIN k USING (field) GROUP BY ALL), vocab AS (SELECT term, count(*) AS df FROM postings GROUP BY 1)"""
)
#: Compounds only arise from chunks that hold a capital after a small letter; the test texts have none but in capitals runs.
_Q = "(VALUES ('tion'), ('src3'), ('license'), ('apach')) q(token)"


def _asked(t: Tables):
    return t.spark.createDataFrame([("q1", w) for w in ("tion", "src3", "license", "apach")], "q string, token string")


def _plain(t: Tables):
    """Fields without camel case, so that index compounds play no part in the comparison."""
    return _fields(t).withColumn("text", F.lower("text"))


_INDEX_LOW = _INDEX.replace("'excerpt', text", "'excerpt', lower(text)")


@query("t4_postings", f"WITH {_INDEX_LOW} SELECT term, count(*)::BIGINT AS docs, round(sum(wtf), 4) AS weight FROM postings GROUP BY 1")
def _(t):
    p = R.build_index(_plain(t))[0]
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.round(F.sum("wtf"), 4).alias("weight"))


@query("t5_idf", f"WITH {_INDEX_LOW} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM vocab, size")
def _(t):
    _, v, size = R.build_index(_plain(t))
    return v.crossJoin(size).select("term", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


_SCORE = f""", e AS (SELECT token, token AS term, 1.0::DOUBLE AS weight FROM {_Q} WHERE token IN (SELECT term FROM vocab)
 UNION ALL SELECT token, term, max(weight) FROM (SELECT token, term, 0.6::DOUBLE AS weight FROM {_Q}, vocab WHERE token NOT IN (SELECT term FROM vocab) AND levenshtein(token, term) <= CASE WHEN length(token) >= 7 THEN 2 ELSE 1 END
  UNION ALL SELECT token, term, 0.7::DOUBLE FROM {_Q}, vocab WHERE token NOT IN (SELECT term FROM vocab) AND length(token) >= 4 AND starts_with(term, token) AND length(term) > length(token) + CASE WHEN length(token) >= 7 THEN 2 ELSE 1 END) GROUP BY 1, 2),
 x AS (SELECT token, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY term) AS r FROM e) WHERE r <= 24),
 best AS (SELECT doc, token, max(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (wtf * 2.2) / (wtf + 1.2)) AS v FROM x JOIN vocab USING (term) JOIN postings USING (term), size GROUP BY 1, 2),
 score AS (SELECT doc, sum(v) * (0.5 + 0.5 * count(*) / (SELECT count(DISTINCT token) FROM x)) AS score FROM best GROUP BY 1)"""


@query("t6_bm25f", f"WITH {_INDEX_LOW} {_SCORE} SELECT doc, round(score, 3) AS score FROM score")
def _(t):
    p, v, size = R.build_index(_plain(t))
    return R.bm25f(R.expand(_asked(t), v), p, v, size).select("doc", F.round("score", 3).alias("score"))


@query("t7_expansions", f"WITH {_INDEX_LOW} {_SCORE} SELECT token, term, weight FROM x")
def _(t):
    v = R.build_index(_plain(t))[1]
    return R.expand(_asked(t), v).select("token", "term", "weight")


@query("t8_prefix_terms", f"WITH {_INDEX_LOW} SELECT term FROM vocab WHERE starts_with(term, 'then') AND length(term) > 5")
def _(t):
    return R.build_index(_plain(t))[1].where(F.startswith("term", F.lit("then")) & (F.length("term") > 5)).select("term")


@query("t9_synonyms", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{x}')" for k, v in R.SYNONYMS.items() for x in v) + ") v(word, synonym)")
def _(t):
    rows = [(k, list(v)) for k, v in R.SYNONYMS.items()]
    return t.spark.createDataFrame(rows, "word string, s array<string>").select("word", F.explode("s").alias("synonym"))


@query("t10_expansion_merge", f"WITH {_INDEX_LOW} {_SCORE} SELECT token, count(*)::BIGINT AS n, max(weight) AS best FROM x GROUP BY 1")
def _(t):
    v = R.build_index(_plain(t))[1]
    return R.expand(_asked(t), v).groupBy("token").agg(F.count("*").alias("n"), F.max("weight").alias("best"))


@query("t11_system_names", "SELECT DISTINCT lower(n_name) AS token FROM nation WHERE levenshtein(lower(n_name), 'nation_1') <= 1 OR lower(n_name) = 'atlas' OR lower(n_name) = 'atl'")
def _(t):
    words = t.nation.select(F.lower("n_name").alias("token"))
    none = t.spark.createDataFrame([], "term string")
    return S.names_system(words, ["nation_1", "atlas"], none).distinct()


@query("t12_selected_boost", "SELECT doc_id AS doc, round(n_chars * CASE WHEN source = 'src1' THEN 1.2 ELSE 1 END, 4)::DOUBLE AS score FROM documents")
def _(t):
    scores = t.documents.select(F.lit("q").alias("q"), F.col("doc_id").alias("doc"), F.col("n_chars").cast("double").alias("score"))
    chosen = t.documents.where("source = 'src1'").select(F.lit("q").alias("q"), F.col("doc_id").alias("doc"))
    return S.boost_selected(scores, chosen).select("doc", F.round("score", 4).alias("score"))


_NEAR = "near AS (SELECT DISTINCT 'c' || o_custkey AS doc, 's' || l_suppkey AS other FROM lineitem JOIN orders ON l_orderkey = o_orderkey), near64 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY other) AS n FROM near) WHERE n <= 64)"


@query("t13_graph_lift", f"WITH {_NEAR}, top AS (SELECT 'c' || c_custkey AS doc, c_acctbal AS score FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, doc LIMIT 30), d AS (SELECT doc, count(*) AS degree FROM near64 GROUP BY 1) SELECT other AS doc, round(max(score * 0.9 / sqrt(degree)), 4) AS lift FROM top JOIN d USING (doc) JOIN near64 USING (doc) GROUP BY 1")
def _(t):
    lines = A.order_lines(t).select(F.col("from_id").alias("doc"), F.col("to_id").alias("other"))
    scores = t.customer.select(F.lit("q").alias("q"), A.tag("c", "c_custkey").alias("doc"), F.col("c_acctbal").alias("score"))
    return R.graph_lift(scores, lines).select("doc", F.round("lift", 4).alias("lift"))


@query("t14_file_groups", "SELECT doc_id - doc_id % 7 AS file, coalesce(max(n_chars::DOUBLE) FILTER (WHERE doc_id % 7 = 0), 0) AS score, count(*) FILTER (WHERE doc_id % 7 <> 0)::BIGINT AS symbols FROM documents WHERE n_chars > 0 GROUP BY 1")
def _(t):
    d = t.documents
    scores = d.select(F.lit("q").alias("q"), F.col("doc_id").alias("doc"), F.col("n_chars").cast("double").alias("score"))
    files = d.select(F.col("doc_id").alias("doc"), (F.col("doc_id") - F.col("doc_id") % 7).alias("file"))
    return S.file_groups(scores, files).drop("q")


_BODIES = "(SELECT doc_id, text FROM documents)"


@query(
    "t15_symbol_order",
    f"WITH {_tokens_sql(_BODIES + ' x', 'doc_id', 'text')}, hits AS (SELECT doc_id, count(*) AS n FROM st WHERE term IN ('licens', 'apach') GROUP BY 1)"
    " SELECT lang, d.doc_id, row_number() OVER (PARTITION BY lang ORDER BY source = 'src3' DESC, coalesce(n, 0) DESC, n_chars DESC, d.doc_id)::INTEGER AS place FROM documents d LEFT JOIN hits USING (doc_id)",
)
def _(t):
    rows = t.documents.select(F.lit("q").alias("q"), F.col("lang").alias("file"), F.col("doc_id").alias("doc"), F.lit("lib/src3.ts").alias("path"), F.col("source").alias("name"), F.col("text").alias("body"), F.col("n_chars").alias("score"))
    terms = t.spark.createDataFrame([("q", "licens"), ("q", "apach")], "q string, term string")
    return S.symbol_order(rows, terms).select(F.col("file").alias("lang"), F.col("doc").alias("doc_id"), "place")


@query("t16_excerpt_window")
def _(t):
    d = t.documents
    chosen = d.select((F.col("doc_id") % 50).alias("q"), F.col("doc_id").alias("doc")).withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy("doc")))
    terms = d.select((F.col("doc_id") % 50).alias("q")).distinct().select("q", F.explode(F.array(F.lit("licens"), F.lit("apach"), F.lit("the"))).alias("term"))
    return S.excerpts(chosen, d.select(F.col("doc_id").alias("doc"), "text"), terms)


@query("t17_retrieval")
def _(t):
    documents, relations = _library(t)
    questions = t.benchmark.select(F.col("item_id").cast("string").alias("q"), "text")
    selected = questions.select("q", F.concat(F.lit("d"), "q").alias("doc"))
    return Q.answer(questions, documents, relations, selected, names=["atla"])


def _library(t: Tables):
    """Documents as declarations of files (140 ids of a source), sources as containers; each document uses the next one."""
    d = t.documents.select("doc_id", "text", "lang", "source", F.concat("source", F.lit("/f"), (F.floor(F.col("doc_id") / 140)).cast("string")).alias("file"))
    none = lambda kind: F.lit(None).cast(kind)

    def entity(df, ident, name, kind, parent, path=none("string"), summary=none("string"), lines=none("array<string>"), last=none("int"), symbols=F.array().cast("array<string>")):
        first = F.when(last.isNotNull(), F.lit(1))
        return df.select(
            ident.alias("id"), name.alias("name"), F.lit(kind).alias("kind"), parent.alias("parent_id"), path.alias("path"), first.alias("start_line"), last.alias("end_line"),
            symbols.alias("symbols"), summary.alias("summary"), none("array<string>").alias("key_points"), first.alias("excerpt_start"), lines.alias("lines"),
        )

    system = entity(t.spark.range(1), F.lit("atlas"), F.lit("Atlas"), "softwareSystem", none("string"))
    boxes = entity(d.select("source").distinct(), F.col("source"), F.col("source"), "container", F.lit("atlas"))
    files = entity(d.select("source", "file").distinct(), F.col("file"), F.col("file"), "component", F.col("source"), F.concat("file", F.lit(".txt")), F.concat(F.lit("Texts of "), "source"), last=F.lit(140))
    texts = entity(d, A.tag("d", "doc_id"), A.tag("text_", "doc_id"), "code", F.col("file"), F.concat("file", F.lit(".txt")), F.col("lang"), F.split("text", "\n", -1), F.size(F.split("text", "\n", -1)))
    relations = d.select(A.tag("d", "doc_id").alias("from_id"), F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string")).alias("to_id"), F.lit("calls").alias("kind"))
    return system.unionAll(boxes).unionAll(files).unionAll(texts), relations


@query("t18_agent_search", "SELECT p_partkey AS id, (CASE WHEN lower(p_name) = 'part 7' THEN 100 ELSE 0 END + 10 * contains(lower(p_name), 'part')::INT + 5 * contains(lower(p_brand), 'part')::INT + 10 * contains(lower(p_name), '7')::INT + 5 * contains(lower(p_brand), '7')::INT)::INTEGER AS score FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'part') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '7')")
def _(t):
    e = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_type").alias("text"))
    return R.agent_search(e, ["part", "7"])


@query("t19_did_you_mean", "SELECT name, levenshtein(lower(name), 'natoin_1')::INTEGER AS distance FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region) WHERE levenshtein(lower(name), 'natoin_1') <= 2 OR contains(lower(name), 'natoin_1') OR contains('natoin_1', lower(name)) ORDER BY distance, name LIMIT 5")
def _(t):
    names = t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name"))
    return R.did_you_mean(names, "natoin_1")


#: Tokens of the function of a part without loops, and of a loop.
_PART_TOKENS, _LOOP_TOKENS = 69, 15


@query(
    "t20_clone_fingerprints",
    f"SELECT tokens::BIGINT AS tokens, count(*)::BIGINT AS n FROM (SELECT unnest([{_PART_TOKENS} + {_LOOP_TOKENS} * (p_size % 5), 20]) AS tokens FROM part) GROUP BY 1 HAVING count(*) > 1",
)
def _(t):
    tokens = code_tokens(A.script_files(t))
    copies = C.copy_fingerprints(tokens, C.declarations(tokens))
    return copies.groupBy("fingerprint").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")).where("n > 1").drop("fingerprint")


@query("t21_keyword_complexity", "SELECT v.name || p_partkey AS name, v.c + CASE WHEN v.name = 'part_' THEN p_size % 5 ELSE 0 END AS complexity, v.c + CASE WHEN v.name = 'part_' THEN p_size % 5 ELSE 0 END > 6 AS flagged FROM part, (VALUES ('part_', 4), ('over_', 2)) v(name, c)")
def _(t):
    tokens = code_tokens(A.script_files(t))
    return C.complexity(tokens, C.declarations(tokens)).select("name", "complexity", "flagged")


@query("t22_signature_change", "SELECT c_custkey::VARCHAR AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'surface' WHEN 'MACHINERY' THEN 'same' WHEN 'AUTOMOBILE' THEN 'surface' ELSE 'internal' END AS change FROM customer")
def _(t):
    is_ = lambda s: F.col("c_mktsegment") == s

    def version(second: bool):
        kind = F.when(is_("BUILDING") & F.lit(second), "string").otherwise("number")
        rest = F.when(is_("AUTOMOBILE") & F.lit(second), " | { more: boolean }").otherwise("")
        body = F.when(~is_("MACHINERY") & F.lit(second), "2").otherwise("1")
        text = F.concat(F.lit("/** Of "), "c_name", F.lit(". */\nexport async function of<T extends { k: "), kind, F.lit(" }>(\n  a: T,\n  b = { c: '{' },\n): Promise<{ ok: boolean }"), rest, F.lit("> {\n  return { ok: a.k > "), body, F.lit(" }\n}\n"))
        return A.dealt(t.customer).select(F.col("c_custkey").alias("id"), F.lit("src/of.ts").alias("path"), text.alias("text"))

    return C.signature_changes(version(False), version(True))


@query("t23_citations", "SELECT conv_id, count(*) FILTER (WHERE regexp_matches(text, '\\[[0-9]+\\]'))::BIGINT AS cited, count(*) FILTER (WHERE contains(lower(text), 'not'))::BIGINT AS denied FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.count_if(F.col("text").rlike(r"\[[0-9]+\]")).alias("cited"), F.count_if(F.contains(F.lower("text"), F.lit("not"))).alias("denied"))


@query("t24_provenance_states", "SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'supported' WHEN value / 100 >= 0.3 THEN 'uncertain' ELSE 'unsupported' END AS state FROM events")
def _(t):
    c = F.col("value") / 100
    return t.events.select("event_id", F.when(c >= 0.7, "supported").when(c >= 0.3, "uncertain").otherwise("unsupported").alias("state"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(" + "regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g')" + "), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x')"


@query("x1_slug", f"SELECT p_partkey, {_SLUG.format(chr(39) + 'getURL' + chr(39) + ' || p_name')} AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", X.slug(F.concat(F.lit("getURL"), "p_name")).alias("slug"))


@query("x2_bound_id", "SELECT p_partkey, CASE WHEN length(i) <= 24 THEN i ELSE left(i, 7) || '-' || left(sha256(i), 16) END AS id FROM (SELECT p_partkey, 'part:' || p_name || ':' || p_type AS i FROM part)")
def _(t):
    return t.part.select("p_partkey", X.bound_id(F.concat(F.lit("part:"), "p_name", F.lit(":"), "p_type"), 24).alias("id"))


@query("x3_redact")
def _(t):
    return t.documents.select("doc_id", Z.redact(F.col("text")).alias("text"))


@query("x3_redact_events", """SELECT event_id, '{"user_id": "[redacted]", "kind": "' || event_type || '", "account": ' || CASE WHEN event_type = 'click' THEN '"[redacted]"' ELSE '"plain"' END || ', "nested": "{\\"email\\": \\"[redacted]\\"}", "value": 1} org_id=[redacted] user talks' AS text FROM events""")
def _(t):
    # Each shape of a value: a list of objects, a string with quotes and brackets in it, an escaped string, plain words.
    ident, key = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"a": "}]"}, {"b": ['), ident, F.lit("]}]"))).otherwise(F.concat(F.lit('"a \\"quoted\\" '), ident, F.lit('"')))
    account = F.when(F.col("event_type") == "click", F.concat(F.lit('{"id": '), ident, F.lit("}"))).otherwise(F.lit('"plain"'))
    text = F.concat(F.lit('{"user_id": '), value, F.lit(', "kind": "'), "event_type", F.lit('", "account": '), account, F.lit(', "nested": "{\\"email\\": \\"a\\\\\\"b'), key, F.lit('\\"}", "value": 1} org_id='), ident, F.lit(" user talks"))
    return t.events.select("event_id", Z.redact(text).alias("text"))


@query(
    "x4_redact_spec",
    "SELECT page_id, v.kind, v.spec FROM (SELECT page_id, url AS raw, regexp_replace(url, '[?#].*$', '') AS url FROM pages), LATERAL (VALUES ('raw', regexp_replace(raw, '\\?[^#]*', '?[redacted]')), ('query', 'git+' || replace(url, '://', '://[redacted]@') || '?[redacted]#f'), ('slash', replace(url, '://', '://[redacted]@')), ('git', replace(url, '://', '://git@') || '#v' || page_id),"
    " ('semver', url || '#semver:^1.' || page_id), ('fragment', url || '#[redacted]'), ('path', 'file:<absolute path>'), ('home', '<absolute path>'), ('token', 'npm:[redacted-token]'), ('plain', '^1.' || page_id)) v(kind, spec)",
)
def _(t):
    url, key = F.regexp_replace("url", "[?#].*$", ""), F.col("page_id").cast("string")
    user = lambda who: F.replace(url, F.lit("://"), F.concat(F.lit("://"), who, F.lit("@")))
    specs = {
        "raw": F.col("url"),
        "query": F.concat(F.lit("git+"), user(F.concat(F.lit("u:p"), key)), F.lit("?x=1#f")),
        "slash": user(F.concat(F.lit("user:se/cr@et/"), key)),
        "git": F.concat(user(F.lit("git")), F.lit("#v"), key),
        "semver": F.concat(url, F.lit("#semver:^1."), key),
        "fragment": F.concat(url, F.lit("#access_TOKEN-"), key),
        "path": F.concat(F.lit("file:/home/me/"), key),
        "home": F.concat(F.lit("~/src/"), key),
        "token": F.concat(F.lit("npm:ghp_"), F.lpad(key, 24, "a0")),
        "plain": F.concat(F.lit("^1."), key),
    }
    rows = t.pages.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("spec")) for k, c in specs.items()))).alias("v"))
    return rows.select("page_id", "v.kind", Z.redact_spec(F.col("v.spec")).alias("spec"))


@query("x5_controls", "SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'))::INTEGER AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length(X.plain_controls(F.col("text"), "")).alias("n"))


_SPEC = "CASE p_partkey % 5 WHEN 0 THEN './' || p_name WHEN 1 THEN '@scope/' || p_name || '/sub' WHEN 2 THEN p_name || '/deep/x' WHEN 3 THEN 'node:fs' ELSE p_name END"


def _spec():
    m, n = F.col("p_partkey") % 5, F.col("p_name")
    return F.when(m == 0, F.concat(F.lit("./"), n)).when(m == 1, F.concat(F.lit("@scope/"), n, F.lit("/sub"))).when(m == 2, F.concat(n, F.lit("/deep/x"))).when(m == 3, "node:fs").otherwise(n)


@query("x6_package_name", f"SELECT p_partkey, CASE WHEN s LIKE './%' OR s LIKE 'node:%' THEN NULL WHEN s LIKE '@%' THEN split_part(s, '/', 1) || '/' || split_part(s, '/', 2) ELSE split_part(s, '/', 1) END AS package FROM (SELECT p_partkey, {_SPEC} AS s FROM part)")
def _(t):
    return t.part.select("p_partkey", X.package_name(_spec()).alias("package"))


_ENTRY = "CASE p_partkey % 6 WHEN 0 THEN 'npm:x@' || p_size || '.' || v || '.3-rc.1(react@1.2.3)' WHEN 1 THEN 'link:../pkg@1.2.3' WHEN 2 THEN p_size || '.' || v || '.0_react@17.0.2' WHEN 3 THEN 'https://h/x.tgz' WHEN 4 THEN chr(39) || 'v1.2.' || v || chr(39) ELSE '/lodash@4.' || v || '.1' END"


@query("x7_lock_version", "SELECT p_partkey, ['version', 'local', 'version', 'source', 'version', 'version'][p_partkey % 6 + 1] AS kind, CASE p_partkey % 6 WHEN 0 THEN p_size || '.' || v || '.3-rc.1' WHEN 2 THEN p_size || '.' || v || '.0' WHEN 4 THEN '1.2.' || v WHEN 5 THEN '4.' || v || '.1' END AS version FROM (SELECT *, p_partkey % 7 AS v FROM part)")
def _(t):
    raw = F.expr(_ENTRY.replace("chr(39)", "char(39)").replace(" v ", " (p_partkey % 7) "))
    return t.part.select("p_partkey", N.lock_version(raw).alias("x")).select("p_partkey", "x.kind", "x.version")


@query(
    "x8_cargo_requirement",
    "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN a >= 2 WHEN 1 THEN a = 2 AND b >= 3 WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN a > 0 OR b > 0 WHEN 5 THEN a = 0 AND b = 0 WHEN 6 THEN true WHEN 7 THEN a = 2 END AS matches FROM (SELECT p_partkey, p_size % 4 AS a, p_partkey % 6 AS b FROM part)",
)
def _(t):
    needs = ("^1.2", "~1.2.3", ">=1.0, <2.0", "1.*", ">1", "<=1", ">=1,", "=1.2", "one")
    need = F.element_at(F.array(*map(F.lit, needs)), (F.col("p_partkey") % 9 + 1).cast("int"))
    have = F.concat(F.lit("1."), (F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_partkey") % 6).cast("string"))
    return t.part.select("p_partkey", N.requirement_matches(need, have).alias("matches"))


@query("x9_coverage_path", "SELECT page_id, regexp_replace(regexp_replace(replace('.\\src//' || regexp_replace(url, '^[a-z]+://', ''), chr(92), '/'), '/{2,}', '/', 'g'), '^(\\./)+', '') AS path FROM pages")
def _(t):
    return t.pages.select("page_id", X.coverage_path(F.concat(F.lit(".\\src//"), F.regexp_replace("url", "^[a-z]+://", ""))).alias("path"))


@query("x10_glob", "SELECT page_id, regexp_matches(path, '^(?:.*/)?p1[^/]*(?:/.*)?$') AS hit FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)")
def _(t):
    from ..operators.joins import glob_regex

    return t.pages.select("page_id", F.regexp_replace("url", "^[a-z]+://", "").rlike(glob_regex("p1*")).alias("hit"))


@query("x11_file_language", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'tsx' WHEN 2 THEN 'rust' END AS language FROM part")
def _(t):
    m = F.col("p_partkey") % 4
    path = F.concat("p_name", F.when(m == 0, ".ts").when(m == 1, ".TSX").when(m == 2, ".rs").otherwise(".md"))
    return t.part.select("p_partkey", X.file_language(path).alias("language"))


@query("x12_display_truncation", "SELECT doc_id, CASE WHEN length(s) <= 40 THEN s ELSE rtrim(CASE WHEN length(w) >= 26 THEN w ELSE c END) || '…' END AS label FROM (SELECT doc_id, s, c, regexp_replace(c, '\\s+\\S*$', '') AS w FROM (SELECT doc_id, replace(text, chr(10), ' ') AS s, left(replace(text, chr(10), ' '), 39) AS c FROM documents))")
def _(t):
    s = F.replace("text", F.lit("\n"), F.lit(" "))
    return t.documents.select("doc_id", X.shorten(s, 40).alias("label"))


@query("x13_text_width", f"SELECT doc_id, list_sum(list_transform(string_split(text, ''), lambda c: {list(X.SANS_ADVANCES)}[CASE WHEN c = '…' THEN 96 WHEN unicode(c) BETWEEN 32 AND 126 THEN unicode(c) - 31 ELSE 32 END]))::BIGINT AS width FROM documents")
def _(t):
    return t.documents.select("doc_id", X.text_width(F.col("text")).alias("width"))


@query("x14_excerpt_clamp")
def _(t):
    start = (F.col("doc_id") % 5 + 1).cast("int")
    got = X.clamp_excerpt(F.col("text"), start, start + 60, start + (F.col("doc_id") % 9).cast("int"))
    return t.documents.select("doc_id", got.alias("x")).select("doc_id", "x.start_line", F.array_join("x.lines", "\n").alias("excerpt"))


@query("x15_content_hash", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS hash FROM nation")
def _(t):
    return t.nation.select("n_nationkey", X.content_hash("n_regionkey", "n_name").alias("hash"))


@query("x16_qualified_ids", "SELECT 'snap-' || n_regionkey || '::' || n_name AS qualified FROM nation")
def _(t):
    return t.nation.select(F.concat(F.lit("snap-"), F.col("n_regionkey").cast("string"), F.lit("::"), "n_name").alias("qualified"))


@query("x17_array_ops", "SELECT n_regionkey, array_to_string(list_sort(list_distinct(list(left(n_name, 8))))[1:3], ',') AS head, bool_and(n_nationkey >= 0) AS every FROM nation GROUP BY 1")
def _(t):
    names = F.collect_list(F.substring("n_name", 1, 8))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.slice(F.array_sort(F.array_distinct(names)), 1, 3), ",").alias("head"), F.forall(F.collect_list("n_nationkey"), lambda x: x >= 0).alias("every"))


@query("x18_map_ops", "SELECT r_name AS name, r_regionkey AS value FROM region")
def _(t):
    m = t.region.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "r_regionkey"))).alias("m"))
    return m.select(F.explode(F.map_entries("m")).alias("e")).select(F.col("e.key").alias("name"), F.col("e.value").alias("value"))


@query("x19_json_leaves", "SELECT event_id, unnest([json_extract_string(props, '$.k') || '', event_type, 'x']) AS leaf FROM events")
def _(t):
    from ..functions.parsers import json_strings

    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    nested = F.to_json(F.struct(F.array(F.struct(k.alias("k")), F.struct(F.col("event_type").alias("k"))).alias("a"), F.lit(7).alias("n"), F.struct(F.lit("x").alias("y")).alias("b")))
    return t.events.select("event_id", F.explode(json_strings(nested)).alias("leaf"))


@query("x20_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts::DATE - INTERVAL 14 DAY, '%Y-%m-%d') AS kept_from FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(F.date_sub(F.to_date("ts"), 14), "yyyy-MM-dd").alias("kept_from"))


@query("x21_math", "SELECT event_id, floor(least(greatest(value, 10), 90)::DOUBLE * 10000 + 0.5::DOUBLE) / 10000 AS v FROM events")
def _(t):
    return t.events.select("event_id", X.round4(X.clamp(F.col("value"), 10.0, 90.0)).alias("v"))


@query(
    "x22_rects",
    "SELECT id, x0 AS ux, y0 AS uy, x1 - x0 AS uw, y1 - y0 AS uh, x <= 1240 AND x + w >= 1000 AND y <= 400 AND y + h >= 100 AS meets, x + w / 2 AS cx, y - 4 AS ey, w + 8 AS ew, pow(greatest(x - 1100, 1100 - (x + w), 0), 2) + pow(greatest(y - 200, 200 - (y + h), 0), 2) AS d2"
    " FROM (SELECT *, least(x, 1000) AS x0, least(y, 100) AS y0, greatest(x + w, 1240) AS x1, greatest(y + h, 400) AS y1 FROM (SELECT p_partkey AS id, p_retailprice AS x, p_size * 10.0::DOUBLE AS y, 30.0::DOUBLE AS w, 20.0::DOUBLE AS h FROM part))",
)
def _(t):
    from ..operators import spatial as P

    one = P.rect(F.col("p_retailprice"), F.col("p_size") * 10, F.lit(30), F.lit(20))
    view = P.rect(F.lit(1000), F.lit(100), F.lit(240), F.lit(300))
    both = t.part.select(F.col("p_partkey").alias("id"), one.alias("r"), P.rect_union(one, view).alias("u"), P.rect_meets(one, view).alias("meets"), P.rect_expand(one, 4.0).alias("e"), P.rect_distance2(one, F.lit(1100.0), F.lit(200.0)).alias("d2"))
    return both.select("id", F.col("u.x").alias("ux"), F.col("u.y").alias("uy"), F.col("u.w").alias("uw"), F.col("u.h").alias("uh"), "meets", (F.col("r.x") + F.col("r.w") / 2).alias("cx"), F.col("e.y").alias("ey"), F.col("e.w").alias("ew"), "d2")


@query("x23_rate_key", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '10.0.0.' || c_custkey % 200 WHEN 1 THEN '2001:db8:0:' || c_custkey % 9 || '::/64' ELSE '203.0.113.7' END AS key FROM customer")
def _(t):
    from ..functions.parsers import rate_key

    m = F.col("c_custkey") % 3
    ip = F.when(m == 0, F.concat(F.lit("::ffff:10.0.0."), (F.col("c_custkey") % 200).cast("string"))).when(m == 1, F.concat(F.lit("2001:db8:0:"), F.hex(F.col("c_custkey") % 9), F.lit("::1"))).otherwise("203.0.113.7")
    return t.customer.select("c_custkey", rate_key(ip).alias("key"))


@query(
    "x24_nearby_tests",
    f"WITH e AS (SELECT unnest({list(X.TEST_ENDINGS)}) AS ending, unnest(range({len(X.TEST_ENDINGS)})) AS k), f AS (SELECT DISTINCT 'src/' || CASE WHEN p_partkey % 2 = 0 THEN '__tests__/' ELSE '' END || p_name || e.ending AS path FROM part JOIN e ON p_partkey % 3 = 0 AND (k = p_partkey % 16 OR k = p_partkey % 5 OR k = 15 OR k = 2)),"
    f" c AS (SELECT p_partkey, 'src/' || d || p_name || ending AS path, k + {len(X.TEST_ENDINGS)} * (d <> '')::INT AS k FROM part, e, (VALUES (''), ('__tests__/')) v(d)), r AS (SELECT p_partkey, path, row_number() OVER (PARTITION BY p_partkey ORDER BY k) AS n FROM c JOIN f USING (path)) SELECT p_partkey, path FROM r WHERE n <= 3",
)
def _(t):
    from ..operators.joins import nearby_tests

    ending = F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.lit(k).alias("k")) for k, e in enumerate(X.TEST_ENDINGS))))
    made = t.part.where("p_partkey % 3 = 0").select("p_partkey", "p_name", ending.alias("x")).where("x.k = p_partkey % 16 OR x.k = p_partkey % 5 OR x.k = 15 OR x.k = 2")
    files = made.select(F.concat(F.lit("src/"), F.when(F.col("p_partkey") % 2 == 0, "__tests__/").otherwise(""), "p_name", "x.e").alias("path"))
    sources = t.part.select("p_partkey", F.concat(F.lit("src/"), "p_name", F.lit(".ts")).alias("path"))
    return nearby_tests(sources, files, "p_partkey")


@query("x25_file_tree", "WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), d AS (SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS dir FROM p, range(1, 9) r(k) WHERE k < len(string_split(path, '/'))) SELECT dir, count(*)::BIGINT AS files FROM d GROUP BY 1")
def _(t):
    from ..operators.joins import prefixes

    p = t.pages.select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    dirs = p.select("path", F.explode(prefixes(F.col("path"))).alias("dir")).where("dir <> '' AND dir <> path")
    return dirs.groupBy("dir").agg(F.count("*").alias("files"))


@query("x26_card_copy", "SELECT doc_id, split_part(text, chr(10), 1) AS signature, 'lines 1-' || len(string_split(text, chr(10))) AS range FROM documents")
def _(t):
    lines = F.split("text", "\n", -1)
    return t.documents.select("doc_id", F.get(lines, F.lit(0)).alias("signature"), F.concat(F.lit("lines 1-"), F.size(lines).cast("string")).alias("range"))


@query("x27_mermaid_escape", "SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '[\\r\\n]+', ' ', 'g'), '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS label FROM pages")
def _(t):
    return t.pages.select("page_id", X.mermaid_label(F.col("html")).alias("label"))


@query("x28_input_hash", "SELECT r_regionkey, sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}') AS hash FROM region")
def _(t):
    return t.region.select("r_regionkey", X.content_hash("r_name", "r_regionkey").alias("hash"))


@query("x29_symbol_digest", "SELECT n_regionkey, sha256(string_agg(n_name, ',' ORDER BY n_name)) AS digest FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("n_name")), ","), 256).alias("digest"))


@query("x30_age_bucket", "SELECT o_orderkey, CASE WHEN d < 86400 * 30 THEN 'month' WHEN d < 86400 * 365 THEN 'year' ELSE 'old' END AS age FROM (SELECT o_orderkey, epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(o_orderdate) AS d FROM orders)")
def _(t):
    d = F.unix_timestamp(F.lit("1998-08-02 00:00:00").cast("timestamp")) - F.unix_timestamp("o_orderdate")
    return t.orders.select("o_orderkey", F.when(d < 86400 * 30, "month").when(d < 86400 * 365, "year").otherwise("old").alias("age"))
