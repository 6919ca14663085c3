"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import aggregates as S
from ..operators import graph as G
from ..operators import joins as J
from ..session import tasks_for
from .join_queries import _PATHS, _RULE_SQL, _paths, _rules
from .registry import Tables, query

_E = f"WITH {A.ENTITIES}, {A.CLOSURE} "


@query(
    "a2_evidence_merge",
    f"WITH {A.LINES}, e AS (SELECT DISTINCT from_id, kind, path, line FROM order_lines), r AS (SELECT *, row_number() OVER (PARTITION BY from_id, kind ORDER BY path, line) AS n FROM e)"
    " SELECT from_id, kind, string_agg(path || ':' || line || ':' || line, ',' ORDER BY n) FILTER (WHERE n <= 3) AS kept, count(*)::BIGINT AS total FROM r GROUP BY 1, 2",
)
def _(t):
    e = A.order_lines(t).select("from_id", "kind", "path", F.col("line").alias("start"), F.col("line").alias("end"))
    return S.merge_evidence(e, ["from_id", "kind"], 3).withColumn("kept", F.array_join("kept", ","))


_IMPORTS = "imports AS (SELECT l_suppkey AS dep, o_custkey AS package, l_orderkey AS path, l_returnflag = 'N' AS type_only FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    "a3_consumer_report",
    f"WITH {_IMPORTS}, f AS (SELECT dep, package, path, bool_and(type_only) AS type_only, count(*) AS n, count(*) FILTER (WHERE type_only) AS t FROM imports GROUP BY 1, 2, 3), p AS (SELECT dep, package, bool_and(type_only) AS type_only, count(*) AS files, sum(n) AS n, sum(t) AS t FROM f GROUP BY 1, 2),"
    " d AS (SELECT DISTINCT s_suppkey AS dep, s_suppkey * 3 AS package FROM supplier) SELECT p.dep, count(*)::BIGINT AS consumers, sum(files)::BIGINT AS files, sum(n)::BIGINT AS imports, sum(t)::BIGINT AS type_only_imports,"
    " count(*) FILTER (WHERE type_only)::BIGINT AS type_only_consumers, count(*) FILTER (WHERE d.dep IS NULL)::BIGINT AS undeclared FROM p LEFT JOIN d ON d.dep = p.dep AND d.package = p.package GROUP BY 1",
)
def _(t):
    # Lines and orders meet by order, where the lines of a file are already together: one row a file goes on.
    lines, orders = t.lineitem.select("l_orderkey", "l_suppkey", (F.col("l_returnflag") == "N").alias("only")), t.orders.select("o_orderkey", "o_custkey")
    n = tasks_for(lines)
    files = lines.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.bool_and("only").alias("only"), F.count("*").alias("n"), F.count_if("only").alias("tn"))
    owners = orders.repartition(n, "o_orderkey").groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("times"))
    rows = files.join(owners.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("dep"), F.col("o_custkey").alias("package"), "only", (F.col("n") * F.col("times")).alias("n"), (F.col("tn") * F.col("times")).alias("tn"))
    packages = rows.repartition(n, "dep", "package").groupBy("dep", "package").agg(F.bool_and("only").alias("only"), F.count("*").alias("files"), F.sum("n").alias("n"), F.sum("tn").alias("tn"))
    declared = t.supplier.select(F.col("s_suppkey").alias("dep"), (F.col("s_suppkey") * 3).alias("package"), F.lit(True).alias("declared"))
    both = packages.join(declared, ["dep", "package"], "left")
    return both.groupBy("dep").agg(
        F.count("*").alias("consumers"), F.sum("files").alias("files"), F.sum("n").alias("imports"), F.sum("tn").alias("type_only_imports"), F.count_if("only").alias("type_only_consumers"), F.count_if(F.col("declared").isNull()).alias("undeclared")
    )


@query("a4_owner_rollup", f"{_E}, own AS (SELECT 'n' || n_nationkey AS id, unnest(CASE WHEN n_nationkey % 3 = 0 THEN ['core', 'web'] WHEN n_nationkey % 3 = 1 THEN ['docs'] ELSE [] END) AS owner FROM nation) SELECT c.ancestor_id AS id, string_agg(DISTINCT owner, ',' ORDER BY owner) AS owners FROM closure c JOIN own USING (id) GROUP BY 1")
def _(t):
    m = F.col("n_nationkey") % 3
    own = t.nation.select(A.tag("n", "n_nationkey").alias("id"), F.explode(F.when(m == 0, F.array(F.lit("core"), F.lit("web"))).when(m == 1, F.array(F.lit("docs"))).otherwise(F.array().cast("array<string>"))).alias("owner"))
    return G.closure(A.entities(t)).join(own, "id").groupBy(F.col("ancestor_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("owner")), ",").alias("owners"))


@query("a5_path_owners", f"WITH m AS (SELECT path, arg_max(owners, rule_no) AS o FROM ({_PATHS}) p JOIN {_RULE_SQL} ON regexp_matches(path, re) GROUP BY path) SELECT unnest(string_split(o, '|')) AS owner, count(*)::BIGINT AS paths FROM m WHERE o <> '' GROUP BY 1")
def _(t):
    m = J.last_match(_paths(t).select("path").distinct(), _rules(t))
    return m.select(F.explode("owners").alias("owner")).groupBy("owner").agg(F.count("*").alias("paths"))


_HITS = "hits AS (SELECT l_orderkey AS path, l_linenumber AS line, count(*) FILTER (WHERE l_discount > 0.03) AS hits FROM lineitem GROUP BY 1, 2)"


def _hits(t: Tables):
    return S.line_hits(t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), (F.col("l_discount") > 0.03).cast("long").alias("hits")))


@query("a6_coverage", f"WITH {_HITS} SELECT path, count(*)::BIGINT AS found, count(*) FILTER (WHERE hits > 0)::BIGINT AS hit, count(*) FILTER (WHERE hits > 0) / count(*) AS rate FROM hits GROUP BY 1")
def _(t):
    return S.coverage(_hits(t))


@query("a7_uncovered_ranges", f"WITH {_HITS}, m AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM hits WHERE hits = 0), r AS (SELECT path, run, min(line) AS s, max(line) AS e FROM m GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s) AS n FROM r) SELECT path, s::INTEGER AS start, CASE WHEN n = 2 THEN s ELSE e END::INTEGER AS \"end\" FROM k WHERE n <= 2")
def _(t):
    return S.islands(_hits(t), most=2)


@query("a8_external_systems", "SELECT l_suppkey AS package, count(*)::BIGINT AS uses, count(DISTINCT l_orderkey)::BIGINT AS files FROM lineitem GROUP BY 1 ORDER BY uses DESC, package LIMIT 8")
def _(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("package")).agg(F.count("*").alias("uses"), F.count_distinct("l_orderkey").alias("files")).orderBy(F.desc("uses"), "package").limit(8)


@query("a9_language_tags", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@query("a10_scope_cost", "SELECT user_id, round(sum(CASE WHEN event_type <> 'view' THEN value END), 4) AS cost, count(*) FILTER (WHERE event_type <> 'view')::BIGINT AS own, max(ts) AS latest FROM events GROUP BY 1")
def _(t):
    own = F.col("event_type") != "view"
    return t.events.groupBy("user_id").agg(F.round(F.sum(F.when(own, F.col("value"))), 4).alias("cost"), F.count_if(own).alias("own"), F.max("ts").cast("timestamp_ntz").cast("timestamp").alias("latest"))


@query("a11_kind_by_state", "SELECT event_type, count(*) FILTER (WHERE value < 20)::BIGINT AS low, count(*) FILTER (WHERE value >= 20)::BIGINT AS high FROM events GROUP BY 1")
def _(t):
    state = F.when(F.col("value") < 20, "low").otherwise("high")
    return t.events.withColumn("state", state).groupBy("event_type").pivot("state", ["low", "high"]).agg(F.count("event_id")).na.fill(0)


@query("a12_latest_failure", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n = 1")
def _(t):
    return t.events.where("event_type = 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("a13_claim_rates", "SELECT lang, count(*) FILTER (WHERE quality = 1)::BIGINT AS supported, count(*) FILTER (WHERE quality = 1) / nullif(count(quality), 0) AS rate, count(*) FILTER (WHERE quality IS NULL)::BIGINT AS unjudged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    both = t.documents.join(t.labels, "doc_id", "left")
    return both.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("supported"), (F.count_if(F.col("quality") == 1) / F.nullif(F.count("quality"), F.lit(0))).alias("rate"), F.count_if(F.col("quality").isNull()).alias("unjudged"))


@query("a14_mean_of_family_means", "SELECT round(avg(m), 6) AS mean FROM (SELECT source, avg(quality) AS m FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)")
def _(t):
    return S.mean_of_means(t.documents.join(t.labels, "doc_id", "left"), "source", "quality").select(F.round("mean", 6).alias("mean"))


@query("a15_recall", "SELECT source, CASE WHEN count(*) FILTER (WHERE quality = 1) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE quality = 1 AND n_chars > 1000) / count(*) FILTER (WHERE quality = 1) END AS recall FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    both = t.documents.join(t.labels, "doc_id", "left")
    want = F.col("quality") == 1
    return both.groupBy("source").agg(S.recall(F.count_if(want & (F.col("n_chars") > 1000)), F.count_if(want)).alias("recall"))


@query("a16_kendall_tau", "SELECT a.r AS region, avg(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE AS tau FROM (SELECT n_regionkey AS r, n_nationkey AS i, n_nationkey AS x, (n_nationkey * 7) % 25 AS y FROM nation) a JOIN (SELECT n_regionkey AS r, n_nationkey AS i, n_nationkey AS x, (n_nationkey * 7) % 25 AS y FROM nation) b ON a.r = b.r AND a.i < b.i GROUP BY 1")
def _(t):
    r = t.nation.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("i"), F.col("n_nationkey").alias("a"), (F.col("n_nationkey") * 7 % 25).alias("b"))
    return S.kendall_tau(r.withColumnRenamed("i", "item"), "region", "item", "a", "b")


@query("a17_top_k_agreement", "WITH r AS (SELECT n_regionkey AS g, n_nationkey AS i, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS a, row_number() OVER (PARTITION BY n_regionkey ORDER BY (n_nationkey * 7) % 25) AS b FROM nation) SELECT g, count(*) FILTER (WHERE a <= 3 AND b <= 3)::BIGINT AS both_top, bool_or(a = 1 AND b = 1) AS same_first, count(*) FILTER (WHERE a <= 3 AND b > 3)::BIGINT AS dropped FROM r GROUP BY 1")
def _(t):
    a = F.row_number().over(G.over(["n_regionkey"], ["n_nationkey"]))
    b = F.row_number().over(G.over(["n_regionkey"], [F.col("n_nationkey") * 7 % 25]))
    r = t.nation.select(F.col("n_regionkey").alias("g"), a.alias("a"), b.alias("b"))
    return r.groupBy("g").agg(F.count_if((F.col("a") <= 3) & (F.col("b") <= 3)).alias("both_top"), F.bool_or((F.col("a") == 1) & (F.col("b") == 1)).alias("same_first"), F.count_if((F.col("a") <= 3) & (F.col("b") > 3)).alias("dropped"))


_CUTS = "(VALUES (500), (1500), (4000)) c(cut)"


@query("a18_confusion_sweep", f"SELECT cut, count(*)::BIGINT AS n, (count(*) FILTER (WHERE (quality = 1) = (n_chars > cut))) / count(*) AS accuracy, count(*) FILTER (WHERE quality = 0 AND n_chars > cut) / nullif(count(*) FILTER (WHERE quality = 0), 0) AS false_acceptance, count(*) FILTER (WHERE quality = 1 AND n_chars <= cut) / nullif(count(*) FILTER (WHERE quality = 1), 0) AS false_alarm FROM documents JOIN labels USING (doc_id), {_CUTS} GROUP BY 1")
def _(t):
    both = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").withColumn("cut", F.explode(F.array(*map(F.lit, (500, 1500, 4000)))))
    return S.confusion(both, F.col("quality") == 1, F.col("n_chars") > F.col("cut"), ["cut"])


@query("a19_nearest_rank", "SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(S.nearest_rank("value", 0.95).alias("p95"), S.nearest_rank("value", 0.5).alias("p50"))


@query("a20_median", "SELECT event_type, coalesce(median(value), 0) AS median FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(S.median_or_zero("value").alias("median"))


@query("a21_repo_signals", f"{_E}, d AS (SELECT id, max(depth) AS depth FROM closure GROUP BY 1) SELECT kind, count(*)::BIGINT AS n, count(DISTINCT parent_id)::BIGINT AS parents, max(depth)::INTEGER AS deepest, median(depth) AS middle FROM entities JOIN d USING (id) GROUP BY 1")
def _(t):
    e = A.entities(t)
    d = G.closure(e).groupBy("id").agg(F.max("depth").alias("depth"))
    return e.join(d, "id").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("parent_id").alias("parents"), F.max("depth").alias("deepest"), F.median("depth").alias("middle"))


@query("a22_eval_metrics", "SELECT lang, count(*)::BIGINT AS questions, round(avg(quality), 6) AS recall, round(avg(toxic), 6) AS declined, median(n_chars) AS size FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def _(t):
    both = t.documents.join(t.labels, "doc_id")
    return both.rollup("lang").agg(F.count("*").alias("questions"), F.round(F.avg("quality"), 6).alias("recall"), F.round(F.avg("toxic"), 6).alias("declined"), F.median("n_chars").alias("size"))


@query("a23_changelog", "WITH d AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) SELECT o_custkey, max(total)::BIGINT AS total, string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) FILTER (WHERE n <= 5) AS first FROM d GROUP BY 1")
def _(t):
    r = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(G.over(["o_custkey"], ["o_orderkey"])).alias("n"))
    kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "o_orderkey")))), lambda x: x["o_orderkey"].cast("string"))
    return r.groupBy("o_custkey").agg(F.count("*").alias("total"), F.array_join(kept, ",").alias("first"))


@query("a24_dropped_facts", "WITH c AS (SELECT l_partkey AS dep, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, dep) AS k FROM c) SELECT CASE WHEN k <= 50 THEN dep END AS dep, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def _(t):
    c = t.lineitem.groupBy(F.col("l_partkey").alias("dep")).agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "dep").limit(50)
    rest = c.join(top.select("dep"), "dep", "left_anti").agg(F.lit(None).cast("long").alias("dep"), F.sum("n").alias("n"))
    return top.unionAll(rest.where("n IS NOT NULL"))


_LEDGER = "ledger AS (SELECT user_id * 1000 + event_id % 40 AS request_id, ts, round(value, 2) AS amount, CASE event_type WHEN 'view' THEN 'reserved' WHEN 'click' THEN 'reserved' WHEN 'purchase' THEN 'settled' WHEN 'error' THEN 'released' ELSE 'note' END AS type FROM events)"


def _ledger(t: Tables):
    e = F.col("event_type")
    kind = F.when(e.isin("view", "click"), "reserved").when(e == "purchase", "settled").when(e == "error", "released").otherwise("note")
    return t.events.select((F.col("user_id") * 1000 + F.col("event_id") % 40).alias("request_id"), "ts", F.round("value", 2).alias("amount"), kind.alias("type"))


@query("a25_ledger_fold", f"WITH {_LEDGER}, p AS (SELECT request_id, max(amount) FILTER (WHERE type = 'reserved') AS r, arg_min(amount, (ts, amount)) FILTER (WHERE type = 'settled') AS s, bool_or(type = 'released') AS x FROM ledger GROUP BY 1) SELECT request_id, coalesce(s, r) AS amount, CASE WHEN s IS NOT NULL THEN 'settled' ELSE 'reserved' END AS state FROM p WHERE r IS NOT NULL AND NOT (x AND s IS NULL)")
def _(t):
    return S.settle_ledger(_ledger(t))


@query("a26_daily_counters", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS requests, round(sum(value), 4) AS dollars FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("dollars"))


@query("a27_spend_headroom", "SELECT user_id, round(sum(value), 4) AS spent, round(greatest(0, 4000 - sum(value)), 4) AS headroom, sum(value) < 4000 AS admitted FROM events GROUP BY 1")
def _(t):
    s = F.sum("value")
    return t.events.groupBy("user_id").agg(F.round(s, 4).alias("spent"), F.round(F.greatest(F.lit(0.0), 4000 - s), 4).alias("headroom"), (s < 4000).alias("admitted"))


@query("a28_document_frequency", "SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents) WHERE length(term) >= 2 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5")
def _(t):
    terms = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("term")).where(F.length("term") >= 2)
    return terms.groupBy("term").agg(F.count("*").alias("df")).where("df >= 5")


@query("a29_relationship_groups", f"WITH {A.ENTITIES}, {A.RELATIONS}, i AS (SELECT to_id AS node, 'in' AS direction, kind, optional FROM relations UNION ALL SELECT from_id, 'out', kind, optional FROM relations) SELECT direction, kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE optional)::BIGINT AS optional FROM i GROUP BY 1, 2")
def _(t):
    r = A.relations(t)
    sides = r.select(F.explode(F.array(F.lit("in"), F.lit("out"))).alias("direction"), "kind", "optional")
    return sides.groupBy("direction", "kind").agg(F.count("*").alias("n"), F.count_if("optional").alias("optional"))


@query("a30_manifest_upsert", "SELECT source AS slug, arg_max(doc_id, (n_chars, doc_id)) AS doc_id, coalesce(max(CASE WHEN lang = 'de' THEN lang END), 'none') AS name FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.col("source").alias("slug")).agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.coalesce(F.max(F.when(F.col("lang") == "de", F.col("lang"))), F.lit("none")).alias("name"))


@query("a31_excerpt_counters", "SELECT source, count(*)::BIGINT AS candidates, count(*) FILTER (WHERE n_chars <= 2000)::BIGINT AS selected, count(*) FILTER (WHERE n_chars > 2000)::BIGINT AS omitted FROM documents GROUP BY 1")
def _(t):
    fits = F.col("n_chars") <= 2000
    return t.documents.groupBy("source").agg(F.count("*").alias("candidates"), F.count_if(fits).alias("selected"), F.count_if(~fits).alias("omitted"))




@query("a32_attention_rollup", f"{_E}, x AS (SELECT id, CASE WHEN rank < 3 THEN 6 WHEN length(name) % 2 = 0 AND id LIKE '%7' THEN 0 WHEN id LIKE '%5' THEN 2 ELSE 4 END AS tier FROM entities) SELECT c.ancestor_id AS id, min(x.tier)::INTEGER AS tier FROM closure c JOIN x ON x.id = c.id GROUP BY 1")
def _(t):
    e = A.entities(t)
    tier = F.when(F.col("rank") < 3, 6).when((F.length("name") % 2 == 0) & F.endswith("id", F.lit("7")), 0).when(F.endswith("id", F.lit("5")), 2).otherwise(4)
    return G.closure(e).join(e.select("id", tier.alias("tier")), "id").groupBy(F.col("ancestor_id").alias("id")).agg(F.min("tier").alias("tier"))


_USE = "u AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN value END AS measured, CASE WHEN event_type = 'click' THEN value END AS estimated FROM events)"


def _use(t: Tables):
    pick = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    return t.events.select("user_id", pick("purchase").alias("measured"), pick("click").alias("estimated"))


@query("a33_run_usage", f"WITH {_USE} SELECT user_id, round(sum(measured), 4) AS measured, round(sum(estimated), 4) AS estimated, count(*) FILTER (WHERE measured IS NULL AND estimated IS NULL)::BIGINT AS unknown FROM u GROUP BY 1")
def _(t):
    return _use(t).groupBy("user_id").agg(F.round(F.sum("measured"), 4).alias("measured"), F.round(F.sum("estimated"), 4).alias("estimated"), F.count_if(F.col("measured").isNull() & F.col("estimated").isNull()).alias("unknown"))


@query("a34_average_cost", f"WITH {_USE} SELECT user_id, round(avg(coalesce(measured, estimated)), 6) AS cost FROM u GROUP BY 1")
def _(t):
    return _use(t).groupBy("user_id").agg(F.round(F.avg(F.coalesce("measured", "estimated")), 6).alias("cost"))


@query("a35_progress_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS done, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failed, count(*)::BIGINT AS attempts FROM events WHERE event_type <> 'view' GROUP BY 1")
def _(t):
    e = F.col("event_type")
    return t.events.where(e != "view").groupBy("user_id").agg(F.count_if(e == "purchase").alias("done"), F.count_if(e == "error").alias("failed"), F.count("*").alias("attempts"))


@query("a36_scope_state", "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT c_custkey, CASE WHEN last IS NULL THEN 'notRun' WHEN last = 'error' THEN 'failed' WHEN c_acctbal < 0 THEN 'stale' ELSE 'ready' END AS state FROM customer LEFT JOIN l ON user_id = c_custkey")
def _(t):
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    both = t.customer.join(last, F.col("c_custkey") == F.col("user_id"), "left")
    state = F.when(F.col("last").isNull(), "notRun").when(F.col("last") == "error", "failed").when(F.col("c_acctbal") < 0, "stale").otherwise("ready")
    return both.select("c_custkey", state.alias("state"))


@query("a37_expected_rank", "WITH p AS (SELECT l_orderkey AS g, l_linenumber AS r, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT g, round(sum(r * q) / sum(q), 6) AS expected_rank FROM p GROUP BY 1 ORDER BY expected_rank DESC, g LIMIT 100")
def _(t):
    p = t.lineitem.groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("r")).agg(F.sum("l_quantity").alias("q"))
    return p.groupBy("g").agg(F.round(F.sum(F.col("r") * F.col("q")) / F.sum("q"), 6).alias("expected_rank")).orderBy(F.desc("expected_rank"), "g").limit(100)


@query("a38_block_candidates", "SELECT o_orderpriority, (CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 9 END)::INTEGER AS position, count(*)::BIGINT AS facts FROM orders GROUP BY 1")
def _(t):
    order = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    place = F.array_position(order, F.col("o_orderpriority"))
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("facts")).withColumn("position", F.when(place > 0, place - 1).otherwise(9).cast("int"))
