"""Facts of code from its token table: statements, declarations, imports, branches, copies and declaration heads.

Scripts are read in the rows of their files, as ``sources.code_tokens`` makes them: tokens are filtered and cut where they lie and never
shuffled. Rust and declaration heads are windows and groups over token rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources.code_tokens import STARTERS, code_tokens
from .graph import shared

#: Least tokens of a body that can be a copy, and the complexity that is too much beyond it.
LEAST_COPY_TOKENS, MOST_COMPLEXITY = 20, 6


def _file() -> WindowSpec:
    return Window.partitionBy("path").orderBy("at")


_KINDS = ("function", "class", "interface", "type", "enum", "namespace", "module", "const", "let", "var")
_BEFORE_KIND = ("export", "default", "declare", "abstract", "async")
#: After a closing brace, these go on with the statement.
_GO_ON = (".", ",", ")", ";", "=", "(", "[", "{", "?", ":", "|", "&", ">", "<", "&&", "||", "??", "?.", "=>", "+", "-", "*", "/", "===", "!==", "from", "as", "satisfies", "else", "catch", "finally", "while", "extends", "implements")
#: After these no statement ends, whatever the next line begins with.
_OPEN_END = ("=", ",", "=>", "(", "[", "{", "+", "-", "*", "/", "&&", "||", "??", "?", ":", "|", "&", "<", ".", "?.", "extends", "implements", "export", "default", "declare", "abstract", "async")


def _rows(tokens: DataFrame) -> DataFrame:
    """A row for each token of files (path, tokens). A file makes hundreds of rows, which the planner's sizes don't show, so they ask to be
    merged and never broadcast."""
    return tokens.select("path", F.inline("tokens")).hint("merge")


def statements(files: DataFrame) -> DataFrame:
    """A row for each top-level statement of scripts (path, tokens), with the other columns of its file: ``statement``, the position of its
    first token, its ``tokens``, and ``after``, the token that follows them.

    A statement ends at a semicolon, after the brace of a declaration or block, or before a line that a statement's word begins. A file's
    tokens stay in its row: nothing is shuffled.
    """

    def begin(x: Column, i: Column) -> Column:
        before, after, text = F.get("top", i - 1), F.get("top", i + 1), x["text"]
        new_line = x["line"] > before["end_line"]
        word = (x["kind"] == "name") & (text.isin(*STARTERS) | (text == "async") & (after["text"] == "function") | (text == "type") & (after["kind"] == "name"))
        ended = (before["text"] == "}") & ~text.isin(*_GO_ON) & (new_line | word)
        return before["text"].isNull() | (before["text"] == ";") | ended | (new_line & word & ~before["text"].isin(*_OPEN_END))

    # What is at the top level and where statements begin are columns of their own, so that they are made once for a file.
    top = files.withColumn("top", F.filter("tokens", lambda x: x["depth"] == 0))
    cut = top.withColumn("begins", F.transform(F.filter("top", begin), lambda x: x["at"])).drop("top")
    end = lambda k: F.coalesce(F.get("begins", k + 1), F.size("tokens"))
    piece = lambda s, k: F.struct(s.alias("statement"), F.slice("tokens", s + 1, end(k) - s).alias("tokens"), F.get("tokens", end(k)).alias("after"))
    others = [c for c in files.columns if c != "tokens"]
    return cut.select(*others, F.explode(F.transform("begins", piece)).alias("s")).select(*others, "s.*")


def declarations(tokens: DataFrame) -> DataFrame:
    """(path, name, kind, line, end_line, exported, first, last, code) of the named top-level declarations of scripts, exported or not.

    Each declarator of a variable statement is one, destructured ones aside; ``first`` and ``last`` are its tokens, ``code`` holds them
    and the one that follows. Names in ``export {...}`` without a source, and in ``export default name``, are exported as well.
    """
    listing = (F.get("tokens", F.lit(0))["text"] == "export") & (F.get("tokens", F.lit(1))["text"] == "{")
    top, one = F.filter("tokens", lambda x: x["depth"] == 0), F.filter("tokens", lambda x: listing & (x["depth"] == 1))
    each = statements(tokens.select("path", "tokens")).withColumns({"top": top, "one": one}).withColumn("t", F.slice("top", 1, 10))
    words = F.transform("t", lambda x: x["text"])
    skip = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.forall(F.slice(words, F.lit(1), i), lambda w: w.isin(*_BEFORE_KIND))), lambda ok: ok))
    h = each.withColumn("skip", skip).withColumn("kw", F.get(words, F.col("skip"))).withColumn("kw2", F.get(words, F.col("skip") + 1))
    const_enum = (F.col("kw") == "const") & (F.col("kw2") == "enum")
    kind = F.when(F.col("kw").isin(*_KINDS), F.when(const_enum, "enum").otherwise(F.col("kw")))
    at_name = F.col("skip") + 1 + F.when(const_enum | (F.col("kw") == "function") & (F.col("kw2") == "*"), 1).otherwise(0)
    h = h.withColumn("name", F.get("t", at_name)).withColumn("kind", kind).withColumn("direct", F.array_contains(F.slice(words, F.lit(1), F.col("skip")), "export"))
    least = lambda ts, c: F.array_min(F.transform(ts, lambda x: x[c]))
    most = lambda ts, c: F.array_max(F.transform(ts, lambda x: x[c]))

    def row(name, kind, ts, direct, listed):
        found = {"name": name, "kind": kind, "line": least(ts, "line"), "end_line": most(ts, "end_line"), "direct": direct, "first": least(ts, "at"), "last": most(ts, "at"), "listed": F.lit(listed)}
        return F.struct(*(c.alias(n) for n, c in found.items()))

    empty = F.array().cast("array<struct<name: string, kind: string, line: int, end_line: int, direct: boolean, first: int, last: int, listed: boolean>>")
    variable = F.col("kind").isin("const", "let", "var")
    single = F.when(~variable & (F.col("name.kind") == "name"), F.array(row(F.col("name.text"), F.col("kind"), F.col("top"), F.col("direct"), False))).otherwise(empty)
    # Declarators: names at the top level after the keyword or a comma, where a type or a value, or the end, comes next.
    h = h.withColumn("own", F.when(variable, F.slice("top", F.col("skip") + 1, F.size("top"))))
    text = lambda i: F.get("own", i)["text"]
    begins = lambda x, i: (x["kind"] == "name") & ((i == 1) | (text(i - 1) == ",") & (text(i + 1).isNull() | text(i + 1).isin("=", ":", ",", ";")))
    h = h.withColumn("places", F.filter(F.transform("own", lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull()))
    cut = lambda i, n: F.slice("own", i + 1, F.coalesce(F.get("places", n + 1), F.size("own")) - i)
    ended = lambda ts: F.when(F.element_at(ts, -1)["text"].isin(",", ";"), F.slice(ts, F.lit(1), F.size(ts) - 1)).otherwise(ts)
    several = F.when(variable, F.transform(F.transform("places", lambda i, n: ended(cut(i, n))), lambda ts: row(F.get(ts, F.lit(0))["text"], F.col("kind"), ts, F.col("direct"), False))).otherwise(empty)
    near = F.transform("one", lambda x, i: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), F.get("one", i - 1)["text"].alias("b"), F.get("one", i - 2)["text"].alias("b2")))
    names = F.filter(near, lambda x: (x["kind"] == "name") & ((x["b"].isNull() | (x["b"] == ",")) & (x["text"] != "type") | (x["b"] == "type") & (x["b2"].isNull() | (x["b2"] == ","))))
    out = F.get(words, F.lit(0)) == "export"
    inside = F.when(out & (F.get(words, F.lit(1)) == "{") & ~F.array_contains(words, "from"), F.transform(names, lambda x: x["text"]))
    alone = F.when(out & F.get(words, F.lit(1)).isin("default", "=") & (F.get("t", F.lit(2))["kind"] == "name") & (F.get(words, F.lit(3)).isNull() | (F.get(words, F.lit(3)) == ";")), F.array(F.get(words, F.lit(2))))
    listed = F.coalesce(F.transform(F.coalesce(inside, alone), lambda name: row(name, F.lit(None).cast("string"), F.col("t"), F.lit(False), True)), empty)
    found = h.select("path", "statement", "tokens", "after", F.explode(F.concat(single, several, listed)).alias("d")).select("path", "statement", "tokens", "after", "d.*")
    found = found.withColumn("code", F.slice(F.concat("tokens", F.array("after")), F.col("first") - F.col("statement") + 1, F.col("last") - F.col("first") + 2)).drop("statement", "tokens", "after")
    found = found.withColumn("exported", F.col("direct") | F.bool_or("listed").over(Window.partitionBy("path", "name"))).where("NOT listed")
    return found.select("path", "name", "kind", "line", "end_line", "exported", "first", "last", "code")


def _string_value(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']|[\"']$", "")


def imports(tokens: DataFrame) -> DataFrame:
    """(path, specifier, line, end_line, dynamic): import and export-from statements, and calls of import with a plain string.

    Type positions (``typeof import("x")``, types and interfaces) are no calls.
    """
    found = lambda s, line, end_line, dynamic: F.struct(_string_value(s).alias("specifier"), line.alias("line"), end_line.alias("end_line"), F.lit(dynamic).alias("dynamic"))
    none = F.array().cast("array<struct<specifier: string, line: int, end_line: int, dynamic: boolean>>")

    def call(x: Column, i: Column) -> Column:
        near = lambda k, c="text": F.get("tokens", i + k)[c]
        text = lambda k: F.coalesce(near(k), F.lit(""))
        called = (x["text"] == "import") & (x["kind"] == "name") & (near(1) == "(") & (near(2, "kind") == "string") & near(3).isin(")", ",") & ~text(-1).isin(".", "typeof", "<", "|", "&", "extends", "keyof")
        typed = (text(-1) == ":") & (text(4) == ".") & text(5).rlike("^[A-Z]")
        return F.when(called & ~typed, F.struct(x["at"].alias("at"), found(near(2), x["line"], near(3, "end_line"), True).alias("call")))

    calls = F.filter(F.transform("tokens", call), lambda c: c.isNotNull())
    each = statements(tokens.select("path", "tokens", calls.alias("calls"))).withColumn("top", F.filter("tokens", lambda x: x["depth"] == 0))
    own = F.transform(F.filter("calls", lambda c: (c["at"] >= F.col("statement")) & (c["at"] < F.col("statement") + F.size("tokens"))), lambda c: c["call"])
    first, has = F.get("top", F.lit(0)), lambda fits: F.exists("top", fits)
    s = F.get(F.reverse(F.filter("top", lambda x: x["kind"] == "string")), F.lit(0))["text"]
    source = has(lambda x: (x["text"] == "from") & (x["kind"] == "name"))
    plain = s.isNotNull() & ~has(lambda x: x["text"].isin("=", "function", "class")) & ((first["text"] == "import") & ~has(lambda x: x["text"] == "(") | (first["text"] == "export") & source)
    typed = F.exists(F.slice("top", 1, 4), lambda x: x["text"].isin("type", "interface"))
    end_line = F.array_max(F.transform("top", lambda x: x["end_line"]))
    every = F.concat(F.when(plain, F.array(found(s, first["line"], end_line, False))).otherwise(none), F.when(typed, none).otherwise(own))
    return each.select("path", F.explode(every).alias("i")).select("path", "i.*")


def import_bindings(tokens: DataFrame) -> DataFrame:
    """(path, local, specifier, exported): what each imported name stands for; ``default`` and ``*`` for the whole module."""
    stated = statements(tokens.select("path", "tokens")).where(F.get("tokens", F.lit(0))["text"] == "import")
    spec = F.array_max(F.transform(F.filter("tokens", lambda x: (x["kind"] == "string") & (x["depth"] == 0)), lambda x: _string_value(x["text"])))
    near = lambda i: F.coalesce(F.get("tokens", i)["text"], F.lit(""))
    seen = F.transform("tokens", lambda x, i: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), x["depth"].alias("depth"), near(i - 1).alias("b1"), near(i - 2).alias("b2"), near(i + 1).alias("a1")))
    rows = stated.select("path", spec.alias("specifier"), F.explode(seen).alias("x")).select("path", "specifier", "x.*").where("kind = 'name' AND specifier IS NOT NULL")
    whole = rows.where("depth = 0 AND b1 = 'as' AND b2 = '*'").select("path", F.col("text").alias("local"), "specifier", F.lit("*").alias("exported"))
    default = rows.where("depth = 0 AND (b1 = 'import' OR b1 = 'type' AND b2 = 'import') AND a1 IN (',', 'from') AND NOT (text = 'type' AND a1 <> 'from')").select("path", F.col("text").alias("local"), "specifier", F.lit("default").alias("exported"))
    named = rows.where("depth = 1")
    renamed = named.where("b1 = 'as'").select("path", F.col("text").alias("local"), "specifier", F.col("b2").alias("exported"))
    same = named.where("(b1 IN ('{', ',') AND text <> 'type' OR b1 = 'type' AND b2 IN ('{', ',')) AND a1 IN (',', '}')").select("path", F.col("text").alias("local"), "specifier", F.col("text").alias("exported"))
    return whole.unionAll(default).unionAll(renamed).unionAll(same)


def function_bodies(tokens: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, name, line, first, last, own, code): declarations that are functions, with the scope that their body is; of a variable,
    from its value on. ``code`` holds their tokens and the one that follows.

    Declarations that lost their ``code`` get it from ``tokens`` by path; those of :func:`declarations` have it, and nothing is shuffled.
    """
    d = declared.where("kind IN ('function', 'const', 'let', 'var')")
    if "code" not in d.columns:
        d = d.join(tokens.select("path", "tokens").hint("merge"), "path").withColumn("code", F.slice("tokens", F.col("first") + 1, F.col("last") - F.col("first") + 2))
    d = d.select("path", "name", "line", "kind", "first", "last", "code")
    d = d.withColumn("top", F.filter(F.slice("code", F.lit(1), F.col("last") - F.col("first") + 1), lambda x: x["depth"] == 0))
    at = lambda fits: F.transform(F.filter("top", fits), lambda x: x["at"])
    d = d.withColumns({"eq": F.get(at(lambda x: x["text"] == "="), F.lit(0)), "body": F.array_max(at(lambda x: x["text"] == "{")), "arrows": at(lambda x: x["text"] == "=>")})
    d = d.withColumn("arrow", F.get(F.filter("arrows", lambda a: a > F.col("eq")), F.lit(0)))
    text = lambda at: F.get("code", at - F.col("first"))["text"]
    value, arrow = F.col("eq") + 1, F.col("arrow")
    v_text, v_next = text(value), text(value + 1)
    has_value = (v_text == "function") | (v_text == "async") & (v_next == "function") | arrow.isNotNull() & ((v_text == "(") | (v_text == "<") | (v_text == "async") | (v_next == "=>"))
    kept = d.where(F.when(F.col("kind") == "function", F.col("body").isNotNull()).otherwise(F.coalesce(has_value, F.lit(False))))
    own = F.when((F.col("kind") != "function") & arrow.isNotNull(), F.when(text(arrow + 1) == "{", arrow + 1).otherwise(arrow)).otherwise(F.col("body"))
    skip = F.when(F.col("kind") == "function", 0).otherwise(value - F.col("first"))
    return kept.select("path", "name", "line", (F.col("first") + skip).alias("first"), "last", own.alias("own"), F.slice("code", skip + 1, F.size("code")).alias("code"))


def complexity(tokens: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, name, line, complexity, flagged): one and the branches of each function's own body; functions and classes inside it
    have their own."""
    bodies = function_bodies(tokens, declared)

    def branch(x: Column, i: Column) -> Column:
        text, near = x["text"], lambda k: F.get("code", i + k)["text"]
        # The while of a do statement follows a closing brace that the do opened, and is counted for it.
        word = text.isin("if", "for", "catch", "case") & ~F.coalesce(near(-1), F.lit("")).isin(".", "?.") & ~near(1).isin(":", ",", "=")
        loop = (text == "while") & (F.coalesce(near(-1), F.lit("")) != ".")
        logic = text.isin("&&", "||", "??", "&&=", "||=", "??=")
        choice = (text == "?") & ~F.coalesce(near(1), F.lit("")).isin(":", ")", ",", ";", "=")
        own = (x["scope"] == F.col("own")) | (x["scope"] < F.col("first"))  # parameters and types stand before the body
        return ((x["kind"] == "name") & (word | loop) | (x["kind"] == "mark") & (logic | choice)) & own

    code = F.slice("code", F.lit(1), F.col("last") - F.col("first") + 1)
    counts = bodies.select("path", "name", "line", (1 + F.size(F.filter(code, branch))).cast("int").alias("complexity"))
    return counts.withColumn("flagged", F.col("complexity") > MOST_COMPLEXITY)


def copy_fingerprints(tokens: DataFrame, declared: DataFrame, least: int = LEAST_COPY_TOKENS) -> DataFrame:
    """(path, name, line, tokens, fingerprint) of functions of ``least`` tokens or more: names and literals count as alike.

    Keywords and marks stand for themselves, and brackets are among them, so equal fingerprints mean equal structure.
    """
    bodies = function_bodies(tokens, declared).withColumn("tokens", (F.col("last") - F.col("first") + 1).cast("long")).where(F.col("tokens") >= least)

    def shape(x: Column) -> Column:
        return F.when((x["kind"] == "name") & ~x["text"].isin(*sorted(_WORDS)), "I").when(x["kind"].isin("number", "string", "template", "regex"), "L").otherwise(x["text"])

    shapes = F.transform(F.slice("code", F.lit(1), F.col("tokens").cast("int")), shape)
    return bodies.select("path", "name", "line", "tokens", F.sha2(F.array_join(shapes, " "), 256).alias("fingerprint"))


#: The reserved words of scripts.
_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true"
    " try typeof var void while with implements interface let package private protected public static yield any as async await boolean declare from get keyof namespace never of readonly set"
    " string number symbol type undefined unknown bigint object satisfies abstract".split()
)

#: Words of Rust items, and what may stand between attributes and them.
_ITEMS = ("fn", "struct", "enum", "trait", "mod", "type", "const", "static", "union")
_BEFORE_ITEM = ("pub", "async", "unsafe", "const", "default", "extern", "crate")


def rust_outline(tokens: DataFrame) -> DataFrame:
    """(path, name, line, end_line, exported): items of Rust files, and functions of impl blocks as ``Type::function``.

    Items marked as tests are left out. ``pub`` exports, ``pub(crate)`` does not.
    """
    tokens = _rows(tokens)
    own = Window.partitionBy("path", "inside").orderBy("at")
    lag = lambda c, k=1: F.lag(c, k).over(own)
    # Items begin where the one before ended: at the first token of a block, after a semicolon or a closing brace.
    t = tokens.withColumn("prev", lag("text")).withColumn("begins", F.col("prev").isNull() | F.col("prev").isin(";", "}"))
    t = t.withColumn("item", F.last(F.when(F.col("begins"), F.col("at")), True).over(own))
    # Attributes and visibility have brackets of their own; within an item only its own level counts.
    level = Window.partitionBy("path", "inside", "item").orderBy("at")
    kw = t.where((F.col("kind") == "name") & F.col("text").isin(*_ITEMS, "impl", "macro_rules"))
    nxt = tokens.select(F.col("path").alias("n_path"), (F.col("at") - 1).alias("n_at"), F.when(F.col("text") == "mut", F.lead("text").over(_file())).otherwise(F.col("text")).alias("next"), F.col("kind").alias("next_kind"))
    kw = kw.join(nxt, (F.col("path") == F.col("n_path")) & (F.col("at") == F.col("n_at"))).drop("n_path", "n_at")
    kw = kw.where(~((F.col("text") == "const") & F.col("next").isin("fn", "unsafe", "async", "extern")))
    first = kw.withColumn("n", F.row_number().over(level)).where("n = 1").select("path", "inside", "item", F.col("text").alias("word"), "next", "next_kind", F.col("at").alias("kw_at"), "depth")
    extent = t.groupBy("path", "inside", "item").agg(F.max("end_line").alias("end_line"), F.max_by("at", F.when(F.col("text") == "{", F.col("at"))).alias("body"), F.collect_list(F.struct("at", "text", "partner", "line")).alias("level"))
    items = first.join(extent, ["path", "inside", "item"])
    before = F.filter(F.sort_array("level"), lambda x: x["at"] < F.col("kw_at"))
    attributes = F.filter(before, lambda x: x["text"] == "[")
    item_line = F.array_min(F.transform(F.filter(before, lambda x: x["text"].isin(*_BEFORE_ITEM) & (x["at"] > F.coalesce(F.array_max(F.transform(attributes, lambda a: a["partner"])), F.lit(-1)))), lambda x: x["line"]))
    pub = F.filter(before, lambda x: x["text"] == "pub")
    items = items.withColumn("pub_at", F.get(pub, F.lit(0))["at"]).withColumn("attrs", F.transform(attributes, lambda a: a["at"])).withColumn("item_line", item_line)
    paren = tokens.where("text = '('").select(F.col("path").alias("p_path"), F.col("at").alias("p_at"))
    items = items.join(paren, (F.col("path") == F.col("p_path")) & (F.col("p_at") == F.col("pub_at") + 1), "left")
    inner = tokens.select(F.col("path").alias("a_path"), F.col("inside").alias("a_in"), F.col("at").alias("a_at"), F.col("text").alias("a_text"), F.lag("text").over(_file()).alias("a_before"), F.lag("text", 2).over(_file()).alias("a_before2"))
    marks = items.select("path", "item", "inside", F.explode("attrs").alias("attr")).join(inner, (F.col("path") == F.col("a_path")) & (F.col("attr") < F.col("a_at")) & (F.col("a_at") <= F.col("attr") + 8))
    # A test mark: [test], [cfg(test)] or [cfg(all(test ...)].
    tests = marks.where("a_text = 'test' AND (a_before = '[' OR a_before = '(' AND a_before2 IN ('cfg', 'all'))").select("path", "inside", "item").distinct().withColumn("test", F.lit(True))
    items = items.join(tests, ["path", "inside", "item"], "left").where("test IS NULL")
    kw_line = tokens.select(F.col("path").alias("l_path"), F.col("at").alias("l_at"), F.col("line").alias("kw_line"))
    items = items.join(kw_line, (F.col("path") == F.col("l_path")) & (F.col("kw_at") == F.col("l_at")))
    items = shared(items.drop("level", "attrs"))  # a few short rows for each file, read for three kinds of items
    row = lambda df, name: df.select("path", name.alias("name"), F.coalesce("item_line", "kw_line").alias("line"), "end_line", (F.col("pub_at").isNotNull() & F.col("p_at").isNull()).alias("exported"))
    macro = items.where("word = 'macro_rules' AND depth = 0").join(tokens.select(F.col("path").alias("m_path"), F.col("at").alias("m_at"), F.col("text").alias("m_name")), (F.col("path") == F.col("m_path")) & (F.col("m_at") == F.col("kw_at") + 2))
    top = items.where((F.col("depth") == 0) & ~F.col("word").isin("impl", "macro_rules") & (F.col("next_kind") == "name"))
    # The type of an impl: the last name at angle depth 0 before the body or where clause, after ``for`` if there is one.
    impl = items.where("word = 'impl' AND depth = 0 AND body IS NOT NULL").select("path", F.col("kw_at").alias("i_at"), "body", F.col("item").alias("impl_item"))
    span = tokens.select(F.col("path").alias("s_path"), "at", "kind", "text", F.col("depth").alias("d"))
    head = impl.join(span, (F.col("path") == F.col("s_path")) & (F.col("at") > F.col("i_at")) & (F.col("at") < F.col("body")) & (F.col("d") == 0))
    angle = F.sum(F.when(F.col("text") == "<", 1).when(F.col("text") == ">", -1).otherwise(0)).over(Window.partitionBy("path", "i_at").orderBy("at"))
    head = head.withColumn("angle", angle).where("angle = 0 AND text <> '>'")
    where_at = F.min(F.when(F.col("text") == "where", F.col("at"))).over(Window.partitionBy("path", "i_at"))
    head = head.withColumn("w", where_at).where("w IS NULL OR at < w")
    named = head.groupBy("path", "body").agg(F.max_by("text", F.when((F.col("kind") == "name") & (F.col("text") != "for"), F.col("at"))).alias("type"))
    methods = items.where("word = 'fn' AND depth = 1").join(named.select(F.col("path").alias("t_path"), F.col("body").alias("t_body"), "type"), (F.col("path") == F.col("t_path")) & (F.col("inside") == F.col("t_body")))
    return row(top, F.col("next")).unionAll(row(macro, F.col("m_name"))).unionAll(row(methods, F.concat("type", F.lit("::"), "next")))


def rust_roots(tokens: DataFrame) -> DataFrame:
    """(path, root, line, kind): first segments of use trees and extern crates, own paths left out, whatever block they stand in."""
    tokens = _rows(tokens)
    at = lambda c, k: F.lead(c, k).over(_file())
    near = tokens.select("path", "at", "text", "kind", "line", "inside", "depth", F.lag("text").over(_file()).alias("before"), at("text", 1).alias("n1"), at("kind", 1).alias("k1"), at("text", 2).alias("n2"), at("kind", 2).alias("k2"))
    stated = (F.col("kind") == "name") & F.coalesce("before", F.lit(";")).isin(";", "}", "{", "pub", ")", "]")
    plain = near.where(stated & (F.col("text") == "use") & ((F.col("k1") == "name") | (F.col("n1") == "::") & (F.col("k2") == "name"))).select("path", F.when(F.col("k1") == "name", F.col("n1")).otherwise(F.col("n2")).alias("root"), "line", F.lit("use").alias("kind"))
    crates = near.where(stated & (F.col("text") == "extern") & (F.col("n1") == "crate") & (F.col("k2") == "name")).select("path", F.col("n2").alias("root"), "line", F.lit("externCrate").alias("kind"))
    # A list without a path before it: each of its elements is a root.
    lists = near.where(stated & (F.col("text") == "use") & (F.col("n1") == "{")).select("path", (F.col("at") + 1).alias("list"), F.col("line").alias("u_line"))
    inside = near.where("kind = 'name' AND before IN ('{', ',')").join(lists.withColumnRenamed("path", "l_path"), (F.col("path") == F.col("l_path")) & (F.col("inside") == F.col("list"))).select("path", F.col("text").alias("root"), F.col("u_line").alias("line"), F.lit("use").alias("kind"))
    every = plain.unionAll(crates).unionAll(inside).withColumn("root", F.regexp_replace("root", "^r#", ""))
    return every.where(~F.col("root").isin("crate", "self", "super", "Self")).distinct()


#: Lines before a declaration that belong to it without being its head: blank ones, comments, attributes and decorators.
_PREAMBLE = r"^\s*($|//|/\*|\*|#!?\[|@)"
#: Words that may stand before ``function``, before a method's name, and before ``fn``.
_FUNCTION_WORDS = ("export", "default", "declare", "async")
_METHOD_WORDS = ("public", "private", "protected", "static", "readonly", "abstract", "override", "async", "get", "set", "declare")
_FN_WORDS = ("pub", "const", "async", "unsafe", "default", "extern")
_NO_METHODS = ("if", "for", "while", "switch", "return", "catch", "new", "typeof", "await", "yield")
#: After these a brace opens a type.
_BEFORE_TYPE = (":", "|", "&", "(", "[", "?", "=", "extends", "keyof", "readonly", "impl", "dyn")


def _leading(words: Column, known: tuple[str, ...]) -> Column:
    """How many of the first words are among the known ones."""
    stop = F.array_position(F.transform(words, lambda w: w.isin(*known)), False)
    return F.when(stop == 0, F.size(words)).otherwise(stop - 1).cast("int")


def signatures(excerpts: DataFrame) -> DataFrame:
    """(id, signature) of code excerpts (id, path, text): what others see of a declaration, with blanks collapsed.

    Of a function, method, function value or Rust function that is its head up to the body's brace: generics, parameters, an
    object as the return type and a where clause are in it, and so are all overloads before the body. Of all else it is the whole
    text. Comments and attributes before the declaration belong to it. A null text has a null signature.
    """
    lines = F.split("text", "\n", -1)
    skipped = F.array_position(F.transform(lines, lambda x: x.rlike(_PREAMBLE)), False)
    first = F.when(skipped == 0, F.size(lines) - 1).otherwise(skipped - 1).cast("int")
    # Made texts can be far larger than the planner takes them for: they are merged, never broadcast.
    own = excerpts.select(F.col("id").cast("string").alias("id"), "path", lines.alias("lines"), first.alias("first")).hint("merge")
    join = lambda a, n: F.array_join(F.slice("lines", a, n), "\n")
    own = own.select("id", "path", join(F.lit(1), F.col("first")).alias("preamble"), join(F.col("first") + 1, F.size("lines")).alias("text"))
    rust = F.coalesce(F.endswith("path", F.lit(".rs")), F.lit(False)) | F.coalesce(F.col("text").rlike(r"^\s*(pub(\s*\([^)]*\))?\s+)?((const|async|unsafe|default|extern(\s+\"[^\"]*\")?)\s+)*fn\s"), F.lit(False))
    files = lambda which: own.where(which).select(F.col("id").alias("path"), "text")
    t = _rows(code_tokens(files(~rust)).unionAll(code_tokens(files(rust), rust=True)))
    turn = F.when((F.col("depth") == 0) & (F.col("text") == "<"), 1).when((F.col("depth") == 0) & (F.col("text") == ">"), -1).otherwise(0)
    t = t.withColumn("angle", F.sum(turn).over(_file())).withColumn("level", (F.col("depth") == 0) & (F.col("angle") <= 0))
    t = t.withColumn("before", F.lag("text").over(_file())).withColumn("next", F.lead("text").over(_file())).withColumn("gap_from", F.coalesce(F.lag("stop").over(_file()), F.lit(0)))
    ends = F.when(F.col("level") & (F.col("text") == ";"), 1).otherwise(0)
    t = t.withColumn("seg", F.sum(ends).over(_file()) - ends)
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("path", "seg").orderBy("at")))
    at = lambda cond, what="at": F.min_by(what, F.when(cond, F.col("at")))
    text = F.col("text")
    parts = t.groupBy("path", "seg").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= 24, F.struct("at", "text", "kind", "depth")))), lambda x: F.struct(x["text"], x["kind"], x["depth"])).alias("head"),
        at(F.col("level") & (text == "("), "partner").alias("closed"),
        F.min(F.when((F.col("depth") == 0) & (text == "where"), F.col("at"))).alias("where_at"),
        at((F.col("depth") == 0) & (text == "="), "next").alias("v_text"),
        F.sort_array(F.collect_list(F.when(F.col("level") & (text == "{"), F.struct("at", "stop", "before")))).alias("braces"),
        F.max(F.when(F.col("level") & (text == ";"), F.col("stop"))).alias("semi"),
        F.min("start").alias("start"),
        F.min_by("gap_from", "at").alias("gap_from"),
    )
    words = F.transform(F.filter("head", lambda x: x["depth"] == 0), lambda x: x["text"])
    script = F.slice(words, _leading(words, _FUNCTION_WORDS) + 1, F.size(words))
    method = F.slice(words, _leading(words, _METHOD_WORDS) + 1, F.size(words))
    method = F.when(F.get(method, F.lit(0)) == "*", F.slice(method, 2, 24)).otherwise(method)
    plain_words = F.filter(words, lambda w: ~w.isin("(", ")") & ~w.rlike('^"'))
    fn = F.slice(plain_words, _leading(plain_words, _FN_WORDS) + 1, F.size(plain_words))
    after_name = F.when(F.get(method, F.lit(1)) == "?", F.get(method, F.lit(2))).otherwise(F.get(method, F.lit(1)))
    is_method = F.get(method, F.lit(0)).rlike(r"^[\w$#]+$") & ~F.get(method, F.lit(0)).isin(*_NO_METHODS, "function", "const", "let", "var") & after_name.isin("(", "<")
    is_value = F.get(script, F.lit(0)).isin("const", "let", "var") & F.col("v_text").isin("function", "(", "<", "async")
    starts = F.coalesce((F.get(script, F.lit(0)) == "function") | (F.get(fn, F.lit(0)) == "fn") | is_value | is_method, F.lit(False))
    body = F.get(F.filter("braces", lambda b: (b["at"] > F.col("closed")) & (F.coalesce((F.col("where_at") > F.col("closed")) & (F.col("where_at") < b["at"]), F.lit(False)) | ~b["before"].isin(*_BEFORE_TYPE))), F.lit(0))["stop"]
    # Overloads follow each other with blanks between; anything else ends the chain.
    source = own.select(F.col("id").alias("o_id"), F.col("text").alias("code"))
    parts = parts.join(source, F.col("path") == F.col("o_id")).withColumn("blank", (F.col("seg") == 0) | (F.trim(F.regexp_replace(F.substring(F.col("code"), F.col("gap_from") + 1, F.col("start") - F.col("gap_from")), r"\s+", " ")) == ""))
    parts = parts.select("path", F.struct("seg", (starts & F.col("blank")).alias("fn"), F.when(F.col("closed").isNotNull(), body).alias("body"), F.when(F.col("closed").isNotNull(), F.col("semi")).alias("semi")).alias("p"))
    none = F.struct(F.lit(None).cast("int").alias("end"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        end = F.when(s["done"] | ~p["fn"], s["end"]).otherwise(F.coalesce(p["body"], p["semi"]))
        return F.struct(end.alias("end"), (s["done"] | ~p["fn"] | p["body"].isNotNull() | p["semi"].isNull()).alias("done"))

    chain = parts.groupBy("path").agg(F.aggregate(F.sort_array(F.collect_list("p")), none, step)["end"].alias("end"))
    both = own.drop("path").join(chain.withColumnRenamed("path", "id"), "id", "left")
    head = F.when(F.col("end").isNotNull(), F.substring(F.col("text"), F.lit(1), F.col("end"))).otherwise(F.col("text"))
    return both.select("id", F.trim(F.regexp_replace(F.concat("preamble", F.lit("\n"), head), r"\s+", " ")).alias("signature"))


def signature_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) of excerpts (id, path, text) of two versions: added, removed, same, internal, or surface where the signature changed."""
    side = lambda df, n: df.select(F.col("id").cast("string").alias("id"), F.col("text").alias(f"text{n}")).hint("merge").join(signatures(df).withColumnRenamed("signature", f"s{n}"), "id").withColumn(f"in{n}", F.lit(True))
    both = side(before, 1).join(side(after, 2), "id", "full_outer")
    change = F.when(F.col("in1").isNull(), "added").when(F.col("in2").isNull(), "removed").when(F.col("text1").eqNullSafe(F.col("text2")), "same").when(F.col("s1").eqNullSafe(F.col("s2")), "internal").otherwise("surface")
    return both.select("id", change.alias("change"))
