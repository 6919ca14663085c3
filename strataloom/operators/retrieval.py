"""Lexical retrieval: identifier-aware tokens, weighted fields, BM25F, typo tolerance and graph expansion.

The index is two tables, postings (term, doc, wtf) and vocabulary (term, df); questions come as a DataFrame, so one job
answers many.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import shared, written

#: Words that say nothing, weights and length normalisation of the fields, and the constants of the score.
STOPWORDS = tuple(
    "a about after all also an and any are as at be been before being but by can could did do does doing done each for from get gets had has have how"
    " i if in into is it its just me my no not of on or our out over should so some tell than that the their them then there these they this those to up us"
    " was way we were what when where which while who whom why will with would you your explain work works happen happens use used uses using between"
    " during via through until become becomes became happened want need okay please actually exactly really src ts tsx js mjs cjs rs json lib dist".split()
)
FIELD_WEIGHTS = {"name": 3.0, "symbol": 3.0, "path": 2.0, "summary": 1.5, "parents": 0.3, "excerpt": 0.6}
FIELD_NORM = {"name": 0.3, "symbol": 0.3, "path": 0.3, "summary": 0.6, "parents": 0.2, "excerpt": 0.75}
K1, FUZZY_WEIGHT, PREFIX_WEIGHT, SYNONYM_WEIGHT = 1.2, 0.6, 0.7, 0.5
MOST_EXPANSIONS, MOST_TOKENS, MIN_RELATIVE_SCORE = 24, 32, 0.06
#: The software vocabulary bridge.
SYNONYMS = {
    "sign": ("auth", "oauth", "login", "session"),
    "signin": ("auth", "oauth", "login", "session"),
    "login": ("auth", "oauth", "session", "signin"),
    "auth": ("oauth", "login", "session"),
    "authenticate": ("auth", "oauth", "login"),
    "authorize": ("auth", "access", "permission"),
    "permission": ("access", "authorize"),
    "choose": ("select", "pick"),
    "pick": ("select", "choose"),
    "select": ("choose", "pick"),
    "spend": ("cost", "budget"),
    "cost": ("spend", "budget"),
    "money": ("cost", "budget", "spend"),
    "repo": ("repository",),
    "repository": ("repo",),
}


#: The endings that a pass takes off, in three groups of which the first ending that fits is applied:
#: (ending, least length of the word, what comes instead, endings that forbid it).
ENDINGS = (
    (("ies", 5, "y", ()), ("sses", 5, "ss", ()), ("s", 4, "", ("ss", "us", "is"))),
    (("ing", 6, "", ()), ("ed", 5, "", ()), ("er", 6, "", ())),
    (("e", 5, "", ()),),
)
#: Consonants that are written once where the second group left them double.
DOUBLED = frozenset("bcdfghjkmnpqrtvwxy")


def _cut(word: str, group: tuple) -> str:
    for ending, least, instead, but in group:
        if word.endswith(ending) and len(word) >= least and not word.endswith(but or ("\0",)):
            return word.removesuffix(ending) + instead
    return word


def stem_word(word: str, passes: int = 4) -> str:
    """A word's stem: passes over the table of endings until nothing changes, ``passes`` at most."""
    for _ in range(passes):
        before = word
        for step, group in enumerate(ENDINGS):
            short = _cut(word, group)
            if step == 1 and short != word and len(short) > 3 and short[-1] == short[-2] and short[-1] in DOUBLED:
                short = short[:-1]
            word = short
        if word == before:
            break
    return word


_STEMS: dict[str, str] = {}


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    """Stems in Arrow batches. As nested expressions the rules ran some fifty times slower, all of them outside codegen;
    a worker keeps the stems of words it has seen, up to a bound."""
    if len(_STEMS) > 500_000:
        _STEMS.clear()
    new = set(words.dropna()).difference(_STEMS)
    _STEMS.update((w, stem_word(w)) for w in new)
    return words.map(_STEMS)


def _split_words(text: Column) -> Column:
    """The text with a blank at each change of case that parts a word of an identifier."""
    s = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def raw_tokens(text: Column) -> Column:
    """Lower-case parts of identifiers: camel case, acronyms, underscores and paths are split."""
    return F.split(F.lower(_split_words(text)), "[^a-z0-9]+")


def compounds(text: Column) -> Column:
    """The joined lower-case forms of the identifiers of at most 16 characters that :func:`raw_tokens` splits."""
    camel = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{2,16}(?![A-Za-z0-9]))(?=[A-Za-z0-9]*(?:[a-z0-9][A-Z]|[A-Z][A-Z][a-z]))[A-Za-z0-9]+"
    return F.transform(F.regexp_extract_all(text, F.lit(camel), F.lit(0)), lambda c: F.lower(c))


def _worth(c: Column) -> Column:
    return (F.length(c) >= 2) & ~c.rlike("^[0-9]+$") & ~c.isin(*STOPWORDS)


def _stemmed(df: DataFrame) -> DataFrame:
    """Rows of raw words (column term) that are worth searching, as stems."""
    out = df.where(_worth(F.col("term"))).withColumn("term", stem(F.col("term")))
    return out.where((F.length("term") >= 2) & ~F.col("term").isin(*STOPWORDS))


def tokens(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, position, term): stemmed tokens worth searching."""
    return _stemmed(df.select(*keys, F.posexplode(raw_tokens(text)).alias("position", "term")))


#: Letters and digits side by side, with the two other characters whose lower case holds an ASCII letter.
_RUN = re.compile("[A-Za-z0-9\u0130\u212a]+")
_CASE, _ACRONYM = re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])")
_COMPOUND = re.compile("(?<![A-Za-z0-9])(?=[A-Za-z0-9]{2,16}(?![A-Za-z0-9]))(?=[A-Za-z0-9]*(?:[a-z0-9][A-Z]|[A-Z][A-Z][a-z]))[A-Za-z0-9]+")
_STOP = frozenset(STOPWORDS)


def _run_terms(run: str, joined: bool, all_words: bool) -> tuple[str, ...]:
    """The stems of a run: of its :func:`raw_tokens`, if ``joined`` of its :func:`compounds`, if ``all_words`` not only of those worth searching."""
    words = re.split("[^a-z0-9]+", _ACRONYM.sub(r"\1 \2", _CASE.sub(r"\1 \2", run)).lower())
    if joined:
        words += [c.lower() for c in _COMPOUND.findall(run)]
    if all_words:
        return tuple(stem_word(w) for w in words if w)
    stems = (stem_word(w) for w in words if len(w) >= 2 and not w.isdigit() and w not in _STOP)
    return tuple(x for x in stems if len(x) >= 2 and x not in _STOP)


_RUNS: dict[tuple[bool, bool], dict[str, tuple[str, ...]]] = {}


def count_terms(text: str | None, joined: bool = True, all_words: bool = False) -> Counter:
    """Stems of a text and how often they come. A worker keeps the stems of runs it has seen, up to a bound; runs never
    lap over, so a text is the sum of them."""
    known = _RUNS.setdefault((joined, all_words), {})
    if len(known) > 500_000:
        known.clear()
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall(text or "")).items():
        terms = known.get(run)
        if terms is None:
            terms = _run_terms(run, joined, all_words)
            if len(run) <= 64:
                known[run] = terms
        for x in terms:
            out[x] += n
    return out


def text_terms(df: DataFrame, keys: list[str], text: Column, joined: bool = True, all_words: bool = False) -> DataFrame:
    """(keys, term, n) of each row, counted where its text lies: see :func:`count_terms`."""
    kept = df.select(*keys, text.alias("_text"))
    kind = T.StructType([*kept.select(*keys).schema.fields, T.StructField("_terms", T.ArrayType(T.StringType())), T.StructField("_ns", T.ArrayType(T.LongType()))])

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # what a worker holds stays small
                part = batch.slice(at, 512)
                bags = [count_terms(x.as_py(), joined, all_words) for x in part.column(len(keys))]
                made = [pa.array([list(b) for b in bags], pa.list_(pa.string())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), *made], [*keys, "_terms", "_ns"])

    return kept.mapInArrow(count, kind).select(*keys, F.explode(F.arrays_zip("_terms", "_ns")).alias("_x")).select(*keys, F.col("_x._terms").alias("term"), F.col("_x._ns").alias("n"))


def term_counts(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, term, tf) with compounds."""
    return text_terms(df, keys, text).groupBy(*keys, "term").agg(F.sum("n").alias("tf"))


def _bags(batches):
    """Documents (doc, texts) with the words of each field (lens) and, term by term, its count in each field (bag)."""
    place = {f: i for i, f in enumerate(FIELD_WEIGHTS)}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ends, terms, counts, lens = [0], [], [[] for _ in place], [[] for _ in place]
            for texts in part.column(1).to_pylist():
                bags = [Counter() for _ in place]
                for x in texts:
                    if x["field"] in place:
                        bags[place[x["field"]]].update(count_terms(x["text"]))
                own = list(dict.fromkeys(term for bag in bags for term in bag))
                terms += own
                ends.append(len(terms))
                for bag, column, length in zip(bags, counts, lens):
                    column += map(bag.get, own)
                    length.append(sum(bag.values()))
            made = pa.StructArray.from_arrays([pa.array(terms, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["term", *place])
            lengths = pa.StructArray.from_arrays([pa.array(n, pa.int64()) for n in lens], list(place))
            yield pa.RecordBatch.from_arrays([part.column(0), lengths, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], ["doc", "lens", "bag"])


def build_index(fields: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, vocabulary, size) of fields (doc, field, text), field being one of FIELD_WEIGHTS.

    A term's weight in a document is the sum over fields of weight * tf / (1 - b + b * length / mean length), the mean
    being at least 1. Texts are shuffled once, by document, and counted there, so words are never shuffled one by one; the
    counts are written to the shared folder, postings are read from them and nothing stays in memory.
    """
    n = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given as a number: tasks follow the work on texts, not their compressed bytes
    texts = fields.select("doc", "field", "text").repartition(n, "doc").groupBy("doc").agg(F.collect_list(F.struct("field", "text")).alias("texts"))
    longs = lambda names: ", ".join(f"{f}: bigint" for f in names)
    kind = T.StructType([texts.schema["doc"], *T._parse_datatype_string(f"lens struct<{longs(FIELD_WEIGHTS)}>, bag array<struct<term: string, {longs(FIELD_WEIGHTS)}>>").fields])
    bags = written(texts.mapInArrow(_bags, kind))
    docs = bags.agg(F.count("doc").alias("n"))
    mean = bags.agg(*(F.greatest(F.sum(f"lens.{f}") / F.count("doc"), F.lit(1.0)).alias(f"mean_{f}") for f in FIELD_WEIGHTS))
    each = bags.crossJoin(F.broadcast(mean)).select("doc", "lens", *mean.columns, F.explode("bag").alias("t"))  # mean has one row
    part = lambda f: F.lit(FIELD_WEIGHTS[f]) * F.col(f"t.{f}") / (1 - FIELD_NORM[f] + FIELD_NORM[f] * F.col(f"lens.{f}") / F.col(f"mean_{f}"))
    weight = sum((F.coalesce(part(f), F.lit(0.0)) for f in FIELD_WEIGHTS), F.lit(0.0))
    vocabulary = bags.select(F.explode("bag.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return each.select("t.term", "doc", weight.alias("wtf")), shared(vocabulary), docs


def question_tokens(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(q, position, token) of questions (q, text), one row per distinct token.

    Two adjacent words that the vocabulary knows as one are joined, and their parts follow; a split identifier whose joined
    form is known is kept whole; all else is split. Words that were joined are not joined again with the next one.
    """
    chunks = questions.select("q", F.posexplode(F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda c: c != "")).alias("at", "chunk"))
    chunks = chunks.withColumn("next", F.lead("chunk").over(Window.partitionBy("q").orderBy("at")))
    low, ahead = F.lower("chunk"), F.lower("next")
    pair = F.when(~low.isin(*STOPWORDS) & ~ahead.isin(*STOPWORDS) & (F.length("chunk") + F.length("next") >= 6), F.concat(low, ahead))
    split = F.size(F.split(_split_words(F.col("chunk")), " ")) > 1
    tries = chunks.select("q", "at", F.explode(F.array(F.struct(F.lit("pair").alias("kind"), pair.alias("word")), F.struct(F.lit("whole").alias("kind"), F.when(split, low).alias("word")))).alias("t")).select("q", "at", "t.*").where("word IS NOT NULL")
    known = tries.withColumn("term", stem(F.col("word"))).join(vocabulary.select("term"), "term", "left_semi")
    flags = known.groupBy("q", "at").agg(F.bool_or(F.col("kind") == "pair").alias("pair"), F.bool_or(F.col("kind") == "whole").alias("whole"))
    rows = chunks.join(flags, ["q", "at"], "left").select("q", F.struct("at", "chunk", "next", F.coalesce("pair", F.lit(False)).alias("pair"), F.coalesce("whole", F.lit(False)).alias("whole")).alias("c"))
    each = rows.groupBy("q").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    parts = lambda c: F.split(F.lower(_split_words(c)), " ")

    def step(state: Column, c: Column) -> Column:
        joined = F.concat(F.array(F.concat(F.lower(c["chunk"]), F.lower(c["next"]))), parts(c["chunk"]), parts(c["next"]))
        made = F.when(state["skip"], F.array().cast("array<string>")).when(c["pair"], joined).when(c["whole"], F.array(F.lower(c["chunk"]))).otherwise(parts(c["chunk"]))
        return F.struct((~state["skip"] & c["pair"]).alias("skip"), F.concat(state["out"], made).alias("out"))

    none = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))
    words = each.select("q", F.posexplode(F.aggregate("cs", none, step)["out"]).alias("position", "term"))
    return _stemmed(words).groupBy("q", F.col("term").alias("token")).agg(F.min("position").alias("position"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def expand(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(q, token, term, weight): what each question token searches for.

    An exact hit is the token and its known synonyms. Otherwise terms within one edit (two from seven letters), longer
    terms that begin with the token, and synonyms; the best weight of each term, the first 24 by name. Edits are found
    over deletion neighbourhoods: words within k edits share a string that k deletions make of either, so the join is on
    equality and never all against all.
    """
    q = questions.select("token").distinct()
    exact = q.join(vocabulary, F.col("token") == F.col("term"), "left_semi")
    syn = F.map_from_entries(F.array(*(F.struct(F.lit(stem_word(k)).alias("k"), F.array(*(F.lit(stem_word(x)) for x in v)).alias("v")) for k, v in SYNONYMS.items())))
    bridge = q.select("token", F.explode(F.element_at(syn, F.col("token"))).alias("term")).where("token <> term")
    bridge = bridge.join(vocabulary.select("term"), "term", "left_semi").select("token", "term", F.lit(SYNONYM_WEIGHT).alias("weight"))
    loose = q.join(exact, "token", "left_anti").where("length(token) BETWEEN 3 AND 40").withColumn("limit", F.when(F.length("token") >= 7, 2).otherwise(1))
    vocab = vocabulary.select("term").where("length(term) BETWEEN 2 AND 42")
    # Edits change a length by one each; the lengths in question are 42 at most.
    sizes = loose.select(F.explode(F.sequence(F.length("token") - F.col("limit"), F.length("token") + F.col("limit"))).alias("size")).distinct()
    fit = vocab.join(F.broadcast(sizes), F.length("term") == F.col("size"), "left_semi")
    near = _deletions(loose, "token", F.col("limit")).join(_deletions(fit, "term", F.lit(2)), "gone").select("token", "limit", "term").distinct()
    fuzzy = near.where(F.levenshtein("token", "term") <= F.col("limit")).select("token", "term", F.lit(FUZZY_WEIGHT).alias("weight"))
    heads = vocab.where("length(term) > 4").select("term", F.explode(F.transform(F.sequence(F.lit(4), F.length("term") - 1), lambda k: F.substring(F.col("term"), F.lit(1), k))).alias("head"))
    prefix = loose.where("length(token) >= 4").join(heads, F.col("token") == F.col("head")).where(F.length("term") > F.length("token") + F.col("limit")).select("token", "term", F.lit(PREFIX_WEIGHT).alias("weight"))
    rest = fuzzy.unionAll(prefix).unionAll(bridge.join(loose.select("token"), "token", "left_semi")).groupBy("token", "term").agg(F.max("weight").alias("weight"))
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("token").orderBy("term"))).where(F.col("n") <= MOST_EXPANSIONS).drop("n")
    hit = exact.select("token", F.col("token").alias("term"), F.lit(1.0).alias("weight")).unionAll(bridge.join(exact, "token", "left_semi"))
    return questions.select("q", "token").distinct().join(hit.unionAll(rest), "token")


def _deletions(df: DataFrame, col: str, limit: Column) -> DataFrame:
    """``df`` with ``gone``: each string that at most ``limit`` (two at most) deletions make of the word."""
    w = F.col(col)
    drop = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
    shorter = lambda s: F.transform(F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")), lambda i: drop(s, i))
    once = F.array_distinct(shorter(w))
    twice = F.when(limit >= 2, F.flatten(F.transform(once, shorter))).otherwise(F.array().cast("array<string>"))
    # Distinct within the word: no shuffle is needed for it.
    return df.withColumn("gone", F.explode(F.array_distinct(F.concat(F.array(w), once, twice))))


def bm25f(expansions: DataFrame, postings: DataFrame, vocabulary: DataFrame, size: DataFrame) -> DataFrame:
    """(q, doc, score): the best expansion of each token, summed over tokens, and lowered where few of them match.

    Several terms: score * (0.5 + 0.5 * matched / terms).
    """
    terms = written(expansions.join(vocabulary, "term").crossJoin(size))  # size has one row; written, so that few terms are known to be few
    # Postings of what is asked for are dealt by document; all that questions make of them is added up where they then lie.
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = postings.join(terms.select("term").distinct(), "term", "left_semi").repartition(n, "doc").join(terms, "term")
    value = F.col("weight") * idf(F.col("n"), F.col("df")) * (F.col("wtf") * (K1 + 1)) / (F.col("wtf") + K1)
    best = hits.groupBy("q", "doc", "token").agg(F.max(value).alias("v"))
    sums = best.groupBy("q", "doc").agg(F.sum("v").alias("s"), F.count("*").alias("matched"))
    asked = expansions.groupBy("q").agg(F.count_distinct("token").alias("terms"))
    score = F.when(F.col("terms") > 1, F.col("s") * (0.5 + 0.5 * F.col("matched") / F.col("terms"))).otherwise(F.col("s"))
    return sums.join(asked, "q").select("q", "doc", score.alias("score"))


def graph_lift(scores: DataFrame, edges: DataFrame, seeds: int = 30, most: int = 64, decay: float = 0.9) -> DataFrame:
    """(q, doc, lift): neighbours of the best ``seeds`` get score * decay / sqrt(degree), the greatest over seeds.

    ``edges`` (doc, other), its distinct targets cut to the first ``most`` by id.
    """
    near = edges.select("doc", "other").where("doc <> other").distinct()
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("other"))).where(F.col("n") <= most)
    degree = near.groupBy("doc").agg(F.count("*").alias("degree"))
    top = scores.where("score > 0").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))).where(F.col("n") <= seeds).drop("n")
    reach = top.join(degree, "doc").join(near.select("doc", "other"), "doc")
    return reach.groupBy("q", F.col("other").alias("doc")).agg(F.max(F.col("score") * decay / F.sqrt("degree")).alias("lift"))


def retrieve(questions: DataFrame, fields: DataFrame, containers: DataFrame, edges: DataFrame, sizes: DataFrame, budget: int = 24_000) -> DataFrame:
    """(q, doc, position): sections for each question (q, text): score, lift, diversity per container, byte budget.

    ``containers`` (doc, container), ``sizes`` (doc, bytes).
    """
    from .ranking import pack_to_budget

    postings, vocabulary, size = build_index(fields)
    asked = question_tokens(questions, vocabulary)
    asked = asked.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("position"))).where(F.col("n") <= MOST_TOKENS).select("q", "token")
    base = shared(bm25f(expand(asked, vocabulary), postings, vocabulary, size))
    lift = graph_lift(base, edges)
    both = base.join(lift, ["q", "doc"], "full_outer").select("q", "doc", (F.coalesce("score", F.lit(0.0)) + F.coalesce("lift", F.lit(0.0))).alias("score"))
    within = both.join(containers, "doc").withColumn("k", F.row_number().over(Window.partitionBy("q", "container").orderBy(F.desc("score"), "doc")))
    final = within.select("q", "doc", F.round(F.col("score") * F.pow(F.lit(0.95), F.col("k") - 1), 6).alias("score"))
    # What scores too little can't be taken; the best score of each question tells, before rows are ranked.
    top = final.groupBy("q").agg(F.max("score").alias("top"))
    final = final.join(top, "q").where((F.col("score") > 0) & (F.col("score") >= F.col("top") * MIN_RELATIVE_SCORE)).drop("top")
    ranked = final.join(sizes, "doc").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc")))
    return pack_to_budget(ranked, "q", "place", "bytes", "doc", budget, score="score")


def agent_search(entities: DataFrame, words: list[str]) -> DataFrame:
    """(id, score) of entities whose name, path or text hold all words: 100 for the exact name, 10 a word in it, 5 in the path."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    hay = F.concat_ws(" ", low("name"), low("path"), low("text"))
    score = F.when(low("name") == " ".join(words), 100).otherwise(0)
    ok = F.lit(True)
    for w in words:
        ok = ok & F.contains(hay, F.lit(w))
        score = score + F.when(F.contains(low("name"), F.lit(w)), 10).otherwise(0) + F.when(F.contains(low("path"), F.lit(w)), 5).otherwise(0)
    return entities.where(ok).select("id", score.alias("score"))


def did_you_mean(names: DataFrame, wanted: str, n: int = 5) -> DataFrame:
    """(name, distance): close spellings and names that hold, or are held by, the wanted one."""
    low = F.lower("name")
    d = F.levenshtein(low, F.lit(wanted.lower()))
    ok = (d <= max(2, len(wanted) // 3)) | F.contains(low, F.lit(wanted.lower()))
    if len(wanted) >= 3:
        ok = ok | F.contains(F.lit(wanted.lower()), low)
    return names.select("name").distinct().where(ok).select("name", d.alias("distance")).orderBy("distance", "name").limit(n)
