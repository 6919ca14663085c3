"""Discovery: which of a repository's files are sources, and which unit each belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Endings of sources, what is left out of every scan, and units that are scaffolding.
SOURCES = (".ts", ".tsx", ".mts", ".cts", ".mjs", ".cjs", ".jsx", ".rs")
TYPED = r"\.(ts|tsx|mts|cts)$"
LEFT_OUT = r"\.d\.ts$|(^|/)(dist|__tests__|__mocks__)/|\.(test|spec|bench)\.[cm]?[jt]sx?$|_qa\.rs$|(^|/)(tests|benches|examples)/(.*/)?[^/]*\.rs$"
SCAFFOLDING = r"(?i)(^|/)(playground|playgrounds|examples?|example-.*|e2e|fixtures?|__fixtures__|demos?|sandbox)(/|$)"
TOOLING = "tooling"


def workspace_globs(text: Column) -> Column:
    """Globs of the ``packages`` list of a workspace file: its items up to the next key."""
    plain = F.regexp_replace(text, r"(?m)#.*$", "")
    block = F.regexp_extract(plain, r"(?ms)^packages:\s*$\n(.*?)(?=^[^\s-]|\z)", 1)
    return F.regexp_extract_all(block, F.lit(r"(?m)^\s*-\s*['\"]?([^'\"\s]+)['\"]?\s*$"), F.lit(1))


def _glob_pattern(glob: Column) -> Column:
    """A glob over folders as a regular expression: a star within a segment, two for one segment or more."""
    parts = F.transform(F.split(glob, "/"), lambda s: F.when(s == "**", "[^/]+(?:/[^/]+)*").otherwise(F.regexp_replace(F.regexp_replace(s, r"([.+^${}()|\[\]\\?])", r"\\$1"), r"\*", "[^/]*")))
    return F.concat(F.lit("^"), F.array_join(parts, "/"), F.lit("$"))


def _folders(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def discover(files: DataFrame, all_members: bool = False) -> DataFrame:
    """(repo, path, unit, kind, reason) of all files (repo, path, text); ``text`` is read of manifests only.

    Sources get a unit: the crate that holds them, else the most specific workspace member, else the tooling of a workspace or
    the one package of a repository without members (its name as a slug). Others get a reason: ending, testdata, excluded,
    or scaffolding (members that are fixtures or examples, kept with ``all_members``). Plain scripts (.js) count only in
    repositories without a root tsconfig and without typed sources.

    Roots are found by joining each file's folders with the roots: no file meets all roots.
    """
    p = F.col("path")
    ending = F.lower(p) == "x"
    for e in SOURCES:
        ending = ending | F.endswith(p, F.lit(e))
    own = files.select("repo", "path", "text").withColumns({"plain": ending, "script": F.endswith(p, F.lit(".js")), "test": X.test_data_path(p), "out": p.rlike(LEFT_OUT)}).hint("merge")  # a table of files can be larger than the planner takes it for: no broadcast
    repos = own.groupBy("repo").agg(
        (~F.bool_or(p.isin("tsconfig.json", "tsconfig.base.json")) & ~F.bool_or(p.rlike(TYPED) & ~F.col("test") & ~F.col("out"))).alias("scripts"),
        F.max(F.when(p == "pnpm-workspace.yaml", F.col("text"))).alias("workspace"),
        F.max(F.when(p == "package.json", F.get_json_object("text", "$.name"))).alias("name"),
    )
    name = F.trim(F.coalesce("name", F.lit("")))
    globs = repos.select("repo", F.explode(workspace_globs(F.col("workspace"))).alias("glob")).select("repo", _glob_pattern(F.col("glob")).alias("pattern"))
    folders = own.where(F.endswith(p, F.lit("/package.json"))).select("repo", F.regexp_replace("path", "/package.json$", "").alias("folder"))
    # A repository has few globs, and they part the manifests of that repository only.
    members = folders.join(globs, "repo").where(F.rlike("folder", F.col("pattern"))).select("repo", "folder").distinct()
    crates = own.where(p.rlike(r"^crates/[^/]+/Cargo\.toml$")).select("repo", F.regexp_replace("path", "/Cargo.toml$", "").alias("folder")).distinct()
    roots = members.withColumn("root", F.lit("member")).unionByName(crates.withColumn("root", F.lit("rust")))
    has_members = members.select("repo").distinct().withColumn("workspace_of", F.lit(True))
    sources = own.join(repos.select("repo", "scripts", F.when(name != "", name).otherwise(F.col("repo")).alias("name")), "repo").withColumn("counts", F.col("plain") | F.col("script") & F.col("scripts"))
    above = sources.where("counts AND NOT test AND NOT out").select("repo", "path", F.explode(_folders(p)).alias("folder")).hint("merge").join(roots, ["repo", "folder"])
    deepest = lambda kind: F.max_by("folder", F.when(F.col("root") == kind, F.length("folder")))
    found = above.groupBy("repo", "path").agg(deepest("member").alias("member"), deepest("rust").alias("crate"))
    both = sources.drop("text").join(found, ["repo", "path"], "left").join(has_members, "repo", "left")
    scaffold = F.lit(not all_members) & F.col("member").rlike(SCAFFOLDING)
    reason = (
        F.when(~F.col("counts"), "ending").when(F.col("test"), "testdata").when(F.col("out"), "excluded")
        .when(F.col("crate").isNull() & F.coalesce(scaffold, F.lit(False)), "scaffolding")
    )
    whole = F.col("workspace_of").isNull()
    kind = F.when(F.col("crate").isNotNull(), "rust").when(whole, "root").when(F.col("member").isNotNull(), "member").otherwise("tooling")
    unit = F.coalesce("crate", F.when(whole, X.slug(F.col("name"))), "member", F.lit(TOOLING))
    return both.select("repo", "path", F.when(reason.isNull(), unit).alias("unit"), F.when(reason.isNull(), kind).alias("kind"), reason.alias("reason"))
