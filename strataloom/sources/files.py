"""Readers of repository files (path, text): manifests, lock files, owners, coverage, imports and diagrams.

Formats that SQL can take apart are read with column expressions; those that need a parser are read file by file in Arrow
batches, so a file is never split and a task holds one batch.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def read_tree(spark, path: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """(path, size, text) of the files below a folder; larger ones than ``most_bytes`` are left out before they are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    if most_bytes is not None:
        df = df.where(F.col("length") <= most_bytes)
    return df.select("path", F.col("length").alias("size"), F.col("content").cast("string").alias("text"))


def _attempt(parse: Callable[[str], list[tuple]], text: str | None) -> tuple[list[tuple], str | None]:
    try:
        return parse(text or ""), None
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return [], f"{type(e).__name__}: {e}"


def parse_files(files: DataFrame, parse: Callable[[str], list[tuple]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """(path, fields) for each tuple that ``parse`` makes of a file's text; a file that it can't read gives no rows here and
    one row of :func:`unreadable`."""
    schema = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(n, k) for n, k in fields)])
    kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, rows = [], []
            for p, t in zip(*(c.to_pylist() for c in b.columns)):
                got, _ = _attempt(parse, t)
                rows += got
                paths += [p] * len(got)
            cols = list(zip(*rows)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields))], names=[n for n in schema.fieldNames()])

    return files.select("path", "text").mapInArrow(run, schema)


def unreadable(files: DataFrame, kind: str) -> DataFrame:
    """(path, error) of the files that the reader of a kind can't read, so that a lost one is seen."""
    parse = PARSERS[kind][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = [(p, e) for p, t in zip(*(c.to_pylist() for c in b.columns)) if (e := _attempt(parse, t)[1])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in errors], pa.string()) for i in range(2)], names=["path", "error"])

    return files.select("path", "text").mapInArrow(run, "path string, error string")


def package_json(files: DataFrame) -> DataFrame:
    """(path, section, name, spec) of all dependency sections."""
    kind = "struct<" + ",".join(f"{s}:map<string,string>" for s in SECTIONS) + ">"
    own = files.select("path", F.from_json("text", kind).alias("j"))

    def entries(section: str):
        named = lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("spec"))
        return F.transform(F.coalesce(F.map_entries(F.col(f"j.{section}")), F.array()), named)

    each = F.flatten(F.array(*map(entries, SECTIONS)))
    return own.select("path", F.explode(each).alias("d")).select("path", "d.*")


def package_lock(files: DataFrame) -> DataFrame:
    """(path, name, version) of the installed packages of a lock file."""
    own = files.select("path", F.from_json("text", "struct<packages:map<string,struct<version:string>>>").alias("j"))
    rows = own.select("path", F.explode("j.packages").alias("at", "p")).where("at LIKE '%node_modules/%'")
    return rows.select("path", F.regexp_replace("at", "^.*node_modules/", "").alias("name"), F.col("p.version").alias("version"))


def parse_pnpm(text: str) -> list[tuple]:
    """(importer, section, name, version) of a pnpm lock file's importers: nesting by indentation."""
    out, importer, section, name, inside = [], None, None, None, False
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = (len(line) - len(line.lstrip())) // 2
        key, _, value = line.strip().partition(":")
        key, value = key.strip("'\""), value.strip().strip("'\"")
        if depth == 0:
            inside = key == "importers"
        elif not inside:
            continue
        elif depth == 1:
            importer = key
        elif depth == 2:
            section = key
        elif depth == 3:
            name = key
            if value:
                out.append((importer, section, name, value))
        elif depth == 4 and key == "version":
            out.append((importer, section, name, value))
    return [r for r in out if r[1] in SECTIONS]


def parse_yarn(text: str) -> list[tuple]:
    """(name, spec, version) of a yarn lock file, a row for each specifier of an entry."""
    out, heads = [], []
    for line in text.splitlines():
        if line and not line[0].isspace() and line.endswith(":") and not line.startswith("#"):
            heads = [h.strip().strip('"') for h in line[:-1].split(",")]
        elif m := re.match(r'\s+version:?\s+"?([^"\s]+)"?', line):
            for h in heads:
                name, _, spec = h[1:].partition("@") if h.startswith("@") else h.partition("@")
                out.append((("@" if h.startswith("@") else "") + name, spec, m[1]))
            heads = []
    return out


def parse_cargo_toml(text: str) -> list[tuple]:
    """(section, name, package, requirement, optional) of a Cargo manifest, target sections included."""
    doc = tomllib.loads(text)
    tables = [(s, doc.get(s, {})) for s in ("dependencies", "dev-dependencies", "build-dependencies")]
    tables += [(s, t.get(s, {})) for t in doc.get("target", {}).values() for s in ("dependencies", "dev-dependencies", "build-dependencies")]
    tables.append(("workspace.dependencies", doc.get("workspace", {}).get("dependencies", {})))
    out = []
    for section, table in tables:
        for name, spec in table.items():
            spec = {"version": spec} if isinstance(spec, str) else spec
            out.append((section, name, spec.get("package", name), spec.get("version"), bool(spec.get("optional", False))))
    return out


def parse_cargo_lock(text: str) -> list[tuple]:
    """(name, version, source) of the locked packages."""
    return [(p["name"], p["version"], p.get("source")) for p in tomllib.loads(text).get("package", [])]


S, B = T.StringType(), T.BooleanType()
PARSERS = {
    "pnpm": (parse_pnpm, [("importer", S), ("section", S), ("name", S), ("version", S)]),
    "yarn": (parse_yarn, [("name", S), ("spec", S), ("version", S)]),
    "cargo_toml": (parse_cargo_toml, [("section", S), ("name", S), ("package", S), ("requirement", S), ("optional", B)]),
    "cargo_lock": (parse_cargo_lock, [("name", S), ("version", S), ("source", S)]),
}


def parsed(files: DataFrame, kind: str) -> DataFrame:
    return parse_files(files, *PARSERS[kind])


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, body): lines counted from 1."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "body")).select("path", (F.col("n") + 1).alias("line"), "body")


def cargo_path_dependencies(files: DataFrame) -> DataFrame:
    """(path, line, name, target) of dependencies by path, one to a line."""
    hit = r'^\s*([A-Za-z0-9_-]+)\s*=\s*\{[^}]*\bpath\s*=\s*"([^"]+)"'
    rows = lines_of(files).withColumns({"name": F.regexp_extract("body", hit, 1), "target": F.regexp_extract("body", hit, 2)})
    return rows.where("name <> ''").select("path", "line", "name", "target")


#: Where an owners file may lie, the first wins.
OWNER_FILES = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")


def owner_rules(files: DataFrame) -> DataFrame:
    """(rule_no, pattern, owners) of the first owners file that exists.

    Comments, a byte order mark and negated lines (``!``) say nothing; blanks after a backslash belong to the pattern.
    Owners come once each and sorted; a rule without any clears what earlier ones gave.
    """
    rank = F.array_position(F.array(*map(F.lit, OWNER_FILES)), F.col("path"))
    first = files.where(rank > 0).select("path", "text", rank.alias("r")).orderBy("r").limit(1)
    body = F.trim(F.regexp_replace(F.regexp_replace("body", "^\ufeff|\r$", ""), r"(^|\s)#.*$", ""))
    rows = lines_of(first).withColumn("body", body).where((F.col("body") != "") & ~F.startswith("body", F.lit("!")))
    parts = F.split("body", r"(?<!\\)\s+")
    owners = F.sort_array(F.array_distinct(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda o: o != "")))
    return rows.select(F.col("line").alias("rule_no"), F.replace(F.get(parts, F.lit(0)), F.lit("\\ "), F.lit(" ")).alias("pattern"), owners.alias("owners"))


def coverage_records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits (path, line, hits), stored (path, stored_found, stored_hit)) of coverage files; SF opens a record."""
    # A file is cut into its records where it lies, so no line is sorted to find the record that it belongs to.
    records = files.select(F.posexplode(F.split("text", r"(?<![^\n])SF:", -1)).alias("n", "record"))
    lines = F.split("record", "\r?\n", -1)
    opened = F.concat(F.array(F.lit("SF:")), F.slice(lines, F.lit(2), F.size(lines)))
    rows = records.select(F.when(F.col("n") > 0, F.get(lines, F.lit(0))).alias("path"), F.explode(F.when(F.col("n") > 0, opened).otherwise(lines)).alias("body"))
    number = lambda tag, part=0: F.get(F.split(F.regexp_replace("body", f"^{tag}:", ""), ","), F.lit(part)).cast("long")
    hits = rows.where(F.startswith("body", F.lit("DA:"))).select("path", number("DA").cast("int").alias("line"), number("DA", 1).alias("hits"))
    pick = lambda tag: F.max(F.when(F.startswith("body", F.lit(f"{tag}:")), number(tag)))
    stored = rows.where("path IS NOT NULL").groupBy("path").agg(pick("LF").alias("stored_found"), pick("LH").alias("stored_hit"))
    return hits.where("line IS NOT NULL AND hits IS NOT NULL"), stored


_EDGE = re.compile(r"^\s*([\w-]+)(?:\s*[\[({]+\"?([^\])}\"]*)\"?[\])}]+)?\s*(-->|---|-\.->|==>)\s*(?:\|([^|]*)\|)?\s*([\w-]+)(?:\s*[\[({]+\"?([^\])}\"]*)\"?[\])}]+)?\s*;?\s*$")
_NODE = re.compile(r"^\s*([\w-]+)\s*[\[({]+\"?([^\])}\"]*)\"?[\])}]+\s*;?\s*$")


def parse_mermaid(text: str, most: int = 250, most_chars: int = 40_000) -> list[tuple]:
    """(fact, id, label, from, to) of a flow chart; ValueError beyond the limits."""
    if len(text) > most_chars:
        raise ValueError("diagram too long")
    nodes: dict[str, str] = {}
    edges = []
    for line in text.splitlines():
        if m := _EDGE.match(line):
            a, la, _, label, b, lb = m.groups()
            for n, text_ in ((a, la), (b, lb)):
                nodes[n] = text_ or nodes.get(n, n)
            edges.append((a, b, label or ""))
        elif (m := _NODE.match(line)) and m[1] not in ("subgraph", "graph", "flowchart"):
            nodes[m[1]] = m[2] or m[1]
    if len(nodes) > most or len(edges) > most:
        raise ValueError("diagram too large")
    return [("node", n, t, None, None) for n, t in nodes.items()] + [("edge", f"{a}>{b}", t, a, b) for a, b, t in edges]


def mermaid(files: DataFrame) -> DataFrame:
    return parse_files(files, parse_mermaid, [("fact", S), ("id", S), ("label", S), ("from_id", S), ("to_id", S)])
