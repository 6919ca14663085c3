"""Claims against a plain reading of their rules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataloom.operators import claims as C

REF = "struct<entity_id: string, path: string, start_line: int, end_line: int>"


def _sentences(summary, text):
    summary, text = " ".join(summary.split()), " ".join(text.split())
    if len(text) < 12:
        return False
    at = summary.find(text)
    while at >= 0:
        end = at + len(text)
        if (at == 0 or summary[at - 2 : at] in (". ", "! ", "? ")) and (end == len(summary) or text[-1] in ".!?" and summary[end] == " "):
            return True
        at = summary.find(text, at + 1)
    return False


def test_whole_sentences_only(spark):
    rnd = random.Random(8)
    words = ["It", "never", "writes", "rows", "to", "disk.", "Why?", "a.b", r"\E(x)", "Stop!", "end"]
    rows = []
    for _ in range(400):
        summary = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 14)))
        parts = summary.split()
        a = rnd.randrange(len(parts))
        rows.append((summary.replace(" ", rnd.choice([" ", "\n "])), " ".join(parts[a : a + rnd.randrange(1, 8)])))
    got = spark.createDataFrame(rows, "s string, t string").select("s", "t", C.is_sentences(F.col("s"), F.col("t")).alias("ok")).collect()
    assert [r.ok for r in got] == [_sentences(r.s, r.t) for r in got]
    assert 20 < sum(r.ok for r in got) < 380


def test_stored_claims(spark):
    e = [("c1", "src/a.ts", 1, 9)]
    ids = {t: i for t, i in spark.createDataFrame([(o, t, e) for o, t in (("summary", "It keeps rows."), ("keyPoint", "one"), ("keyPoint", "two"), ("summary", "keeps rows. And more"))], f"o string, t string, e array<{REF}>").select(F.concat("o", F.lit(":"), "t"), C.claim_id(F.col("o"), F.col("t"), F.col("e"))).collect()}
    claim = lambda text, origin, index, evidence=e, ident=None: (ident or ids.get(f"{origin}:{text}", "c0"), text, origin, index, evidence)
    rows = [
        ("x", "It keeps rows. And more of them.", ["one", "two"], [claim("It keeps rows.", "summary", 0), claim("one", "keyPoint", 0), claim("two", "keyPoint", 0), claim("keeps rows. And more", "summary", 1), claim("two", "keyPoint", 1, ident="c9"), claim("two", "keyPoint", 1, []), claim("two", "keyPoint", 1, e * 4), claim("two", "other", 1), claim("two", "keyPoint", 1)]),
        ("none", None, None, None),
        ("odd", None, ["one"], [None, claim("It keeps rows.", "summary", 0), (None, "one", "keyPoint", 0, e), claim("one", "keyPoint", -1), claim("one", "keyPoint", 5)]),
    ]
    df = spark.createDataFrame(rows, f"id string, summary string, key_points array<string>, claims array<struct<id: string, text: string, origin: string, index: int, evidence: array<{REF}>>>")
    got = {(r.id, r.position): r.state for r in C.revalidate(df).collect()}
    assert [got["x", i] for i in range(9)] == ["valid", "valid", "key point", "sentence", "id", "evidence", "evidence", "malformed", "too many"]
    assert [got["odd", i] for i in range(5)] == ["malformed", "sentence", "malformed", "key point", "key point"]
    assert len(got) == 14


def _resolve(ref, allowed):
    if ref in allowed:
        return ref
    if ref[0] is None:
        return None
    fold = lambda p: p.replace("_", "-")
    fits = [a for a in allowed if a[0] == ref[0] and ref[2] in (None, a[2]) and ref[3] in (None, a[3]) and (ref[1] is None or a[1] is not None and fold(a[1]) == fold(ref[1]))]
    if len(fits) == 1:
        return fits[0]
    for kept in ([a for a in fits if a[2:] == ref[2:]], [a for a in fits if a[1] == ref[1]]):
        if len(kept) == 1:
            return kept[0]
    return None


def test_evidence_and_mapping(spark):
    rnd = random.Random(2)
    ref = lambda: (rnd.choice(["e1", "e2", None]), rnd.choice(["a_b.ts", "a-b.ts", "c.ts", None]), rnd.choice([1, 5, None]), rnd.choice([9, None]))
    allowed = {f"x{k}": sorted({ref() for _ in range(6)}, key=str) for k in range(40)}
    cited = {k: [ref() for _ in range(6)] for k in allowed}
    flat = lambda d: [(k, *r) for k, refs in d.items() for r in refs]
    a = spark.createDataFrame(flat(allowed), "id string, entity_id string, path string, start_line int, end_line int")
    c = spark.createDataFrame([(k, n, *r) for k, refs in cited.items() for n, r in enumerate(refs)], "id string, n int, entity_id string, path string, start_line int, end_line int")
    got = {(r.id, r.n): r.found and tuple(r.found) for r in C.resolve_evidence(c, a).collect()}
    want = {(k, n): _resolve(r, allowed[k]) for k, refs in cited.items() for n, r in enumerate(refs)}
    assert got == want and len({v is None for v in want.values()}) == 2
    summary = "It keeps all rows. It never drops one! Done"
    rows = []
    for k in allowed:
        rows += [(k, "summary", i, t, summary, [rnd.randrange(7) for _ in range(rnd.randrange(5))]) for i, t in enumerate(rnd.choices(["It keeps all rows.", "It never  drops one!", "never drops one!", "Done"], k=4))]
        rows += [(k, "keyPoint", i, f"point {i % 4}", None, [rnd.randrange(6)] * rnd.randrange(1, 3)) for i in range(8)]
    made = C.map_claims(c, a, spark.createDataFrame(rows, "id string, origin string, index int, text string, summary string, refs array<int>")).collect()
    assert len(made) == len(rows)
    by = {(r.id, r.origin, r["index"]): r for r in made}
    states = set()
    for k in allowed:
        seen = []
        for _, origin, i, text, _, refs in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] != "summary", r[2])):
            found = [want.get((k, n)) for n in refs]
            r = by[k, origin, i]
            state = "sentence" if origin == "summary" and not _sentences(summary, text) else "no evidence" if not refs else "too much evidence" if len(refs) > 3 else "evidence" if None in found else None
            if state is None:
                key = origin, " ".join(text.split()), tuple(dict.fromkeys(found))
                state = "repeated" if key in seen else None
                seen += [key] * (state is None)
                state = state or ("too many" if len(seen) > 8 else "valid")
            assert r.state == state
            states.add(state)
    assert states >= {"valid", "sentence", "no evidence", "too much evidence", "evidence", "repeated"}
