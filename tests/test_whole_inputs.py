"""Queries take whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from strataloom import adapters as A
from strataloom.plans.registry import Tables
from strataloom.sources import bundles

SF = "/root/testdata/sf0.001"


def test_retrieval_finds_words_late_in_a_text(spark, tmp_path):
    texts = ["filler words " * 60 + "zyxgraph", *("other plain text " * 40 for _ in range(5))]
    rows = [(i, t, "en", f"src{i}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zyxgraph")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = entry.queries()["t17_retrieval"](spark, str(tmp_path)).collect()
    assert "d0" in {s.id for r in got for s in r.symbols}


def test_portable_read_reads_all_entities(spark, monkeypatch, rows):
    read, seen = bundles.read_portable, []

    def spy(files):
        seen.append((read(files)[0], files.count()))
        return read(files)

    monkeypatch.setattr(bundles, "read_portable", spy)
    got = entry.queries()["s7_portable_read"](spark, "/root/testdata/sf0.01")
    e = A.entities(Tables(spark, "/root/testdata/sf0.01"))
    assert rows(got) == rows(e.where("rank <= 2").groupBy("kind").agg(F.count("*")))
    assert rows(seen[0][0].select("id")) == rows(e.select("id")) and seen[0][1] == 1 + e.count() // 2000


def test_bundle_holds_all_relations(spark, monkeypatch, rows):
    read, seen = bundles.read_bundle, []
    monkeypatch.setattr(bundles, "read_bundle", lambda *a: seen.append(read(*a)) or seen[0])
    entry.queries()["s8_bundle_round_trip"](spark, SF)
    assert rows(seen[0][1].select("id", "from_id", "to_id", "kind")) == rows(A.relations(Tables(spark, SF)).select("id", "from_id", "to_id", "kind"))
