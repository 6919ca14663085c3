"""Token counts, licence scans, BPE streams, token stores, packing and fingerprints against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import bpe_stream, license_scan, order_minhash, packing, token_count, token_store
from strataloom.llm.common import blocks, scratch_dir, vocab_path
from strataloom.llm.vocab import LibraryEncoder, load_vocab

WORD, BYTE = vocab_path("word_bpe_49k.json"), vocab_path("byte_bpe_50k.json")
EDGE = ["", " ", "\n\n", "a" * 2500, "ab" * 900, "hello<|endoftext|>World ΑΣ x", "it's  'S ²½ Ⅷ \x1c\x85 İ ͸ ﬁ", "<|startoftext|><|endoftext|>", "Ᲊx", "é ͅ", "日本語のテキスト", "á b", "MIT License", "Apache licens"]
SCHEMA = "doc_id long, text string, n_tokens string, lang string"
text = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinst' <|>\n")), max_size=80)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in both columns, empty and long texts, repeated rows, and a column that clashes with a result."""
    rows = [(i, t, "x", "en") for i, t in enumerate(EDGE)] + [(100, None, None, None), (None, "no id", "y", "de"), (5, EDGE[5], "x", "en"), (200, "mit license " * 3000, "x", "en")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def lib_ids(path, t):
    return load_vocab(path).library.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(text, st.sampled_from([WORD, BYTE]))
def test_all_encoders_equal_the_library(t, path):
    ids = lib_ids(path, t)
    assert token_count.TokenCounter(path).count([t]) == [len(ids)]
    assert LibraryEncoder(path).encode(t).tolist() == ids
    got = [i for part in bpe_stream._codec(path)[0].stream(t) for i in part]
    assert got == ids
    assert "".join(bpe_stream._codec(path)[1].stream([got[i : i + 2] for i in range(0, len(got), 2)])) == load_vocab(path).library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_words_stream_within_the_lookahead(path):
    rnd = random.Random(1)
    encoder = bpe_stream.StreamEncoder(load_vocab(path), block=1)
    assert encoder.block >= max(encoder.width.values()) and 0 < encoder.lookahead < 1000
    for letters in ("etaoinshrdluing", "an", "xyz"):
        for _ in range(15):
            t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(500, 4000)))
            assert [i for part in encoder.stream(t) for i in part] == lib_ids(path, t)


def test_blocks_join_to_the_text_and_keep_tokens():
    t = "ab cd  ef\n" * 400 + "x" * 500 + " end"
    for size in (1, 7, 100, 10_000):
        assert "".join(blocks(t, size)) == t
        assert sum(len(lib_ids(BYTE, b)) for b in blocks(t, size)) == len(lib_ids(BYTE, t))


def test_token_counts(docs, rows, spark):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs).collect()}
    want = {(r.doc_id, len((r.text or "").encode()), len(lib_ids(WORD, r.text)), len(lib_ids(WORD, r.text)) > 2048) for r in docs.collect()}
    assert got == want and token_count.token_counts(docs).count() == docs.count()
    assert token_count.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sentencepiece_counts(docs):
    import sentencepiece

    path = vocab_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_count.token_counts(docs, path).collect())
    assert got == sorted((r.doc_id or -1, len(lib.encode(r.text or ""))) for r in docs.collect())


def test_bpe_round_trip(docs, spark):
    lib = load_vocab(WORD).library
    for r in bpe_stream.bpe_round_trip(docs.where("doc_id IS NOT NULL")).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = lib_ids(WORD, r.text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe_stream.bpe_encode(docs, BYTE)
    back = {(r.doc_id, r.text) for r in bpe_stream.bpe_decode(coded, BYTE).collect()}
    assert back == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert bpe_stream.bpe_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def _base_places(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    base = [(n.label, n.phrase.split()) for n in license_scan.NOTICES if n.base]
    return len(words), sorted((i, lab) for lab, p in base for i in range(len(words)) if words[i : i + len(p)] == p)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from("mit license Apache LICENSE general public limit é mitlicense licens x - , licenses".split()), max_size=40))
def test_exact_notices_are_complete(words):
    t = " ".join(words)
    n, places = license_scan.NoticeSearch().search(t)
    assert (n, sorted((p[1], license_scan.NOTICES[p[0]].label) for p in places if not p[4] and license_scan.NOTICES[p[0]].base)) == _base_places(t)


def test_altered_notices(docs):
    rnd = random.Random(2)
    search = license_scan.NoticeSearch()
    for k, notice in enumerate(license_scan.NOTICES):
        for edits in range(1, notice.edits + 1):
            for _ in range(20):
                t = list(notice.phrase)
                fixed = {i for w in notice.fixed_words for m in re.finditer(rf"\b{w}\b", notice.phrase) for i in range(*m.span())}
                at = [i for i, c in enumerate(t) if c != " " and i not in fixed]
                for i in rnd.sample(at[1:-1], edits):
                    t[i] = "q"
                found = [p for p in search.search("start " + "".join(t) + " end")[1] if p[0] == k]
                assert found and 0 < found[0][4] <= edits, (notice, edits)
    assert [n.phrase for n in license_scan.NOTICES if n.fixed_words] == ["mit license", "all rights reserved"]
    assert [p[4] for p in search.search("permission iq hereby granted free of charge to any person")[1]] == [1]
    assert not search.search("the exit license and the edit license")[1]
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (got[200].n_base, got[200].first_word, got[200].last_word, got[200].labels) == (3000, 0, 5998, "mit")
    assert got[100].n_words == 0 and got[100].labels == "" and got[100].score == 0.0 and got[100].first_word is None
    assert got[13].labels == "apache" and got[13].base_labels == "" and got[13].spans[0].edits == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=400))
def test_perfect_hash_is_minimal(keys):
    k = np.array(keys, np.int64).view(np.uint64)
    table = token_store.PerfectHash.build(k)
    assert sorted(table.slots(k).tolist()) == list(range(len(keys)))


def test_token_store(docs, spark):
    path = scratch_dir(spark, "store")
    manifest = token_store.write_token_store(docs, path, shard_docs=4)
    assert manifest.count() > 1
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, list(r.ids)) for r in token_store.read_token_store(spark, path, manifest).collect()), key=lambda r: r[2])
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = lib_ids(WORD, r.text) + [1]
        want.append((r.doc_id is not None, r.doc_id or 0, at, len(ids), ids))
        at += len(ids)
    assert got == want
    keys = spark.createDataFrame([(5,), (200,), (999,), (-4,), (None,)], "doc_id long")
    hits = token_store.lookup_tokens(spark, path, manifest, keys).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in hits) == sorted([(5, len(lib_ids(WORD, EDGE[5])) + 1)] * 2 + [(200, len(lib_ids(WORD, "mit license " * 3000)) + 1)])
    empty = spark.createDataFrame([], SCHEMA)
    assert token_store.token_store_digest(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_packing_keeps_every_piece(sizes):
    bins = packing.pack_sizes(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 64 for b in bins)


def _fewest(sizes, capacity):
    """The least number of bins, by trying all subsets."""
    n = len(sizes)
    best = {0: (1, 0)}  # subset -> (bins, fill of the last one), the least
    for mask in range(1, 1 << n):
        found = None
        for i in range(n):
            if mask >> i & 1:
                bins, fill = best[mask ^ (1 << i)]
                to = (bins, fill + sizes[i]) if fill + sizes[i] <= capacity else (bins + 1, sizes[i])
                found = to if found is None else min(found, to)
        best[mask] = found
    return best[(1 << n) - 1][0]


def test_swap_search_empties_bins():
    """Swaps reach the optimum where best fit alone doesn't, and no step makes a bin overflow."""
    rnd = random.Random(4)
    saved = optimal = needed = 0
    for _ in range(250):
        sizes = [rnd.randrange(15, 60) for _ in range(11)]
        b = packing._Bins(sizes, 100)
        plain, fewest = len(b.held), _fewest(sizes, 100)
        before = sum(f * f for f in b.fill)
        b.search()
        bins = [b.items(k) for k in range(len(b.held)) if b.held[k]]
        assert sorted(i for own in bins for i in own) == list(range(11)) and all(sum(sizes[i] for i in own) <= 100 for own in bins)
        assert sum(f * f for f in b.fill) >= before and fewest <= len(bins) <= plain
        needed += plain > fewest
        saved += plain - len(bins)
        optimal += plain > fewest and len(bins) == fewest
    assert needed >= 5 and saved >= optimal >= needed / 2
    many = [rnd.randrange(500, 900) for _ in range(3000)]
    b = packing._Bins(many, 2048)
    plain = len(b.held)
    b.search()
    assert sum(map(bool, b.held)) < 0.96 * plain  # three to a bin by swaps


def test_levels_pack_what_groups_leave(spark):
    """Groups of 64 pieces lose a bin each; packed again level by level, all but a few are won back. Ids stay exact."""
    rnd = random.Random(6)
    big = 2**60
    rows = [(None if i % 50 == 0 else big + i, "a " * rnd.randrange(1, 60), "own", 7) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string, pack_group int").repartition(4)
    got = packing.pack_documents(df, capacity=128, group_pieces=64).collect()
    one = packing.pack_documents(df, capacity=128, group_pieces=10_000).collect()
    least = -(-sum(r.length for r in got) // 128)
    assert {r.doc_id for r in got} == {r[0] for r in rows} and sorted((r.doc_id or 0, r.piece) for r in got) == sorted((r.doc_id or 0, r.piece) for r in one)
    fills: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fills.get(r.sequence_id, 0) == r.offset
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 128 and len(fills) <= least + 2 and len({r.sequence_id for r in one}) <= least + 2


def test_pack_documents(docs, spark):
    got = packing.pack_documents(docs, group_pieces=8).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_seq: dict = {}
    for r in got:
        ids = lib_ids(BYTE, texts[r.doc_id]) + [0]
        own = ids[r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in got) == sum(len(lib_ids(BYTE, r.text)) + 1 for r in docs.collect())
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_minhash(docs, spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(400)]
    swapped = base[200:] + base[:200]
    rows = [(9, " ".join(base)), (8, " ".join(swapped)), (7, " ".join(base)), (6, "one"), (5, ""), (4, None), (3, "one"), (3, "one"), (None, "x y z")]
    got = {(r.doc_id, r.n_chars): r for r in order_minhash.order_minhash(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    n = len(rows[0][1])
    assert got[9, n].fingerprint == got[7, n].fingerprint != got[8, n].fingerprint
    assert 0.2 < got[9, n].near_next < 1.0 and got[5, 0].near_next == 1.0 and got[4, 0].n_chars == 0
    assert got[6, 3].fingerprint == got[3, 3].fingerprint
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    for (i, t), (_, nx) in zip(order, order[1:]):
        if i == 3:  # its two rows follow each other in any order
            continue
        t, nx = t or "", nx or ""
        c = len(t) // 3
        assert got[i, len(t)].edited_sha256 == hashlib.sha256((t[: len(t) - c] + nx[:c]).encode()).hexdigest()
    assert order_minhash.order_minhash(docs).count() == docs.count()
    assert order_minhash.order_minhash(spark.createDataFrame([], SCHEMA)).count() == 0


def test_next_document_across_buckets(spark):
    df = spark.range(0, 5000, 7).selectExpr("id AS k", "concat('t', id) AS body", "0L AS __tie").repartition(6)
    got = {r.k: r.nxt for r in order_minhash.with_next(df, "k", {"body": "nxt"}, rows_per_bucket=50).collect()}
    ids = list(range(0, 5000, 7))
    assert got == {k: f"t{ids[i - 1]}" for i, k in enumerate(ids)}


def test_next_of_null_and_crowded_ids(spark):
    """Null ids and an id that hundreds of rows share are dealt over buckets; all rows still form one ring."""
    rows = [(None, f"n{i}") for i in range(700)] + [(50, f"h{i // 2}") for i in range(900)] + [(i, f"t{i}") for i in range(100) if i != 50]
    df = spark.createDataFrame([(k, b, i) for i, (k, b) in enumerate(rows)], "k long, body string, i int").selectExpr("*", "xxhash64(body) AS __tie").repartition(6)
    got = order_minhash.with_next(df, "k", {"i": "nxt", "k": "next_k"}, rows_per_bucket=20).collect()
    to = {r.i: r.nxt for r in got}
    assert len(got) == len(rows) == len(to) and set(to.values()) == set(to)
    seen, at = [], next(r.i for r in got if r.k == 99)
    for _ in rows:
        seen.append(rows[at][0])
        at = to[at]
    assert seen == sorted((k for k, _ in rows if k is not None), reverse=True) + [None] * 700


def _u64(x):
    return x & (2**64 - 1)


def _xx(parts, seed=42):
    """xxhash64 of longs, ints (given as 4 bytes) and strings, chained as Spark does."""
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed=_u64(seed))
    return seed


def _murmur_longs(values, seed=42):
    rotl = lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    h = seed
    for v in values:
        for half in (v & 0xFFFFFFFF, v >> 32 & 0xFFFFFFFF):
            k = rotl(half * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h = (rotl(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
    return h


def _plain_signature(t, k=3, parts=32, keep=2):
    """Order MinHash by loops: number k-mers, walk each rotated order, restore text order, hash the tuple."""
    long = lambda x: struct.pack("<Q", _u64(x))
    words = [_xx([w.encode()]) for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if w]
    n = len(words)
    if not n:
        return [0] * parts
    mask = 2**36 - 1
    kmers = [_xx([long(words[i + j] if i + j < n else j) for j in range(k)]) & mask for i in range(max(n - k + 1, min(n, 1)))]
    times: dict = {}
    numbered = []
    for pos, h in enumerate(kmers):
        o = times[h] = times.get(h, -1) + 1
        numbered.append((_xx([long(h), struct.pack("<i", o)]) & mask, pos))
    out = []
    for p in range(parts):
        point = (2**63 // parts * p) >> 27
        order = sorted(numbered, key=lambda x: (x[0] < point, x))
        chosen = [order[j % len(order)] for j in range(keep)]
        out.append(_murmur_longs([h for h, _ in sorted(chosen, key=lambda x: (x[1], x[0]))]))
    return out


def test_signatures_equal_a_plain_order_minhash(spark):
    rnd = random.Random(3)
    texts = ["", "one", "one two", "a b a b a b a b a", "x " * 50, "Tab\tand\nline  END"] + [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 200))) for _ in range(30)] + [" ".join(f"w{rnd.randrange(400)}" for _ in range(3000))]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, sig int").repartition(4)
    for r in order_minhash.order_minhash(df).collect():
        assert r.fingerprint == "".join(f"{x:08x}" for x in _plain_signature(texts[r.doc_id]))
        nx = texts[r.doc_id - 1] if r.doc_id else texts[-1]
        c = len(texts[r.doc_id]) // 3
        edited = texts[r.doc_id][: r.n_chars - c] + nx[:c]
        own, other, far = (_plain_signature(x) for x in (texts[r.doc_id], edited, nx))
        assert r.edited_fingerprint == "".join(f"{x:08x}" for x in other)
        assert r.near_edited == sum(x == y for x, y in zip(own, other)) / 32 and r.near_next == sum(x == y for x, y in zip(own, far)) / 32


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_labels_equal_all_windows():
    """Every window of words against every notice by edit distance; words under five letters must stand unchanged."""
    rnd = random.Random(10)
    search = license_scan.NoticeSearch()
    letters = "abcdefgilmnoprstuy"

    def alter(phrase):
        t = list(phrase)
        for _ in range(rnd.randrange(0, 5)):
            i = rnd.randrange(len(t))
            t[i : i + 1] = rnd.choice([[], [t[i], rnd.choice(letters)], [rnd.choice(letters)]])
        return "".join(t)

    for _ in range(150):
        t = " ".join(alter(rnd.choice(license_scan.NOTICES).phrase) if rnd.random() < 0.5 else rnd.choice(["submit it license terms", "a bit license", "lit license", "the public general", "mit licence"]) for _ in range(3))
        words = t.split()
        want = set()
        for n in license_scan.NOTICES:
            size = len(n.phrase.split())
            for i in range(len(words)):
                for j in range(i + max(1, size - n.edits), min(len(words), i + size + n.edits) + 1):
                    span = words[i:j]
                    rest = iter(span)
                    if abs(len(" ".join(span)) - len(n.phrase)) <= n.edits and all(w in rest for w in n.fixed_words) and _distance(" ".join(span), n.phrase) <= n.edits:
                        want.add(n.label)
        _, places = search.search(t)
        assert {license_scan.NOTICES[p[0]].label for p in places} == want, t
    for t in ("submit it license terms", "a bit license", "lit license"):
        assert not search.search(t)[1]


def test_clashing_columns(spark):
    rows = [(1, "mit license here", "a", 1, 2.0), (2, None, "b", 2, 3.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, spans int, score double")
    assert {(r.doc_id, r.labels) for r in license_scan.license_scan(df).collect()} == {(1, "mit"), (2, "")}
