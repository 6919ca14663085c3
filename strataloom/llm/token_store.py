"""Token-ID files with a minimal perfect hash index.

A store is a folder of shards. A shard holds the raw ids of a range of ascending document ids, the keys and lengths in
the same order, and a minimal perfect hash (levels of collision-free bits, as in BBHash) that maps a key to a slot with a
fingerprint, the document's number and its offset: one look at a few bits and one read give the ids of a key. Shards are
found by their key ranges, which are kept in a small manifest. Layout, all little-endian:

    "STLTOK01" | ids (2 or 4 bytes each) | keys int64 | null flags uint8 | offsets uint64 (one more than keys)
    | bit words uint64 | ranks uint64 | slots (fingerprint uint32, document uint32) | JSON footer | its length uint32 | "STLTOK01"
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .common import dealing_keys, id_bounds, materialize, scratch_dir, text_slices, vocab_path
from .vocab import library_encoder, load_vocab

_MAGIC = b"STLTOK01"
_SLOT = np.dtype([("mark", "<u4"), ("doc", "<u4")])


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over uint64 keys (splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct uint64 keys: about three bits a key, expected constant time."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, bits, level = [], [], 0
        while len(keys):
            m = -(-max(64, int(gamma * len(keys))) // 64) * 64
            at = (mix(keys, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            bits.append(alone)
            keys = keys[~alone[at]]
            level += 1
            if level > 200:
                raise ValueError("keys must be distinct")
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view("<u8") if len(flat) else np.zeros(0, "<u8")
        ones = flat.reshape(-1, 64).sum(1) if len(flat) else np.zeros(0, np.int64)
        return cls(sizes, words, np.concatenate([[0], np.cumsum(ones)])[:-1].astype("<u8") if len(ones) else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were never put in (others get a slot that belongs to another key)."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(todo):
                break
            bit = (mix(keys[todo], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, off = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> off) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << off[hit]) - np.uint64(1))
            ones = np.unpackbits(below.view(np.uint8).reshape(-1, 8), axis=1).sum(1)
            out[todo[hit]] = self.ranks[bit[hit] >> 6].astype(np.int64) + ones
            todo = todo[~hit]
        return out


def _marks(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 10_007) >> np.uint64(32)).astype("<u4")


def _run_starts(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """True where a key differs from the one before; a null key is none."""
    out = np.ones(len(keys), bool)
    out[1:] = (np.diff(keys) != 0) | (null[1:] != null[:-1])
    return out


class ShardWriter:
    """Writes one shard as documents come in ascending order; only keys and lengths are held."""

    def __init__(self, files: fs.FileSystem, path: str, wide: bool):
        self.out = files.open_output_stream(path)
        self.type = "<u4" if wide else "<u2"
        self.keys: list[int] = []
        self.null: list[bool] = []
        self.lens: list[int] = []
        self.out.write(_MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.null.append(key is None)
        self.lens.append(len(ids))
        self.out.write(ids.astype(self.type).tobytes())

    def close(self) -> None:
        keys, null = np.array(self.keys, "<i8"), np.array(self.null, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(self.lens)]).astype("<u8")
        first = np.flatnonzero(_run_starts(keys, null) & (null == 0))
        distinct = keys[first].view("<u8")
        table = PerfectHash.build(distinct)
        slots = np.zeros(len(distinct), _SLOT)
        at = table.slots(distinct)
        slots["mark"][at], slots["doc"][at] = _marks(distinct), first
        sections = [keys, null, offsets, table.words, table.ranks, slots]
        foot = {"type": self.type, "docs": len(keys), "ids": int(offsets[-1]), "levels": table.sizes, "sizes": [s.nbytes for s in sections]}
        for s in sections:
            self.out.write(s.tobytes())
        raw = json.dumps(foot).encode()
        self.out.write(raw + struct.pack("<I", len(raw)) + _MAGIC)
        self.out.close()


class ShardReader:
    """Reads a shard; ``get`` finds a key's documents without a scan."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != _MAGIC:
            raise ValueError(f"{path} is not a complete shard")
        (n,) = struct.unpack("<I", tail[:4])
        foot = json.loads(self.file.read_at(n, size - 12 - n))
        self.type = np.dtype(foot["type"])
        at = len(_MAGIC) + foot["ids"] * self.type.itemsize
        parts = []
        for k, kind in zip(foot["sizes"], ("<i8", np.uint8, "<u8", "<u8", "<u8", _SLOT)):
            parts.append(np.frombuffer(self.file.read_at(k, at), kind))
            at += k
        self.keys, self.null, self.offsets, words, ranks, self.slot = parts
        self.table = PerfectHash(foot["levels"], words, ranks)

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, doc: int) -> np.ndarray:
        """Ids of a document by its number in the shard."""
        a, b = int(self.offsets[doc]), int(self.offsets[doc + 1])
        w = self.type.itemsize
        return np.frombuffer(self.file.read_at((b - a) * w, len(_MAGIC) + a * w), self.type)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document of each key, -1 for a key that the shard doesn't hold."""
        k = keys.astype("<i8")
        at = self.table.slots(k.view("<u8"))
        ok = at >= 0
        if ok.any():
            ok[ok] = self.slot["mark"][at[ok]] == _marks(k.view("<u8")[ok])
            ok[ok] = self.keys[self.slot["doc"][at[ok]]] == k[ok]  # a fingerprint of 32 bits may lie
        out = np.full(len(k), -1, np.int64)
        out[ok] = self.slot["doc"][at[ok]]
        return out

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every document with this key; repeated keys lie side by side."""
        doc = int(self.find(np.array([key]))[0])
        out = []
        while 0 <= doc < len(self.keys) and self.keys[doc] == key and not self.null[doc]:
            out.append(self.ids(doc))
            doc += 1
        return out

    def close(self) -> None:
        self.file.close()


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder; a path without a scheme is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _folder(uri: str) -> str:
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_token_store(
    docs: DataFrame,
    path: str,
    vocab: str | None = None,
    end_id: int = 1,
    shard_docs: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode, sort by id and write the shards below ``path``; the manifest, one row per shard, is returned.

    Every text gets ``end_id`` at its end; null and empty texts have it alone. Ids must be integers; rows of one id lie
    side by side, in order of their length and ids; rows with a null id come first and have no key. A task that is run
    again writes other file names, and only files in the manifest count. An empty table has an empty manifest. A text of any
    length is encoded whole; other columns are not read, whatever their names. All rows of one id, and all without an id,
    lie in one shard and pass through one task.
    """
    vocab = vocab or vocab_path("word_bpe_49k.json")
    wide = load_vocab(vocab).size > 65_536
    cuts = id_bounds(docs, id_col, shard_docs)
    folder = _folder(path)
    # Each shard has a partition of its own: hashing the shard numbers alone would put several into one task.
    deal = dealing_keys(docs.sparkSession, len(cuts) + 1)

    def encode(batches):
        encoder, edges = library_encoder(vocab), np.array(cuts, np.int64)
        for b in batches:
            ids = b.column(0)
            shard = np.searchsorted(edges, np.asarray(ids.fill_null(0)), "left").astype(np.int32)
            shard[np.asarray(ids.is_null())] = 0
            raw = []
            for texts in text_slices(b.column(1)):
                for t in texts:
                    raw.append(np.append(encoder.encode(t), np.uint32(end_id)).astype("<u4" if wide else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(shard), pa.array(np.array(deal, np.int32)[shard]), pa.array(raw, pa.binary())], names=["doc_key", "shard", "deal", "ids"])

    def write(batches: Iterator[pa.RecordBatch]):
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        made, now = [], None

        def close() -> None:
            now[2].close()
            lens, keys = now[2].lens, [k for k, z in zip(now[2].keys, now[2].null) if not z]
            made.append((now[0], now[1], len(lens), sum(lens), min(keys, default=None), max(keys, default=None)))

        for b in batches:
            for key, shard, raw in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != shard:
                    if now:
                        close()
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
                    now = (shard, name, ShardWriter(files, f"{base}/{name}", wide))
                now[2].add(key, np.frombuffer(raw, "<u4" if wide else "<u2"))
        if now:
            close()
        cols = list(zip(*made)) or [()] * 6
        types = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["shard", "file", "n_docs", "n_ids", "first_id", "last_id"])

    coded = spread(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))).mapInArrow(encode, "doc_key long, shard int, deal int, ids binary")
    sorted_ = coded.repartition(len(cuts) + 1, "deal").sortWithinPartitions("shard", F.asc_nulls_first("doc_key"), F.length("ids"), "ids").select("doc_key", "shard", "ids")
    manifest = sorted_.mapInArrow(write, "shard int, file string, n_docs long, n_ids long, first_id long, last_id long")
    return materialize(manifest, "token-manifest")


def _shard_starts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's number of ids before it; at most as many rows as id_bounds has cuts."""
    at, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((r.shard, r.file, at))
        at += r.n_ids
    made = spark.createDataFrame(rows, "shard int, file string, base long")
    return made.repartition(max(1, len(rows))) if rows else made


def read_token_store(spark: SparkSession, path: str, manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Every document of a store, found through the index: (doc_id, start, n_tokens, ids), or ids_crc32 for the ids.

    ``start`` is the number of ids of all documents before it; the CRC is over the ids as uint32.
    """
    folder = _folder(path)
    last = ("ids_crc32", "long", pa.int64()) if digest else ("ids", "array<int>", pa.list_(pa.int32()))

    def read(batches):
        files, base = _files(folder)
        for b in batches:
            for name, first in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                shard = ShardReader(files, f"{base}/{name}")
                found = shard.find(shard.keys)
                place = np.arange(len(shard))
                repeat = place - np.maximum.accumulate(np.where(_run_starts(shard.keys, shard.null), place, 0)) if len(shard) else place
                for lo in range(0, len(shard), 1024):
                    docs = range(lo, min(len(shard), lo + 1024))
                    cols: list[list] = [[], [], [], []]
                    for d in docs:
                        at = d if shard.null[d] else int(found[d]) + int(repeat[d])
                        ids = shard.ids(at)
                        cols[0].append(None if shard.null[d] else int(shard.keys[at]))
                        cols[1].append(first + int(shard.offsets[at]))
                        cols[2].append(len(ids))
                        cols[3].append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], last[2])], names=["doc_id", "start", "n_tokens", last[0]]
                    )
                shard.close()

    return _shard_starts(spark, manifest).mapInArrow(read, f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}")


def lookup_tokens(spark: SparkSession, path: str, manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, ids) for every document with one of the keys; keys that the store lacks give no row.

    Keys go to the shard whose range holds them (the ranges are the manifest's rows); a shard's task reads only the
    documents asked for.
    """
    folder = _folder(path)
    wanted = keys.select(F.col(key_col).cast("long").alias("k")).where("k IS NOT NULL").distinct()
    ranges = sorted((r.first_id, r.last_id, r.file) for r in manifest.where("first_id IS NOT NULL").collect())
    lows, names = [r[0] for r in ranges], [r[2] for r in ranges]
    if not ranges:
        return spark.createDataFrame([], "doc_id long, ids array<int>")

    def route(batches):
        edges = np.array(lows, np.int64)
        for b in batches:
            at = np.searchsorted(edges, np.asarray(b.column(0)), "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.maximum(at, 0).astype(np.int32))], names=["k", "shard"])

    def read(batches):
        files, base = _files(folder)
        now, shard = None, None
        for b in batches:
            keys_, ids = [], []
            for k, s in zip(*(c.to_pylist() for c in b.columns)):
                if s != now:
                    if shard:
                        shard.close()
                    now, shard = s, ShardReader(files, f"{base}/{names[s]}")
                for x in shard.get(k):
                    keys_.append(k)
                    ids.append(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys_, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    routed = wanted.mapInArrow(route, "k long, shard int").repartition("shard").sortWithinPartitions("shard", "k")
    return routed.mapInArrow(read, "doc_id long, ids array<int>")


def token_store_digest(docs: DataFrame, vocab: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store in the shared folder and return (doc_id, start, n_tokens, ids_crc32) as read back from its files.

    Odd rows as in :func:`write_token_store`: each row gives one, an empty table none.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark, "token-store")
    manifest = write_token_store(docs, path, vocab, end_id, id_col=id_col, text_col=text_col)
    return read_token_store(spark, path, manifest, digest=True)
