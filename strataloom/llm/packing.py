"""Best-fit packing with a swap-based local search.

Documents become pieces of at most one sequence. Pieces are dealt by hash into groups of bounded size, and each group is
packed alone: best fit in descending order, then a local search that moves one document, exchanges one for one, or two
for one, between underfull bins. Each step must raise the sum of squared fills, which drains the emptiest bins until they
vanish; the search ends when no step is left. The pieces of bins that are still underfull are dealt anew into fewer groups
and packed again, level by level, so the loss does not grow with the number of groups, while no task ever holds more than
a group's piece sizes.
"""

from __future__ import annotations

import zlib
from heapq import heappop, heappush
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import drop_dirs, materialize, text_slices, vocab_path
from .vocab import library_encoder

_PIECES = "piece int, start long, length long, ids_crc32 long"


class _Bins:
    """Bins that hold items by size, with an index of the sizes that underfull bins can give away."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.held: list[dict[int, list[int]]] = []
        self.fill: list[int] = []
        self._best_fit()

    def items(self, b: int) -> list[int]:
        return sorted(i for own in self.held[b].values() for i in own)

    def _best_fit(self) -> None:
        """Largest first, each into the bin that it fills best."""
        open_by_slack: dict[int, list[int]] = {}
        mask = 0  # bit s: some bin has slack s
        for item in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            size = self.sizes[item]
            above = mask >> size
            if above:
                slack = size + (above & -above).bit_length() - 1
                bins = open_by_slack[slack]
                b = bins.pop()
                if not bins:
                    mask &= ~(1 << slack)
            else:
                b, slack = len(self.held), self.capacity
                self.held.append({})
                self.fill.append(0)
            self._put(b, item)
            if left := slack - size:
                open_by_slack.setdefault(left, []).append(b)
                mask |= 1 << left

    def _put(self, b: int, item: int) -> None:
        self.held[b].setdefault(self.sizes[item], []).append(item)
        self.fill[b] += self.sizes[item]

    def _take(self, b: int, size: int) -> int:
        own = self.held[b][size]
        item = own.pop()
        if not own:
            del self.held[b][size]
        self.fill[b] -= size
        return item

    def search(self) -> None:
        """Improving steps from the fullest underfull bin to the emptiest, until none is left."""
        changed = True
        while changed:
            under = [b for b in range(len(self.held)) if 0 < self.fill[b] < self.capacity]
            # Offers of one item and of two: total size -> heap of (what stays in the bin, bin, sizes). Entries are not
            # taken out when their bin changes, but passed over once they no longer tell the truth.
            self.offers: tuple[dict, dict] = {}, {}
            self.sizes_at = [0, 0]  # bit s: some offer has total size s
            for b in under:
                self._offer(b)
            changed = False
            for a in sorted(under, key=lambda b: (-self.fill[b], b)):
                while 0 < self.fill[a] < self.capacity and self._improve(a):
                    changed = True

    def _offer(self, b: int) -> None:
        """Note what bin ``b`` can give; a bin has few distinct sizes, so all pairs of them are few too."""
        held, fill = self.held[b], self.fill[b]
        singles = ((s,) for s in held)
        pairs = ((s, t) for s, t in combinations_with_replacement(sorted(held), 2) if s != t or len(held[s]) > 1)
        for kind, made in enumerate((singles, pairs)):
            offers = self.offers[kind]
            for own in made:
                total = sum(own)
                heappush(offers.setdefault(total, []), (fill - total, b, own))
                self.sizes_at[kind] |= 1 << total

    def _true(self, b: int, own: tuple[int, ...], stays: int) -> bool:
        held = self.held[b]
        return self.fill[b] == stays + sum(own) and all(s in held for s in own) and (len(own) == 1 or own[0] != own[1] or len(held[own[0]]) > 1)

    def _donor(self, a: int, kind: int, total: int, left: int) -> tuple[int, tuple[int, ...]] | None:
        """A bin other than ``a`` that gives up items of this total and then holds less than ``left``."""
        heap, found, own_offers = self.offers[kind].get(total), None, []
        while heap and heap[0][0] < left:
            stays, b, own = heap[0]
            if self._true(b, own, stays):
                if b != a:
                    found = b, own
                    break
                own_offers.append(heap[0])
            heappop(heap)
        for entry in own_offers:
            heappush(heap, entry)
        return found

    def _improve(self, a: int) -> bool:
        """One step: the sum of squares rises where the bin that gives keeps less than this one holds without what leaves."""
        slack, best = self.capacity - self.fill[a], None
        for out in (0, *self.held[a]):  # out: the size that leaves this bin; 0: a plain move
            left = self.fill[a] - out
            if not left:
                continue
            at = self.sizes_at[0] | self.sizes_at[1] if out else self.sizes_at[0]
            window = (at >> (out + 1)) & ((1 << slack) - 1)
            while window:
                gain = window.bit_length()
                if best and gain <= best[0]:
                    break
                donor = self._donor(a, 0, out + gain, left) or (self._donor(a, 1, out + gain, left) if out else None)
                if donor:
                    best = gain, out, donor
                    break
                window &= ~(1 << (gain - 1))
            if best and best[0] == slack:
                break
        if not best:
            return False
        _, out, (b, own) = best
        back = self._take(a, out) if out else None
        for s in own:
            self._put(a, self._take(b, s))
        if back is not None:
            self._put(b, back)
        for changed in (a, b):
            self._offer(changed)
        return True


def pack_sizes(sizes: list[int], capacity: int = 2048) -> list[list[int]]:
    """Lists of positions in ``sizes``, one for each bin; no bin exceeds the capacity."""
    full = [[i] for i, s in enumerate(sizes) if s >= capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    bins = _Bins([sizes[i] for i in rest], capacity)
    bins.search()
    return full + [[rest[i] for i in bins.items(b)] for b in range(len(bins.held)) if bins.held[b]]


def document_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids with its end id, cut from the back into full pieces."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {_PIECES}"

    def run(batches):
        encoder, end = library_encoder(path), np.uint32(end_id).tobytes()
        for b in batches:
            row, cols, k = [], ([], [], [], []), 0
            for texts in text_slices(b.column(1)):
                for t in texts:
                    raw = encoder.encode(t).astype("<u4").tobytes() + end
                    n = len(raw) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        row.append(k)
                        for c, v in zip(cols, (p, x, y - x, zlib.crc32(raw[4 * x : 4 * y]))):
                            c.append(v)
                    k += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, schema)


def pack_level(pieces: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """``pieces`` with (sequence_id, offset, fill), packed within ``groups`` groups dealt by hash; ``fill`` is the sequence's.

    Ids stay Arrow columns from end to end, so no null turns an integer into a float.
    """
    id_col = pieces.columns[0]

    def pack(key, table):
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_pylist()
        seq, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for s, own in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for i in own:
                seq[i], offset[i] = s, at
                at += sizes[i]
            fill[own] = at
        first = (level << 58) + (key[0].as_py() << 30)
        table = table.drop_columns(["pack_group"])
        for name, made in (("sequence_id", first + seq), ("offset", offset), ("fill", fill)):
            table = table.append_column(name, pa.array(made))
        return table

    kind = pieces.schema[id_col].dataType.simpleString()
    # Hash of all that tells pieces apart: null or repeated ids spread too.
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(pack, f"{id_col} {kind}, {_PIECES}, sequence_id long, offset long, fill long")


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    group_pieces: int = 16_384,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes.

    Only documents of more than ``capacity`` ids are cut; then the first piece is the short one. A text of any length is
    one row's work and makes pieces of bounded size. Null and empty texts are one piece with the end id. Null ids and
    repeated rows are packed like any others; an empty table gives no rows. ``sequence_id`` is unique over the result.
    Other columns of ``docs`` are neither read nor returned, whatever their names. Texts are tokenized once; only piece
    sizes are written and shuffled, and ids can be made again for the files of a training run.

    ``group_pieces`` bounds what one task packs. Pieces of sequences that stay underfull are packed again in fewer groups
    until one group holds them all, or until more than half of a level's pieces stay underfull: sizes that don't fit
    together in one group of thousands don't in another.
    """
    path = path or vocab_path("byte_bpe_50k.json")
    spark, made, level, done = docs.sparkSession, [], 0, []
    rest = materialize(document_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces", made)
    n = rest.count()
    while True:
        groups = max(1, -(-n // group_pieces))
        packed = materialize(pack_level(rest, groups, level, capacity), "packed")
        if level == 0:
            drop_dirs(spark, made)
        underfull = 0 if groups == 1 else packed.where(F.col("fill") < capacity).count()
        if not underfull or 2 * underfull > n:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") >= capacity))
        rest = packed.where(F.col("fill") < capacity).drop("sequence_id", "offset", "fill")
        n, level = underfull, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.drop("fill")
