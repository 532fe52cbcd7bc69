"""Best-fit packing by exact-complement hashing.

Texts are encoded and cut into pieces of at most ``capacity`` ids.  The plan is
made from the number of pieces of each length alone, at most ``capacity``
numbers, so it is as large for a thousand documents as for a trillion: the
longest length left is combined with one, two or three others whose indexed sum
is exactly the gap, as often as the availability counts allow; what no
combination fills goes to the fullest sequence that still has room.  The
distributed part gives every piece its rank among pieces of its length (salted,
so that a common length is shared out), and looks the rank up in the plan.

Rows: a null or empty text is the end id alone; repeated rows are packed each; a
null doc_id is kept as it is, and rows of one or no doc_id are shared out by their
ids' checksums; pieces equal in doc_id, number and checksum have ranks in any order,
being alike; a very long text is encoded whole and cut; an empty table has no
pieces.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cedarflow.llm.common import materialise, partitions_of, small_batches, spread
from cedarflow.llm.tokens import encoder, public_path

CAPACITY = 2048


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end, step = encoder(public_path(tokenizer)), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), code.encode(batch.column("text").to_pylist()), strict=True):
                raw += end
                for k, i in enumerate(range(0, len(raw), step)):
                    part = raw[i : i + step]
                    rows.append((doc_id, k, k * capacity, len(part) // 4, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(picked, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Which lengths share a sequence, from the counts of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.made: list[tuple[Counter, int]] = []
        rest = self._exact()
        self._best_fit(rest)

    def _take(self, lengths: tuple[int, ...]) -> None:
        use = Counter(lengths)
        n = min(int(self.left[x]) // k for x, k in use.items())
        for x, k in use.items():
            self.left[x] -= n * k
        self.made.append((use, n))

    def _pair(self, gap: int, have: np.ndarray) -> tuple[int, int] | None:
        """Two lengths with that sum, the larger one as large as can be."""
        a = np.arange(1, gap // 2 + 1)
        ok = np.flatnonzero((have[a] > 0) & (have[gap - a] > 0) & ((2 * a != gap) | (have[a] > 1)))
        return (int(gap - a[ok[0]]), int(a[ok[0]])) if len(ok) else None

    def _fill(self, gap: int, have: np.ndarray) -> tuple[int, ...] | None:
        """One, two or three lengths whose sum is the gap."""
        if gap == 0:
            return ()
        if have[gap] > 0:
            return (gap,)
        if pair := self._pair(gap, have):
            return pair
        present = (have > 0).astype(np.float32)
        sums = np.convolve(present[: gap + 1], present[: gap + 1])[: gap + 1] > 0.5  # sums of pairs that may be there
        for first in np.flatnonzero(present[: gap + 1])[::-1].tolist():
            if first < gap and sums[gap - first]:
                have[first] -= 1
                pair = self._pair(gap - first, have)
                have[first] += 1
                if pair:
                    return (first, *pair)
        return None

    def _exact(self) -> dict[int, int]:
        rest: dict[int, int] = {}
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                have = self.left.copy()
                have[length] -= 1
                others = self._fill(self.capacity - length, have)
                if others is None:
                    rest[length] = int(self.left[length])
                    self.left[length] = 0
                else:
                    self._take((length, *others))
        return rest

    def _best_fit(self, rest: dict[int, int]) -> None:
        """Longest first, each to the smallest gap that has room, many at once."""
        groups: dict[int, list[list]] = {}  # by gap: [lengths, number of such sequences]

        def put(lengths: Counter, gap: int, n: int) -> None:
            if n:
                groups.setdefault(gap, []).append([lengths, n])

        for length, n in sorted(rest.items(), reverse=True):
            for gap in sorted(g for g in groups if g >= length):
                fit = gap // length
                while n and groups.get(gap):
                    lengths, m = groups[gap].pop()
                    full = min(m, n // fit)
                    put(lengths + Counter({length: fit}), gap - fit * length, full)
                    n, m = n - full * fit, m - full
                    if m and n:  # fewer than fit are left
                        put(lengths + Counter({length: n}), gap - n * length, 1)
                        n, m = 0, m - 1
                    if m:
                        put(lengths, gap, m)
                if not groups.get(gap):
                    groups.pop(gap, None)
                if not n:
                    break
            fit = self.capacity // length
            put(Counter({length: fit}), self.capacity - fit * length, n // fit)
            if n % fit:
                put(Counter({length: n % fit}), self.capacity - n % fit * length, 1)
        self.made += [(lengths, n) for made in groups.values() for lengths, n in made]

    def slots(self) -> dict[int, np.ndarray]:
        """By length, a row for each kind of sequence that holds it: first rank,
        first sequence, copies in a sequence, offset of the first copy."""
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: Counter = Counter()
        base = 0
        for lengths, n in self.made:
            offset = 0
            for length, copies in sorted(lengths.items(), reverse=True):
                found.setdefault(length, []).append((ranks[length], base, copies, offset))
                ranks[length] += n * copies
                offset += length * copies
            base += n
        return {length: np.array(rows, np.int64) for length, rows in found.items()}


def with_ranks(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, numbered from 0 among pieces of equal length."""
    salts = max(32, partitions_of(pieces.sparkSession))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.hint("merge").join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(own) - 1).drop("salt", "base")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are encoded once; the pieces are kept as a table in the shared folder.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Plan(counts, capacity).slots()
    held = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                length = int(lengths[at[0]])
                rows = held.value[length]
                first, base, copies, start = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1].T
                i = ranks[at] - first
                sequence[at], offset[at] = base + i // copies, start + i % copies * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = with_ranks(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
