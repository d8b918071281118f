"""Best-fit packing by exact-complement hashing over the histogram of piece lengths."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpath.llm.common import map_arrow, written
from quillpath.llm.tokens import crc32s, encoder

#: Pieces of one length are numbered in parts of about so many, so that no length lies in one task.
PART = 20_000


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): every document's ids and end_id, cut into
    pieces of at most capacity ids, of which only the first may be shorter. Null texts are empty."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for row, ids, at in enc.rows(batch["text"], end_id):
                size = np.diff(at)
                n = -(-size // capacity)
                of = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                first = size - (n - 1) * capacity
                start = np.where(piece == 0, 0, first[of] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[of], capacity)
                bounds = np.concatenate([[0], np.cumsum(length)])
                columns = [batch["doc_id"].take(pa.array(row + of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc32s(ids, bounds))]
                if keep_ids:
                    columns.append(pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return map_arrow(documents.select("doc_id", "text"), cut, schema)


class _Sums:
    """Lengths that are left, and hash indexes of the sums of two and of three of them.

    The pairs of a sum are found when it is first asked for, the longest first part first, and of a sum of three it is kept
    how far its longest part has been tried. Availability only falls, so what cannot be had is never looked at again.
    """

    def __init__(self, left: np.ndarray, capacity: int):
        self.left, self.capacity = left, capacity
        self.there = np.flatnonzero(left)
        self.pairs: dict[int, list] = {}
        self.triples: dict[int, int] = {}
        self.singles = self.there[::-1].tolist()

    def has(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def _pairs(self, total: int) -> list:
        """How many pairs of a sum are used up, and its pairs."""
        if total not in self.pairs:
            first = self.there[(2 * self.there >= total) & (self.there < total)][::-1]
            first = first[(self.left[first] > 0) & (self.left[total - first] > 0)]
            self.pairs[total] = [0, list(zip(first.tolist(), (total - first).tolist(), strict=True))]
        return self.pairs[total]

    def pair(self, total: int, most: int, *others: int) -> tuple[int, int] | None:
        """Two lengths of the sum total, neither longer than most, that are left beside others."""
        index = self._pairs(total)
        used, pairs = index
        while used < len(pairs) and not (self.left[pairs[used][0]] and self.left[pairs[used][1]]):
            used += 1
        index[0] = used
        for a, b in itertools.islice(pairs, used, None):
            if a <= most and self.has(*others, a, b):
                return a, b
        return None

    def triple(self, total: int, *others: int) -> tuple[int, int, int] | None:
        """Three lengths of the sum total that are left beside others, which are the same whenever this sum is asked for."""
        for k in range(self.triples.get(total, 0), len(self.singles)):
            c = self.singles[k]
            if 3 * c < total:
                break
            if c < total and self.left[c] and (found := self.pair(total - c, c, *others, c)):
                self.triples[total] = k
                return c, *found
        self.triples[total] = len(self.singles)
        return None

    def exact(self, length: int) -> tuple[int, ...] | None:
        """length with nothing, one, two or three others that fill a sequence with it."""
        gap = self.capacity - length
        if gap == 0 or self.has(length, gap):
            return (length, gap) if gap else (length,)
        found = self.pair(gap, gap, length) or self.triple(gap, length)
        return (length, *found) if found else None


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their numbers, by best fit in falling length: each piece goes to the fullest sequence that has room
    for it. Pieces of one length and sequences of one pattern are moved together: once a sequence is the fullest that fits,
    it stays so until no other piece of the length fits, so it takes as many as it has room for."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for x in sorted(left, reverse=True):
        n = left[x]
        for room in sorted(r for r in rooms if r >= x):
            each = room // x
            groups = rooms.pop(room)
            while groups and n:
                pattern, times = groups.pop()
                taken = min(times, n // each)
                if taken:
                    rooms.setdefault(room - each * x, []).append((pattern + (x,) * each, taken))
                    n, times = n - taken * each, times - taken
                if times and n:  # fewer than each are left
                    rooms.setdefault(room - n * x, []).append((pattern + (x,) * n, 1))
                    n, times = 0, times - 1
                if times:
                    groups.append((pattern, times))
            if groups:
                rooms.setdefault(room, []).extend(groups)
        each = capacity // x
        for size, times in ((each, n // each), (n % each, 1)):
            if size and times:
                rooms.setdefault(capacity - size * x, []).append(((x,) * size, times))
    return [g for groups in rooms.values() for g in groups]


def _filled(left: np.ndarray, capacity: int, shortest: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their numbers: exact combinations of each length down to shortest, from the longest, consumed as often as all
    their lengths last, then best fit of what is left."""
    left = left.copy()
    sums, out = _Sums(left, capacity), []
    for length in range(capacity, shortest - 1, -1):
        while left[length] and (found := sums.exact(length)):
            uses = {x: found.count(x) for x in found}
            times = min(int(left[x]) // k for x, k in uses.items())
            for x, k in uses.items():
                left[x] -= k * times
            out.append((found, times))
        # what cannot be filled now cannot later: availability only falls
    return out + best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, capacity)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences filled by each.

    From the longest length down: where nothing, a single length, a pair or a triple fills its gap exactly,
    the combination is consumed as often as all its lengths last. What no combination fills is packed best
    fit. Combinations of short lengths alone may take what longer ones need later, so they are consumed down to several
    shortest lengths, over capacity among them, which is best fit alone, and the plan of the fewest sequences is taken.
    The work depends on the number of different lengths, not on that of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    least = -(-sum(length * n for length, n in histogram.items()) // capacity)
    best, fewest = [], None
    for shortest in (1, *(capacity * k // 4 + 1 for k in range(1, 5))):
        found = _filled(left, capacity, shortest)
        sequences = sum(times for _, times in found)
        if fewest is None or sequences < fewest:
            best, fewest = found, sequences
        if fewest == least:
            break
    return best


def pack(pieces_: DataFrame, capacity: int) -> DataFrame:
    """pieces_ with sequence_id and offset: as few sequences of at most capacity ids as the plan over
    the histogram of lengths finds, gapless from 0.

    The histogram has at most capacity rows, and the plan a few thousand, whatever the corpus. Every
    piece finds its place by its number among the pieces of its length. They are counted in parts by hash of
    (doc_id, piece), of about PART pieces each, and the driver has one number for each part. Repeated rows
    are pieces of their own; an empty table gives no rows; columns named as the results are replaced.
    """
    spark = pieces_.sparkSession
    pieces_ = pieces_.drop("sequence_id", "offset")
    total = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not total:
        return pieces_.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    rows, first, given = [], 0, {}
    for lengths, times in plan(total, capacity):
        at = 0
        for x in lengths:
            low = given.get(x, 0)
            rows.append((x, low, first - low, at))
            given[x] = low + times
            at += x
        first += times
    # each length's slots as sorted arrays; they follow one another without gaps, and a piece's slot is the last that begins at or before its number
    slots = pd.DataFrame(rows, columns=["length", "low", "shift", "offsets"]).sort_values("low").groupby("length").agg(list).reset_index()
    parts = {x: -(-n // PART) for x, n in total.items()}
    table = spark.createDataFrame([(int(r.length), int(parts[r.length]), [int(v) for v in r.low], [int(v) for v in r.shift], [int(v) for v in r.offsets]) for r in slots.itertuples()], "length long, _parts long, low array<long>, shift array<long>, offsets array<long>")
    keyed = pieces_.join(F.broadcast(table.select("length", "_parts")), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_parts"))).drop("_parts")
    counts = keyed.groupBy("length", "_part").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "_part"])
    counts["before"] = counts.groupby("length")["n"].cumsum() - counts["n"]
    before = F.broadcast(spark.createDataFrame(counts[["length", "_part", "before"]], "length long, _part long, before long"))
    place = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1
    numbered = keyed.withColumn("_place", place).join(before, ["length", "_part"]).withColumn("_rank", F.col("before") + F.col("_place")).drop("before", "_part", "_place")
    halves = F.array(*(F.lit(1 << k) for k in range(max(map(len, slots["low"])).bit_length(), -1, -1)))
    slot = F.aggregate(halves, F.lit(0), lambda p, s: F.when((p + s <= F.size("low")) & (F.get("low", p + s - 1) <= F.col("_rank")), p + s).otherwise(p)) - 1
    found = numbered.join(F.broadcast(table.drop("_parts")), "length").withColumn("_slot", slot)
    return found.withColumn("sequence_id", F.get("shift", F.col("_slot")) + F.col("_rank")).withColumn("offset", F.get("offsets", F.col("_slot"))).drop("_slot", "_rank", "low", "shift", "offsets")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids) for every piece of every document."""
    cut = written(pieces(documents, tokenizer, capacity, end_id, keep_ids))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return pack(cut, capacity).select(*columns)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pack_documents(..., keep_ids=True); a sequence has at most capacity ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
