"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpath.llm.common import ASCII_WORD, map_arrow, only_ids, row_sets, row_slices, run_hashes, shingle_hashes, utf8, word_hashes, written

#: Words: runs of ASCII letters and digits (case folded) and characters outside ASCII.
WORDS = 5
THRESHOLD = 0.8
#: log2 of the sketch bins for each shingle of the upper bound of a size partition. With 4 bins, a
#: shingle is the least of its bin with probability 0.88 or more, whatever the document's length.
BINS_LOG2 = 2
#: An item's sketch is made of its least hashes: so many that a document which reaches the threshold
#: holds SURE of them at least, and is missed with probability 0.12**SURE, about 1e-12.
SURE = 13
#: Items of fewer shingles are probed by every shingle of a document, so that nothing rests on chance.
FEW = 16
#: Distinct shingles of all items that may be broadcast (16 bytes each).
BROADCAST_SHINGLES = 1_000_000


def sets_of(column: pa.Array, width: int = WORDS, classes: np.ndarray = ASCII_WORD, short: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the rows: the first row, their distinct shingle hashes, and the rows' offsets in them."""
    data, offsets = utf8(column)
    for a, b in row_slices(offsets):
        words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], classes)
        yield a, *row_sets(*shingle_hashes(words, counts, width, short), b - a)


def sketch(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which hashes are the least of their bin in their row: one-permutation MinHash. A row of
    2**(p-1) + 1 to 2**p hashes is in size partition p, whose sketches have 2**(p + BINS_LOG2) bins by the
    upper bits of a hash. As hashes ascend in a row, the first of each bin is its least."""
    n = np.diff(at)
    bins = np.ceil(np.log2(np.maximum(n, 1))).astype(np.uint64) + np.uint64(BINS_LOG2)
    of = np.repeat(np.arange(len(n)), n)
    bin_ = hashes >> (np.uint64(64) - bins)[of]
    out = np.ones(len(hashes), bool)
    out[1:] = (bin_[1:] != bin_[:-1]) | (of[1:] != of[:-1])
    return out


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """item_id, shingle, width (distinct): the shingles of every item, over all rows of the item. A row of fewer than
    WORDS words is one run of its `width` words; other shingles have width WORDS."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in row_slices(offsets):
                words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ASCII_WORD)
                hashes, of = shingle_hashes(words, counts, WORDS, True)
                width = np.minimum(np.diff(counts), WORDS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(a + of)), pa.array(hashes.view(np.int64)), pa.array(width[of])], ["item_id", "shingle", "width"])

    known = benchmark.select("item_id", "text").where("item_id is not null")
    return map_arrow(known, shingles, "item_id long, shingle long, width int").distinct()


def _searched(column: pa.Array, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the rows: the first row, shingle hashes, the rows' offsets in them, which are in the sketch, and the
    hashes of runs of `widths` words (fewer than WORDS) with the row of each."""
    data, offsets = utf8(column)
    for a, b in row_slices(offsets):
        words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ASCII_WORD)
        hashes, at = row_sets(*shingle_hashes(words, counts, WORDS, False), b - a)
        runs = [run_hashes(words, counts, w) for w in widths]
        run, of = (np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
        run, run_at = row_sets(run, of, b - a)
        yield a, hashes, at, sketch(hashes, at), run, np.repeat(np.arange(b - a), np.diff(run_at))


class _Items:
    """All items in arrays: the shingles of each in ascending order, and the sketches by shingle."""

    def __init__(self, rows: pa.Table, threshold: float):
        item = rows["item_id"].to_numpy()
        shingle = rows["shingle"].to_numpy().view(np.uint64)
        order = np.lexsort((shingle, item))
        self.shingle = shingle[order]
        self.names, first = np.unique(item[order], return_index=True)
        self.at = np.append(first, len(item))
        self.size = np.diff(self.at)
        self.widths = sorted(set(rows["width"].to_pylist()) - {WORDS})
        of = np.repeat(np.arange(len(self.names)), self.size)
        place = np.arange(len(of)) - np.repeat(first, self.size)
        probes = np.flatnonzero((place < probed(self.size, threshold)[of]) | (self.size[of] < FEW))
        probes = probes[np.argsort(self.shingle[probes], kind="stable")]
        self.probe, self.probe_of = self.shingle[probes], of[probes]

    def met(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hashes that are probes, and the items whose they are."""
        low = np.searchsorted(self.probe, hashes, "left")
        count = np.searchsorted(self.probe, hashes, "right") - low
        at = np.flatnonzero(count)
        n = count[at]
        return np.repeat(at, n), self.probe_of[np.repeat(low[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def probed(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many of its least shingles an item of `size` shingles is looked up by."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + SURE


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment for every document that holds at least
    `threshold` of the distinct shingles of five words of an item.

    Documents are put into partitions by the number of their shingles; in each, a MinHash sketch has
    bins in proportion to the partition's upper bound. The items' own sketches, their least hashes, are
    looked up in them (items of fewer than FEW shingles in whole sets); what meets is a candidate, and
    only of candidates are the item's shingles counted in the document's whole set.
    The items are broadcast if they have at most `broadcast_shingles` shingles; beyond, the same sketches and then the
    sets of candidates are joined by shuffles, with the same results.
    An item's row of under five words is found as the run of all its words. Null and empty texts hold and
    match nothing; rows with a null id are left out on the items' side and keep the null on the documents'.
    Repeated rows give repeated results; items of one item_id are one item with all their shingles.
    """
    items = written(item_shingles(benchmark))
    if items.count() > broadcast_shingles:
        return _by_shuffle(documents, items, threshold)
    held = documents.sparkSession.sparkContext.broadcast(_Items(items.toArrow(), threshold))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            for a, hashes, at, least, run, run_of in _searched(batch["text"], items.widths):
                hit, item = items.met(hashes)
                keep = least[hit] | (items.size[item] < FEW)
                of = np.searchsorted(at, hit[keep], "right") - 1
                run_hit, run_item = items.met(run)
                pairs = np.unique(np.concatenate([of, run_of[run_hit]]) * len(items.names) + np.concatenate([item[keep], run_item])) if len(items.names) else np.zeros(0, np.int64)
                row, item = np.divmod(pairs, max(len(items.names), 1))
                found = np.zeros(len(pairs), np.int64)
                for k, (r, i) in enumerate(zip(row.tolist(), item.tolist(), strict=True)):
                    wanted = items.shingle[items.at[i] : items.at[i + 1]]
                    found[k] = sum(np.isin(wanted, x, assume_unique=True).sum() for x in (hashes[at[r] : at[r + 1]], run[run_of == r]))
                keep = found >= threshold * items.size[item] - 1e-9
                row, item, found = row[keep], item[keep], found[keep]
                size = items.size[item]
                columns = [batch["doc_id"].take(pa.array(a + row)), *map(pa.array, (items.names[item], size, found, found / size))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_shingles", "n_found", "containment"])

    return map_arrow(documents.select("doc_id", "text"), search, "doc_id long, item_id long, n_shingles long, n_found long, containment double")


def _text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (F.xxhash64(text), F.xxhash64(F.lit("second"), text))))


def _by_shuffle(documents: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same for item sets that are too large to broadcast, over different texts. Repeated rows get their text's results."""
    widths = [r[0] for r in items.where(F.col("width") < WORDS).select("width").distinct().collect()]
    keyed = documents.select("doc_id", "text", _text_key(F.col("text")).alias("key")).where("text is not null")
    texts = written(keyed.groupBy("key").agg(F.min("text").alias("text")))

    def rows(whole: bool):
        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, hashes, at, least, run, run_of in _searched(batch["text"], widths):
                    n = np.diff(at)
                    if whole:
                        order = np.argsort(np.concatenate([np.repeat(np.arange(len(n)), n), run_of]), kind="stable")
                        both = np.concatenate([hashes, run])[order].view(np.int64)
                        bounds = np.concatenate([[0], np.cumsum(n + np.bincount(run_of, minlength=len(n)))])
                        lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(both)).cast(pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([batch["key"].slice(a, len(n)), lists], ["key", "shingles"])
                    else:
                        of = np.concatenate([np.repeat(np.arange(len(n)), n), run_of])
                        values = [np.concatenate([hashes, run]).view(np.int64), np.concatenate([least, np.ones(len(run), bool)])]
                        yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(a + of)), *map(pa.array, values)], ["key", "shingle", "least"])

        return shingles

    sets = items.groupBy("item_id").agg(F.sort_array(F.collect_list("shingle")).alias("wanted"))
    sets = written(sets.withColumn("n_shingles", F.size("wanted").cast("long")))
    # hashes ascend as unsigned numbers, of which those below 2**63 come first
    order = F.concat(F.filter("wanted", lambda s: s >= 0), F.filter("wanted", lambda s: s < 0))
    n = F.col("n_shingles") - F.ceil(threshold * F.col("n_shingles") - 1e-9) + SURE
    tiny = F.col("n_shingles") < FEW
    probes = sets.select("item_id", tiny.alias("tiny"), F.explode(F.when(tiny, F.col("wanted")).otherwise(F.slice(order, 1, n.cast("int")))).alias("shingle"))
    met = map_arrow(texts, rows(False), "key string, shingle long, least boolean").join(written(probes).hint("merge"), "shingle")
    pairs = written(met.where("least or tiny").select("key", "item_id").distinct())
    whole = map_arrow(only_ids(texts, pairs, "key"), rows(True), "key string, shingles array<long>")
    both = pairs.join(whole, "key").join(sets, "item_id").withColumn("n_found", F.size(F.array_intersect("wanted", "shingles")).cast("long"))
    found = written(both.where(F.col("n_found") >= threshold * F.col("n_shingles") - 1e-9).select("key", "item_id", "n_shingles", "n_found"))
    return keyed.select("doc_id", "key").join(found.hint("merge"), "key").select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


#: The same in SQL, by exact containment; an item's row of fewer words is one run of all its words.
ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10ffff}]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10ffff}]+') as w from benchmark),
bs as (
  select distinct item_id, array_to_string(w[i:i+4], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 3)) as i from b where len(w) >= 5)
  union select item_id, array_to_string(w, ' ') from b where len(w) between 1 and 4),
k as (select distinct least(len(w), 5) as k from b where len(w) > 0),
ds as (select distinct doc_id, array_to_string(w[i:i+k-1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, k where len(w) >= k)),
n as (select item_id, count(*) as n_shingles from bs group by item_id),
f as (select doc_id, item_id, count(*) as n_found from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_found, n_found / n_shingles as containment from f join n using (item_id) where n_found >= 0.8 * n_shingles - 1e-9
"""
