"""Token ids in binary shards, with a minimal perfect hash from document keys to shard offsets.

A store is a folder with two tables that Spark's writers commit, so that lost tasks and executors
leave nothing behind:

shards  part, seq, n_docs, n_ids, docs, sizes, ids: shard seq of range part holds about SHARD_IDS ids.
        ids is the raw payload (little-endian unsigned 16 or 32 bits by `width`), docs and sizes are
        the keys (int64) and numbers of ids (uint32) of its documents, in ascending key.
index   bucket, n_keys, levels, words, ranks and one array for each stored field: a minimal perfect
        hash over the keys of one hash bucket. A key's bit position at each level is found by hashing;
        the first level whose bit is set gives its slot, as the number of bits set before it. The slot
        has a 32-bit fingerprint of the key, which tells absent keys apart, and the key's place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillpath.llm.common import map_arrow, mixed
from quillpath.llm.tokens import crc32s, encoder

SHARD_IDS = 1 << 20
#: Keys of a bucket of the index, about.
BUCKET_KEYS = 1 << 15
#: Null keys are stored as this one.
NULL_KEY = -(2**63)
_FIELDS = {"fingerprints": "<u4", "parts": "<i4", "seqs": "<i4", "offsets": "<i8", "sizes": "<u4", "starts": "<i8"}
_SHARDS = "part int, seq int, n_docs int, n_ids long, width int, docs binary, sizes binary, ids binary"
_PLACES = "doc_id long, part int, seq int, offset long, n_tokens long"


# ---- minimal perfect hashing ---------------------------------------------------------------------


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys + np.uint64((level + 1) * 0xD1342543DE82EF95 % 2**64)) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, bit words of all levels and bits set before each word, for distinct uint64 keys."""
    levels, bits, rest = [], [], keys
    while len(rest):
        size = -(-max(64, len(rest) * 3 // 2) // 64) * 64
        at = _positions(rest, len(levels), size)
        hits = np.bincount(at, minlength=size)
        levels.append(size)
        bits.append(hits == 1)
        rest = rest[hits[at] > 1]
    words = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.zeros(0, "<u8")
    ranks = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
    return levels, words, ranks.astype("<u4")


def slots(keys: np.ndarray, levels: list[int], words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of every key; -1 where no level has its bit, so that the key is surely absent."""
    out = np.full(len(keys), -1, np.int64)
    open_, base = np.arange(len(keys)), 0
    for level, size in enumerate(levels):
        at = _positions(keys[open_], level, size)
        word, bit = words[base + (at >> 6)], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = word & ((np.uint64(1) << bit) - np.uint64(1))
        out[open_[hit]] = ranks[base + (at[hit] >> 6)].astype(np.int64) + np.bitwise_count(below[hit])
        open_, base = open_[~hit], base + size // 64
    return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype("<u4")


def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), F.col("doc_id")), F.lit(buckets)).cast("int").alias("bucket")


# ---- writing ---------------------------------------------------------------------------------------


def write_store(documents: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Ids of every whole text (null: empty) and end_id after each, in ascending doc_id order.

    Equal doc_ids are ordered by text; the index leads to the first of them. Null doc_ids come first,
    under NULL_KEY. An empty table makes an empty store. Other columns are ignored.
    """
    spark = documents.sparkSession

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        context = TaskContext.get()
        part, seq, held = context.partitionId() if context else 0, 0, 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            docs, sizes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = [part, seq, len(docs), len(ids), enc.dtype.itemsize, docs.tobytes(), sizes.tobytes(), ids.tobytes()]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in _SHARDS.split(", ")])

        for batch in batches:
            docs = batch["doc_id"].fill_null(NULL_KEY).to_numpy().astype("<i8")
            for row, ids, at in enc.rows(batch["text"], end_id):
                parts.append((docs[row : row + len(at) - 1], np.diff(at).astype("<u4"), ids))
                held += len(ids)
                if held >= SHARD_IDS:
                    yield shard()
                    parts, held, seq = [], 0, seq + 1
        if parts:
            yield shard()

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select("doc_id", "text").repartitionByRange(ranges, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    map_arrow(ordered, shards, _SHARDS).write.option("compression", "zstd").parquet(f"{path}/shards")
    _write_index(spark, path)


def _write_index(spark: SparkSession, path: str) -> None:
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards").drop("ids")
    # one number for each range on the driver, a window over the shards of a range
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"), F.sum("n_docs").alias("docs")).orderBy("part").toPandas()
    before = totals["n"].cumsum() - totals["n"] if len(totals) else totals["n"]
    first = spark.createDataFrame([(int(p), int(b)) for p, b in zip(totals["part"], before, strict=True)], "part int, first long")
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("start", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(F.broadcast(first), "part").withColumn("start", F.col("start") + F.col("first"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, sizes = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                at = np.cumsum(sizes) - sizes
                n = len(docs)
                columns = [docs, np.full(n, row["part"], np.int32), np.full(n, row["seq"], np.int32), at, sizes, at + row["start"]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["doc_id", "part", "seq", "offset", "n_tokens", "start"])

    keys = map_arrow(placed.select("part", "seq", "docs", "sizes", "start"), entries, f"{_PLACES}, start long")
    buckets = max(1, int(totals["docs"].sum()) // BUCKET_KEYS)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start").drop_duplicates("doc_id")
        keys = group["doc_id"].to_numpy(np.int64).view(np.uint64)
        levels, words, ranks = perfect_hash(keys)
        order = np.argsort(slots(keys, levels, words, ranks))
        stored = dict(zip(_FIELDS, (_fingerprint(keys), *(group[c].to_numpy() for c in ("part", "seq", "offset", "n_tokens", "start"))), strict=True))
        row = {"bucket": group["bucket"].iloc[0], "n_keys": len(keys), "levels": levels, "words": words.tobytes(), "ranks": ranks.tobytes()}
        return pd.DataFrame([row | {k: v[order].astype(_FIELDS[k]).tobytes() for k, v in stored.items()}])

    index = keys.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(build, _index_schema())
    index.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/index")


def _index_schema() -> str:
    return "bucket int, n_keys int, levels array<int>, words binary, ranks binary, " + ", ".join(f"{k} binary" for k in _FIELDS)


# ---- reading ---------------------------------------------------------------------------------------


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, part, seq, offset, n_tokens, start of the distinct keys (column doc_id) that the store has."""
    index = spark.read.schema(_index_schema() + ", buckets int").parquet(f"{path}/index")
    first = index.select("buckets").first()
    buckets = first[0] if first else 1

    def find(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "part", "seq", "offset", "n_tokens", "start"]
        if index.empty or keys.empty:
            return pd.DataFrame({c: pd.Series(dtype=np.int64) for c in names})
        row = index.iloc[0]
        k = keys["doc_id"].to_numpy(np.int64)
        hashed = k.view(np.uint64)
        slot = slots(hashed, list(row["levels"]), np.frombuffer(row["words"], "<u8"), np.frombuffer(row["ranks"], "<u4"))
        field = {f: np.frombuffer(row[f], t) for f, t in _FIELDS.items()}
        there = slot >= 0
        there[there] = field["fingerprints"][slot[there]] == _fingerprint(hashed[there])
        k, slot = k[there], slot[there]
        return pd.DataFrame(dict(zip(names, (k, *(field[f][slot].astype(np.int64) for f in ("parts", "seqs", "offsets", "sizes", "starts"))), strict=True)))

    keys = keys.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("doc_id")).distinct().withColumn("bucket", _bucket(buckets))
    return keys.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, f"{_PLACES}, start long")


def read_slices(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """part, seq, offset, n_tokens, ids_crc32 (and ids as array<int>) of every document, read from the payloads where they lie."""
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards").select("part", "seq", "width", "sizes", "ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = np.frombuffer(row["ids"], f"<u{row['width']}"), np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                n, bounds = len(sizes), np.concatenate([[0], ends])
                columns = [np.full(n, row["part"], np.int32), np.full(n, row["seq"], np.int32), ends - sizes, sizes, crc32s(ids, bounds)]
                names = ["part", "seq", "offset", "n_tokens", "ids_crc32"]
                arrays = list(map(pa.array, columns))
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(shards, read, "part int, seq int, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fetch(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id and ids array<int> of the keys that the store has. Only the shards that hold one are
    opened; their payloads are sliced in place."""
    found = lookup(spark, path, keys)
    slices = found.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "offset", "n_tokens")).alias("slices"))
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards").select("part", "seq", "width", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                parts = [(s["doc_id"], ids[s["offset"] : s["offset"] + s["n_tokens"]].astype(np.int32)) for s in row["slices"]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([v for _, v in parts], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(shards.join(slices, ["part", "seq"]), cut, "doc_id long, ids array<int>")


def stored_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, seq, offset of every document, each found by its key and read from the store."""
    spark = documents.sparkSession
    found = lookup(spark, path, documents)
    slices = read_slices(spark, path).drop("n_tokens")
    ids = documents.select("doc_id", F.coalesce("doc_id", F.lit(NULL_KEY)).alias("_key"))
    return ids.join(found.join(slices, ["part", "seq", "offset"]).withColumnRenamed("doc_id", "_key"), "_key").select("doc_id", "start", "n_tokens", "ids_crc32", "part", "seq", "offset")
