"""What the operators share: the shared folder, whole-text word hashes, link components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quillpath-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, *where: Column) -> tuple:
    """written(df), the number of its rows, and of those for which each of the conditions holds, by one job."""
    rows = Observation()
    each = [F.count(F.lit(1)), *(F.count(F.when(c, 1)) for c in where)]
    out = written(df.observe(rows, *(n.alias(f"n{k}") for k, n in enumerate(each))))
    return out, *(rows.get[f"n{k}"] for k in range(len(each)))


#: Bytes of an Arrow batch, about, where the session says nothing: Spark's own 64 MB are held several times over by JVM and Python.
BATCH_BYTES = "4MB"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES in this session from now on, unless spark.sql.execution.arrow.maxBytesPerBatch is set."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches that are bounded in bytes, however long texts are."""
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def only_ids(df: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 1_000_000, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is in ids, or is not with how="left_anti". The ids are broadcast if there are
    at most broadcast_rows of them (16 MB); beyond that both sides are shuffled on the key."""
    return among(df, *counted(ids.select(key).distinct()), key, broadcast_rows, how)


def among(df: DataFrame, ids: DataFrame, n: int, key: str, broadcast_rows: int = 1_000_000, how: str = "left_semi") -> DataFrame:
    """only_ids where the n ids are a written table; how="inner" adds its other columns."""
    return df.join(F.broadcast(ids) if n <= broadcast_rows else ids.hint("merge"), key, how)


# ---- hashes of words and of word shingles, over whole Arrow columns ----------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_SLICE = 1 << 18
#: Bytes of a range that are hashed with array operations; what follows in a longer one is hashed by itself.
_LONG = 64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def byte_class(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


ASCII_SPACE = byte_class(b" \t\n\v\f\r")
#: Letters, digits and everything outside ASCII.
ASCII_WORD = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Letters and everything outside ASCII.
ASCII_LETTER = byte_class(bytes(b for b in range(128) if not chr(b).isalpha()))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offset of every row; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_ranges(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where all words start and end, and for every row the number of the words before it."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = in_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = inside[inner]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = inner[inner > 0] - 1
    last[inner] = inside[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII case folded) in order, and for every row the number of the words before it."""
    starts, ends, counts = word_ranges(data, offsets, in_word)
    return range_hashes(_FOLD[data], starts, ends), counts


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _FOLD[data]


def _eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from it on as one number, as if zeros followed the last."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes. The length, then eight bytes at a time are mixed into what came
    before, so ranges of up to eight bytes and of one length never share a hash. What follows _LONG bytes counts by its XXH3."""
    size, at = ends - starts, _eights(data)
    out = mixed(size.astype(np.uint64) * _STEP + _STEP)
    live, done = np.arange(len(starts)), 0
    while len(live) and done < _LONG:
        left = size[live] - done
        eight = at[starts[live] + done] & _FIRST[np.minimum(left, 8)]
        out[live] = mixed(out[live] ^ eight)
        done += 8
        live = live[left > 8]
    for i in live.tolist():
        rest = xxhash.xxh3_64_intdigest(data[starts[i] + done : ends[i]])
        out[i] = mixed(out[i : i + 1] ^ np.uint64(rest))[0]
    return out


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each range's bytes among the different ones in order of appearance, and the first range of each.
    Hashes bring equal ranges together; their bytes are compared, and where any differ, bytes alone decide."""
    codes, names = pd.factorize(range_hashes(data, starts, ends))
    first = np.zeros(len(names), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if not _same_bytes(data, starts, ends, first[codes]):
        codes, names = pd.factorize(np.array([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))
        first = np.zeros(len(names), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def _same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each range has the bytes of the range that other names for it."""
    live = np.flatnonzero(other != np.arange(len(other)))
    a, b, size = starts[live], starts[other[live]], (ends - starts)[live]
    if not np.array_equal(size, (ends - starts)[other[live]]):
        return False
    at, done = _eights(data), 0
    while len(a) and done < _LONG:
        if ((at[a + done] ^ at[b + done]) & _FIRST[np.minimum(size - done, 8)]).any():
            return False
        done += 8
        keep = size > done
        a, b, size = a[keep], b[keep], size[keep]
    return all(np.array_equal(data[x : x + n], data[y : y + n]) for x, y, n in zip(a.tolist(), b.tolist(), size.tolist(), strict=True))


def row_slices(offsets: np.ndarray, size: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes each; a longer row is alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(to, rows)
        row = min(to, rows)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words within a row, and the row of each. With short, a row of
    1 to width - 1 words gives its whole sequence as one shingle."""
    total, rows = len(words), len(counts) - 1
    size = np.diff(counts)
    row = np.repeat(np.arange(rows), size)
    if total >= width:
        span = total - width + 1
        out = np.zeros(span, np.uint64)
        for j in range(width):
            out += words[j : j + span] * _PLACE[j]
        keep = row[:span] == row[width - 1 :]
        hashes, of = mixed(out[keep]), row[:span][keep]
    else:
        hashes, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short and (few := np.flatnonzero((size > 0) & (size < width))).size:
        more = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            has = size[few] > j
            more[has] += words[counts[few[has]] + j] * _PLACE[j]
        more = mixed(more + size[few].astype(np.uint64) * _PLACE[15])
        hashes, of = np.concatenate([hashes, more]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    return hashes, of


def run_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words within a row, and the row of each, as shingle_hashes names a row of so few words."""
    span = max(len(words) - width + 1, 0)
    out = np.full(span, np.uint64(width) * _PLACE[15])
    for j in range(width):
        out += words[j : j + span] * _PLACE[j]
    row = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    keep = row[:span] == row[width - 1 :][:span]
    return mixed(out[keep]), row[:span][keep]


def row_sets(hashes: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending, and the offsets of the rows in them."""
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[keep], of[keep]
    return hashes, np.searchsorted(of, np.arange(rows + 1))


#: Edges that a task brings together at once: those that a batch of BATCH_BYTES holds.
TREE_EDGES = 1 << 18


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the edges (u, v), and the smallest that they reach from it."""
    names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    least = np.arange(len(names))
    while len(a):
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(least, up := least[least]):
            least = up
        a, b = least[a], least[b]
        a, b = a[a != b], b[a != b]
    return names, names[least]


def _trees(edges: DataFrame) -> DataFrame:
    """Edges (u, v) between the same vertices and components: of each partition, or TREE_EDGES of one at a time, those from every vertex to
    the smallest that they reach, itself included."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return least_reached(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), ()))))

        def batch_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            held.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
            rows += batch.num_rows
            if rows >= TREE_EDGES:
                held = [joined()]
                rows = len(held[0][0])
                if rows > TREE_EDGES // 2:
                    yield batch_of(*held[0])
                    held, rows = [], 0
        yield batch_of(*joined())

    return map_arrow(edges, grow, "u long, v long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: (vertex, label), where label is the smallest vertex that links reach. Every round is written to the shared folder.

    Every task grows the trees of the edges that it reads. These are edges again, and as few; once they are no more than one task
    brings together at once, it does, and until then a large-star and a small-star step bring edges of different tasks together.
    """
    now, n = counted(_trees(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")))
    while n > TREE_EDGES:
        each = now.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("high"))
        vertices, loose = each.agg(F.count("*"), F.count_if(F.expr("v <> high"))).first()
        if not loose:
            now = now if n == vertices else written(each)
            break
        now, n = counted(_trees(_stepped(now)))
    else:
        now = written(_trees(now.coalesce(1)))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("label"))


def _stepped(now: DataFrame) -> DataFrame:
    """The edges after a large-star and a small-star step."""
    both = now.where("u <> v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # large star: neighbours above u link to the smallest neighbour of u, or to u
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # small star: u and its neighbours below link to the smallest of those
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
