"""MinHash near-duplicates by an inverted join over signature coordinates.

A set's signature has the least of its shingles under each of COORDINATES random orders. Every pair of a coordinate
and its value names a posting list of the sets that have it there, and two sets collide in as many lists as
coordinates agree. Sets that reach the threshold collide in least_matches() lists or more but for a stated chance.
Lists are ordered by their length: what collides so often must already meet in the first few lists of each set,
its rarest ones (prefix), so the long lists are skipped; collisions of pairs that meet are counted in the whole
signatures, and those over the match threshold are verified by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpath.llm.common import ASCII_SPACE, among, counted, map_arrow, mixed, written
from quillpath.llm.decontam import sets_of
from quillpath.llm.ngram_join import BROADCAST_KEYS, _linked, _near, _sketches, classed, close, oracle, set_ids, whole_sets

#: Coordinates of a signature, and the chance with which a pair just at the threshold may collide too seldom.
COORDINATES, MISS = 80, 1e-9
_RNG = np.random.Generator(np.random.PCG64(80_1997))
_ORDERS = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_NAMES = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64)


def least_matches(threshold: Fraction, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of collisions that a pair at the threshold falls short of with at most the chance miss.
    Each coordinate agrees with the chance of the pair's similarity, so collisions are binomial."""
    t, below = float(threshold), 0.0
    for m in range(coordinates + 1):
        below += comb(coordinates, m) * t**m * (1 - t) ** (coordinates - m)
        if below > miss:
            return m
    return coordinates


def signature(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the posting lists of each row's coordinates: rows by COORDINATES. Rows without shingles are left out."""
    there = at[:-1][np.diff(at) > 0]
    out = np.empty((len(there), COORDINATES), np.uint64)
    if len(there):
        for k in range(COORDINATES):
            out[:, k] = mixed(np.minimum.reduceat(hashes * _ORDERS[k], there) ^ _NAMES[k])
    return out


def signed_rows(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, sid and lists of every row; lists are null without shingles, and where the task has given the set before."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, hashes, at in sets_of(batch["text"], width, ASCII_SPACE, True):
                size, sid = np.diff(at), set_ids(hashes, at)
                new = np.array([n > 0 and not (s in seen or seen.add(s)) for s, n in zip(sid.tolist(), size.tolist(), strict=True)], bool)
                own = signature(hashes[np.repeat(new, size)], np.concatenate([[0], np.cumsum(size[new])]))
                bounds = np.concatenate([[0], np.cumsum(np.where(new, COORDINATES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(own.ravel().view(np.int64)), mask=pa.array(~new))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, len(size)), pa.array(size), pa.array(sid.view(np.int64)), lists], ["doc_id", "n_shingles", "sid", "lists"])

    return map_arrow(documents.select("doc_id", "text"), sign, "doc_id long, n_shingles long, sid long, lists array<long>")


def posted(signatures: DataFrame, matches: int) -> DataFrame:
    """key, sid, size, score: the postings in the prefix of each set that has `matches` lists with others.

    Lists of one set are dropped: they are the shortest, and so the first places of a prefix. The others are ordered
    by length and name, the same order for all sets. Two sets with `matches` lists in common have one within the first
    COORDINATES - matches + 1 of each. score is how many sets a set meets over all its lists, the skipped ones too.
    """
    posts = signatures.select("sid", "size", F.explode("lists").alias("key"))
    lengths = written(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    mine = posts.join(lengths, "key").groupBy("sid").agg(F.max("size").alias("size"), F.sum("n").alias("score"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists"))
    enough = mine.where(F.size("lists") >= matches)
    prefix = F.slice("lists", 1, F.size("lists") - matches + 1)
    return enough.select("sid", "size", "score", F.explode(F.transform(prefix, lambda x: x["key"])).alias("key"))


def near_duplicates(documents: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id, component_size, kept: classes of documents that links of at least
    `threshold` Jaccard similarity of their distinct shingles of `width` words connect.

    Words are runs of anything but ASCII white space, with A-Z folded. A document of fewer words than
    width has one shingle of all; null and empty texts have none and are alone. Equal sets are one
    vertex. Within a posting list sets are first held against one of it, then across
    the components that are left (as in the n-gram join), so a group of near copies never gives all its pairs. A link is missed with a chance under MISS.
    kept is whether doc_id is component_id, and so true of every repeated row of that doc_id. Rows without doc_id link as others do; a component's id is the
    smallest doc_id that is there; where there is none it is null, and such rows are kept. An empty table gives no rows; other columns are left out.
    """
    matches = least_matches(threshold)
    docs = documents.select("doc_id", "text")
    rows = written(signed_rows(docs, width))
    signed = rows.select("doc_id", "n_shingles", "sid")
    signatures = written(rows.where("lists is not null").select("sid", F.col("n_shingles").cast("int").alias("size"), "lists").dropDuplicates(["sid"]))
    posts = written(posted(signatures, matches))
    keys = counted(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    shared = written(among(posts, *keys, "key", BROADCAST_KEYS).withColumn("own", F.lit(True)))
    sets = whole_sets(docs, signed, shared.select("sid").distinct(), width)
    # a bound by parities of whole sets, collisions in whole signatures, whole sets
    sketches = written(_sketches(sets, signature))
    linked = lambda pairs: _linked(_near(pairs, sketches, threshold, matches), sets, threshold)
    found = classed(signed, shared, linked, linked, sketches.select("sid", "sketch"), close(threshold), threshold)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: op12 in SQL over all pairs that share a shingle.
ORACLE_SQL = f"select *, doc_id = component_id as kept from ({oracle(80)})"
