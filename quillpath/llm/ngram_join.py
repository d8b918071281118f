"""N-gram Jaccard self-join by parity sketches.

Every set of shingles has a sketch of bits in which each shingle flips one, so the Hamming distance
of two sketches is at most the size of their symmetric difference. A sketch is cut into pieces, a few
more than the largest difference that the threshold allows in its band of sizes, so that linked sets
agree on whole pieces, and equal pieces bring candidates together. Pieces have 2**32 bits and are kept
by the numbers of the bits set, of which one 64-bit name is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpath.llm.common import ASCII_SPACE, among, components, counted, map_arrow, mixed, written
from quillpath.llm.decontam import sets_of

#: Pieces beyond the largest difference, at least. Linked sets agree on as many as there are beyond it: a set that
#: agrees with others on fewer has no links.
SPARE = 8
#: Rows of a bucket up to which its pairs are joined; in larger ones whole sketches are compared first, in blocks.
FEW, BLOCK = 48, 2048
#: Pairs to verify that may be broadcast (16 bytes each), so that the first sets of the pairs are moved once.
BROADCAST_PAIRS = 1_000_000
#: Keys of buckets that are broadcast (8 bytes each).
BROADCAST_KEYS = 100_000
#: By how much more pairs of a large bucket are tried in each round.
FORESTS = 64
#: Bits of a whole sketch that is compared in blocks.
BITS = 2048
#: Sets of one key in a batch from which on most of them are dealt into PARTS parts.
CROWD, PARTS = 8, 1024


@lru_cache(maxsize=4)
def bands(threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper bounds of the size bands, the pieces of each, and how many of them linked sets agree on.
    Linked sets are in one band or in neighbours.

    Sets agree by chance on pieces without bits only, so these are not used, but count among those agreed on. In
    proportion to the largest difference there are therefore more pieces than the smallest sets of the
    band before are likely to leave without bits. (For thresholds under about 0.7 no number is enough; see _pieces.)
    """
    high, low = [], 1
    while low < 2**31:
        high.append(int(low / threshold))
        low = high[-1] + 1
    # difference <= (1 - t) * union and union = (a + b + difference) / 2
    share = (1 - threshold) / (1 + threshold)
    full, more = float(threshold**2 / (2 * share)), 0.0
    for _ in range(50):
        more = min(0.25, 1.25 * (1 + more) * float(np.exp(-full / (1 + more))))
    differ = [int(share * 2 * h) for h in high]
    spare = [SPARE + int(more * d) for d in differ]
    return np.array(high), np.array([d + s for d, s in zip(differ, spare, strict=True)]), np.array(spare)


def set_ids(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
    size = np.diff(at)
    return np.where(size > 0, mixed(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64)), np.uint64(0))


def _pieces(hashes: np.ndarray, at: np.ndarray, band: np.ndarray, count: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the pieces of the sketches that row r has for the join of band[r], with count[r] pieces,
    their rows, and on how many of its named pieces each row must agree with a linked one.

    hashes ascend in each row, and a shingle's piece follows its upper bits, so pieces lie one after another.
    Linked sets agree on spare[r] pieces, some of which may have no bits. Those are named only in rows that have spare[r] or more of them.
    """
    rows = len(at) - 1
    of = np.repeat(np.arange(rows), np.diff(at))
    piece = ((hashes >> np.uint64(32)) * count[of].astype(np.uint64)) >> np.uint64(32)
    first = np.ones(len(hashes), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(first)
    bit = mixed(hashes) & np.uint64(0xFFFFFFFF)
    value = np.bitwise_xor.reduceat(mixed(bit + np.uint64(1)), starts) if len(starts) else np.zeros(0, np.uint64)
    row, number = of[starts], piece[starts]
    empty = count - np.bincount(row, minlength=rows)
    need = np.where(empty >= spare, 1, spare - empty)  # the other one may have up to spare - 1 pieces without bits, unnamed
    for r in np.flatnonzero((empty >= spare) & (np.diff(at) > 0)):
        none = np.setdiff1d(np.arange(count[r], dtype=np.uint64), number[row == r])
        row, number, value = np.concatenate([row, np.full(len(none), r)]), np.concatenate([number, none]), np.concatenate([value, np.zeros(len(none), np.uint64)])
    return mixed(value + mixed((band[row].astype(np.uint64) << np.uint64(32)) + number)), row, need


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, sid of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, hashes, at in sets_of(batch["text"], width, ASCII_SPACE, True):
                rows = len(at) - 1
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, rows), pa.array(np.diff(at)), pa.array(set_ids(hashes, at).view(np.int64))], ["doc_id", "n_shingles", "sid"])

    return map_arrow(documents.select("doc_id", "text"), sign, "doc_id long, n_shingles long, sid long")


def _piece_rows(documents: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """key, sid, size, need, own, part: the pieces of the sketch for a set's own band and of that for the next
    one, where larger partners are. A task gives a set once, however many copies it meets.

    Where a batch has a key for more than CROWD sets, and so knows that they meet, two of them (one in its own
    band) stand for all under part 0, and the others get parts above it by their sid. So a key
    that a large share of all sets has never lies in one task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, count, spare = bands(threshold)
        seen: set[int] = set()
        for batch in batches:
            made: list[list[np.ndarray]] = []
            for _, hashes, at in sets_of(batch["text"], width, ASCII_SPACE, True):
                sid = set_ids(hashes, at)
                new = np.array([not (s in seen or seen.add(s)) for s in sid.tolist()], bool)
                size = np.where(new, np.diff(at), 0)
                hashes = hashes[np.repeat(new, np.diff(at))]
                at = np.concatenate([[0], np.cumsum(size)])
                band = np.searchsorted(high, size)
                for own in (True, False):
                    key, row, need = _pieces(hashes, at, band + (not own), count[band + (not own)], spare[band + (not own)])
                    made.append([key, sid[row], size[row].astype(np.int32), need[row].astype(np.int32), np.full(len(row), own)])
            if not made:
                continue
            key, sid, size, need, own = (np.concatenate(x) for x in zip(*made, strict=True))
            part = np.zeros(len(key), np.int16)
            codes, _ = pd.factorize(key)
            crowded = np.flatnonzero(np.bincount(codes)[codes] > CROWD)
            crowded = crowded[np.lexsort((~own[crowded], codes[crowded]))]
            place = np.arange(len(crowded)) - np.searchsorted(codes[crowded], codes[crowded])
            sure = own[crowded[np.searchsorted(codes[crowded], codes[crowded])]] & (place >= 2)
            part[crowded[sure]] = 1 + (sid[crowded[sure]] % np.uint64(PARTS)).astype(np.int16)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (key.view(np.int64), sid.view(np.int64), size, need, own, part))), ["key", "sid", "size", "need", "own", "part"])

    return map_arrow(documents.select("text"), rows, "key long, sid long, size int, need int, own boolean, part short")


def _sets(documents: DataFrame, width: int) -> DataFrame:
    """sid, shingles array<long>."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, at in sets_of(batch["text"], width, ASCII_SPACE, True):
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(hashes, at).view(np.int64)), pa.LargeListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))], ["sid", "shingles"])

    return map_arrow(documents.select("text"), rows, "sid long, shingles array<long>")


def _both(rows: DataFrame, pairs: DataFrame, n: int, left: dict[str, str], right: dict[str, str]) -> DataFrame:
    """The n pairs (u, v), as written, with the columns `left` of rows (by sid) for u and `right` for v, under new names. Few pairs are broadcast, so
    that only what they name is moved; else rows are shuffled."""
    hinted = F.broadcast if n <= BROADCAST_PAIRS else lambda df: df.hint("merge")
    u = rows.select(F.col("sid").alias("u"), *(F.col(c).alias(new) for c, new in left.items())).join(hinted(pairs), "u")
    v = rows.select(F.col("sid").alias("v"), *(F.col(c).alias(new) for c, new in right.items())).join(hinted(pairs.select("v")), "v", "left_semi")
    return u.join(v, "v")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> tuple[DataFrame, int]:
    """The pairs (u, v) that reach the threshold, by their whole sets, written, and their number."""
    pairs, n = counted(pairs)
    if not n:
        return pairs, 0
    both = F.size(F.array_intersect("a", "b"))
    met = _both(sets, pairs, n, {"shingles": "a"}, {"shingles": "b"}).select("u", "v", both.alias("both"), (F.size("a") + F.size("b") - both).alias("either"))
    return counted(met.where(F.col("both").cast("long") * threshold.denominator >= F.col("either").cast("long") * threshold.numerator).select("u", "v"))


def _open(rows: DataFrame, by: str) -> DataFrame:
    """Rows of the buckets that have rows of several values of `by`, one of them in its own band, and rows, the number of those in the bucket."""
    keys = rows.groupBy("key").agg(F.min(by).alias("low"), F.max(by).alias("high"), F.max("own").alias("owned"), F.count("*").alias("rows")).where("low <> high and owned")
    return among(rows, *counted(keys.select("key", "rows")), "key", BROADCAST_KEYS, "inner")


def _agreeing(rows: DataFrame) -> DataFrame:
    """Rows of the sets that agree with others on as many pieces of a band as they need to be linked. A set has no more rows than shingles."""
    of = Window.partitionBy("sid", "own")
    return rows.withColumns({"n": F.count("*").over(of), "least": F.max("need").over(of)}).where("n >= least").drop("n", "least")


def _near_sizes(threshold: Fraction, a: str, b: str) -> F.Column:
    return F.least(a, b).cast("long") * threshold.denominator >= F.greatest(a, b).cast("long") * threshold.numerator


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of 64-bit words as the shorter one that the same set has: the exclusive or of its halves, again and again."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _sketches(sets: DataFrame, signature: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """sid, size, fine, sketch, and lists, the signature's numbers where one is given: each shingle flips one bit of fine, which has the power of two of bits from
    the set's size on, BITS at least and 2**24 at most, so that large sets tell apart too; sketch is folded to BITS."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, out, sizes = [], [], []
            for shingles in batch["shingles"]:
                hashes = mixed(shingles.values.to_numpy().view(np.uint64)) >> np.uint64(40)
                bits = min(2**24, max(BITS, 1 << (len(hashes) - 1).bit_length()))
                packed = np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).view(np.uint64)
                fine.append(packed.tobytes())
                out.append(_folded(packed, BITS // 64).tobytes())
                sizes.append(len(hashes))
            columns = [batch["sid"], pa.array(sizes, pa.int32()), pa.array(fine, pa.binary()), pa.array(out, pa.binary())]
            if signature:
                lists = signature(batch["shingles"].flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * lists.shape[1]), pa.array(lists.ravel().view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["sid", "size", "fine", "sketch", "lists"][: len(columns)])

    return map_arrow(sets.select("sid", "shingles"), rows, "sid long, size int, fine binary, sketch binary" + ", lists array<long>" * bool(signature))


def close(threshold: Fraction) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Whether sketches are no further apart than the largest difference of linked sets of their sizes."""
    share = (1 - threshold) / (1 + threshold)
    num, den = share.numerator, share.denominator
    return lambda x, y, total: np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * den <= total * num


def _near(pairs: DataFrame, sketches: DataFrame, threshold: Fraction, matches: int = 0) -> DataFrame:
    """The pairs (u, v) whose fine sketches are no further apart than the largest difference of linked sets of their sizes, and which collide in
    `matches` of their lists or more where that is not 0."""
    pairs, n_pairs = counted(pairs)
    if not n_pairs:
        return pairs
    num, den = (1 - threshold).numerator * (1 + threshold).denominator, (1 - threshold).denominator * (1 + threshold).numerator

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, keep = batch["total"].to_pylist(), []
            for x, y, n in zip(batch["x"], batch["y"], total, strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(dtype=np.int64))
                keep.append(apart * den <= n * num)
            if matches:
                keep = [k and np.count_nonzero(a.values.to_numpy() == b.values.to_numpy()) >= matches for k, a, b in zip(keep, batch["a"], batch["b"], strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    met = _both(sketches, pairs, n_pairs, {"size": "n", "fine": "x"} | ({"lists": "a"} if matches else {}), {"size": "m", "fine": "y"} | ({"lists": "b"} if matches else {}))
    return map_arrow(met.select("u", "v", (F.col("n").cast("long") + F.col("m")).alias("total"), "x", "y", *(["a", "b"] if matches else [])), near, "u long, v long")


def _few_pairs(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (u, v) across components in small buckets of sizes that can be linked."""
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("sid", "size", "own", "label"))) for x in "ab")
    across = a.join(b, "key").where("sid_a < sid_b and label_a <> label_b and (own_a or own_b)").where(_near_sizes(threshold, "size_a", "size_b"))
    return across.select(F.col("sid_a").alias("u"), F.col("sid_b").alias("v")).distinct()


def _forests(codes: np.ndarray, met: Iterator[tuple[int, np.ndarray]], forests: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of rows (x, y), and whether there are more, out of those met (x and all its y): the edges of so many spanning forests over the rows'
    components (codes from 0), one after another from what the ones before left. So they are at most `forests` for each component."""
    trees = [np.arange(codes.max(initial=-1) + 1)]
    u, v, more = [], [], False
    for x, y in met:
        for k in range(forests):
            if not len(y):
                break
            if k == len(trees):
                trees.append(np.arange(len(trees[0])))
            tree = trees[k]
            own, other = tree[codes[x]], tree[codes[y]]
            across = np.flatnonzero(other != own)
            joined, first = np.unique(other[across], return_index=True)
            if len(joined):
                taken = across[first]
                u.append(np.full(len(taken), x))
                v.append(y[taken])
                tree[np.isin(tree, joined)] = own
                y = np.delete(y, taken)
        more |= len(y) > 0
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v]), bool(more)


def _crowds(rows: DataFrame) -> DataFrame:
    """key, sid, size, own, label of large buckets (key, sid, size, own, rows, label), as written, where buckets of much the same sets are one crowd:
    near copies meet in most of their buckets, and in their crowd but once. All pairs of a bucket are pairs of its crowd.

    A bucket follows the largest bucket of most of its sets. Those that follow the same one are a crowd if that has no more pairs than
    they have together (its sets counted about), so that buckets which share few sets stay apart.
    """
    largest = F.max(F.struct("rows", "key")).over(Window.partitionBy("sid"))["key"]
    led = rows.select("key", "rows", largest.alias("lead")).groupBy("key", "rows", "lead").agg(F.count("*").alias("n"))
    follows = written(led.groupBy("key", "rows").agg(F.max_by("lead", F.struct("n", "lead")).alias("crowd")))
    apart = follows.groupBy("crowd").agg(F.sum(F.col("rows") * F.col("rows")).alias("apart"))
    together = rows.select("key", "sid").join(follows.select("key", "crowd"), "key").groupBy("crowd").agg(F.approx_count_distinct("sid").alias("n"))
    fit = together.join(apart, "crowd").where("n * n <= apart").select("crowd", F.xxhash64("crowd").alias("home"))
    homes = written(follows.join(fit, "crowd", "left").select("key", F.coalesce("home", "key").alias("home")))
    return rows.join(homes, "key").groupBy(F.col("home").alias("key"), "sid").agg(*(F.max(c).alias(c) for c in ("size", "own", "label")))


def _many_pairs(rows: DataFrame, sketches: DataFrame, threshold: Fraction, near: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], forests: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (key, u, v, more) across components in large buckets whose sketches (sid, sketch) are near; with forests, of a group's pairs those that
    connect its components so many times over, and more is whether the group has others. near says so of rows of two arrays
    of 64-bit words and the sums of their sets' sizes. The sets outside of a bucket's largest component
    (strays) are dealt into blocks, all sets of the bucket into chunks, and each block meets each
    chunk in one group, so that a group is bounded whatever the bucket's size, and few strays cost little.

    With one forest, a bucket of several blocks gives the pairs inside of its chunks only, which mostly connect what there is, so that few strays are left for
    the pairs between chunks. Second, the keys of such buckets."""
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("all"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"))
    deals = by_label.select("key", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("chunks"), F.greatest(F.ceil((F.col("all") - F.col("most")) / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    deals = written(deals.withColumn("inside", (F.col("blocks") > 1) & F.lit(forests == 1)))
    dealt = written(rows.select("key", "sid", "size", "own", "label").join(deals, "key")).join(sketches, "sid")
    place = lambda n, *seed: F.pmod(F.xxhash64("sid", *seed), F.col(n)).cast("int")
    each = lambda n: F.explode(F.when(F.col("inside"), F.array(place("chunks"))).otherwise(F.sequence(F.lit(0), F.col(n) - 1)))
    columns = ["key", "chunk", "block", "stray", "sid", "size", "own", "label", "sketch"]
    every = dealt.withColumn("chunk", place("chunks")).withColumn("block", each("blocks")).withColumn("stray", F.lit(False))
    strays = dealt.where("label <> main").withColumn("block", F.when(F.col("inside"), place("chunks")).otherwise(place("blocks", F.lit(1)))).withColumn("chunk", each("chunks")).withColumn("stray", F.lit(True))
    t_num, t_den = threshold.numerator, threshold.denominator

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        sketch = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
        sid, size, own, label, stray = (g[c].to_numpy() for c in ("sid", "size", "own", "label", "stray"))
        a, b = np.flatnonzero(stray), np.flatnonzero(~stray)

        def met() -> Iterator[tuple[int, np.ndarray]]:
            for at in range(0, len(a), 32):
                i = a[at : at + 32]
                total = size[i][:, None].astype(np.int64) + size[b][None, :]
                fit = np.minimum(size[i][:, None], size[b][None, :]).astype(np.int64) * t_den >= np.maximum(size[i][:, None], size[b][None, :]).astype(np.int64) * t_num
                fit &= (label[i][:, None] != label[b][None, :]) & (own[i][:, None] | own[b][None, :]) & (sid[i][:, None] != sid[b][None, :])
                x, y = np.nonzero(fit)
                hit = near(sketch[i[x]], sketch[b[y]], total[x, y])
                x, y = x[hit], b[y[hit]]
                # the nearest first, as they are the likeliest to be linked
                apart = np.bitwise_count(sketch[i[x]] ^ sketch[y]).sum(axis=1, dtype=np.int64) / (size[i[x]].astype(np.int64) + size[y])
                order = np.lexsort((apart, x))
                x, y = x[order], y[order]
                yield from zip(i.tolist(), np.split(y, np.searchsorted(x, np.arange(1, len(i)))), strict=True)

        if forests is None:
            found = list(met())
            x, y, more = np.repeat(np.array([i for i, _ in found], np.int64), [len(j) for _, j in found]), np.concatenate([np.zeros(0, np.int64), *(j for _, j in found)]), False
        else:
            x, y, more = _forests(np.unique(label, return_inverse=True)[1], met(), forests)
        return pd.DataFrame({"key": np.full(len(x), g["key"].iloc[0]), "u": np.minimum(sid[x], sid[y]), "v": np.maximum(sid[x], sid[y]), "more": np.full(len(x), more)})

    met = every.select(*columns).unionByName(strays.select(*columns)).groupBy("key", "chunk", "block")
    return met.applyInPandas(compare, "key long, u long, v long, more boolean"), deals.where("inside").select("key")


def _prepared(documents: DataFrame, width: int, threshold: Fraction) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, the pieces of sets that may have links, the whole sets of these, and their sketches."""
    docs = documents.select("doc_id", "text")
    signed = written(signatures(docs, width))
    ordered = Window.partitionBy("key", "part").orderBy("sid")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        _piece_rows(docs, width, threshold)
        .withColumns({"again": F.lag("sid").over(ordered).eqNullSafe(F.col("sid")), "low": F.min("sid").over(whole), "high": F.max("sid").over(whole), "owned": F.max("own").over(whole)})
        .where("(part > 0 or (low <> high and owned)) and not again")
        .select("key", "sid", "size", "need", "own")
    )
    shared = written(_open(_agreeing(written(shared)), "sid").drop("rows"))
    shared = written(_agreeing(shared))
    vertices = shared.select("sid").distinct()
    sets = whole_sets(docs, signed, vertices, width)
    return signed, shared, sets, written(_sketches(sets))


def whole_sets(docs: DataFrame, signed: DataFrame, vertices: DataFrame, width: int) -> DataFrame:
    """sid, shingles of the sets named in vertices, which are different sids, made again from the document with each set's smallest doc_id;
    sets that only rows without doc_id have come from those rows."""
    vertices, n = counted(vertices)
    chosen = among(signed, vertices, n, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    texts = among(docs, *counted(chosen.select("doc_id")), "doc_id").select("text").unionByName(docs.where("doc_id is null").select("text"))
    return written(among(_sets(texts, width), vertices, n, "sid").dropDuplicates(["sid"]))


def similar(documents: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id, component_size: classes of documents that links of at least
    `threshold` Jaccard similarity of their shingles of `width` words connect.

    Words are runs of anything but ASCII white space, with A-Z folded. A document of fewer words than
    width has one shingle of all; null and empty texts have none and are alone. Equal sets are one
    vertex. Every set is first held against the one that agrees with others on most pieces (the original
    of a group of near copies) among the sets that it shares buckets with. Where a bucket still has sets of
    several components, all its pairs across components whose whole sketches are near enough are verified, so that no link that would connect components is left out.
    Repeated rows each give a row; an empty table gives none. Rows without doc_id link as others do; a component's id is the smallest doc_id that is there, or null.
    """
    signed, shared, sets, sketches = _prepared(documents, width, threshold)

    scored = shared.withColumn("score", F.count("*").over(Window.partitionBy("sid")) / F.col("size"))
    verified = lambda pairs: _linked(pairs, sets, threshold)
    return classed(signed, scored, verified, lambda pairs: verified(_near(pairs, sketches, threshold)), sketches.select("sid", "sketch"), close(threshold), threshold)


def _left(shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows of the buckets in which sets of several components meet, with their label and the rows of their bucket, written, their number, and
    that of rows in large buckets."""
    now = shared.join(labels.withColumnRenamed("vertex", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    return counted(_open(written(now), "label"), F.col("rows") > FEW)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (vertex, label) that hold after more links (u, v)."""
    return components(labels.select(F.col("vertex").alias("u"), F.col("label").alias("v")).unionByName(links), "u", "v")


def classed(signed: DataFrame, scored: DataFrame, verified: Callable[[DataFrame], tuple[DataFrame, int]], linked: Callable[[DataFrame], tuple[DataFrame, int]], sketches: DataFrame, near: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], threshold: Fraction) -> DataFrame:
    """doc_id, n_shingles, component_id, component_size from the rows (doc_id, n_shingles, sid), the buckets
    (key, sid, size, own, score) in which linked sets meet, with a score of how much each set agrees with others, verified and linked, which give
    those of the pairs (u, v) that reach the threshold, written, and their number, where most do and where few do, and sketches that near compares in large buckets.

    Each set is held against the one that it meets most often as the best of its buckets; then pairs across the components
    that are left in a bucket are tried. In large buckets these are at first as many as connect its components once; where there are
    more and not all components became one, FORESTS times as many, and so on until a bucket has no others. No pair that would connect components is left out.
    """
    shared = scored.select("key", "sid", "size", "own")
    best = scored.groupBy("key").agg(F.max_by(F.struct(F.col("sid").alias("v"), F.col("size").alias("other")), F.struct("score", -F.col("sid"))).alias("b"))
    met = shared.join(written(best.select("key", "b.*")), "key").where("sid <> v")
    stars = met.where(_near_sizes(threshold, "size", "other")).groupBy(F.col("sid").alias("u"), "v").agg(F.count("*").alias("n"))
    stars = stars.groupBy("u").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    links, _ = verified(stars.select("u", "v"))
    labels = components(links, "u", "v")
    now, rows, crowded = _left(shared, labels)
    if rows:
        large, forests = crowded > 0, 1
        tried, many = _few_pairs(now.where(F.col("rows") <= FEW), threshold), now.where(F.col("rows") > FEW)
        if large:
            many = crowds = written(_crowds(many))
        while large:
            pairs, parts = _many_pairs(many, sketches, threshold, near, forests)
            pairs = written(pairs)
            found = pairs.select("u", "v")
            labels = _merged(labels, linked((found if tried is None else tried.unionByName(found)).distinct())[0])
            again, n = counted(pairs.where("more").select("key").unionByName(parts).distinct())
            many, rows, _ = _left(crowds.drop("label").join(again, "key", "left_semi"), labels) if n else (many, 0, 0)
            tried, forests, large = None, forests * FORESTS, rows > 0
        if tried is not None:
            labels = _merged(labels, linked(tried)[0])

    classed = signed.join(labels.withColumnRenamed("vertex", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    some = classed.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("component_size"))
    many = written(some.where("component_size > 1"))  # so that a hot label's side of the join can be split
    full = classed.join(many, (classed["label"] == many["label"]) & (classed["n_shingles"] > 0), "left")
    return full.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"))


def _class_links(documents: DataFrame, width: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and all links (u, v) between different sets, those inside components too."""
    signed, shared, sets, sketches = _prepared(documents, width, threshold)
    sizes = shared.groupBy("key").agg(F.count("*").alias("rows"))
    now = shared.withColumn("label", F.col("sid")).join(written(sizes), "key")
    many, _ = _many_pairs(written(_crowds(written(now.where(F.col("rows") > FEW)))), sketches.select("sid", "sketch"), threshold, close(threshold))
    tried = _few_pairs(now.where(F.col("rows") <= FEW), threshold).unionByName(many.select("u", "v"))
    return signed, _linked(_near(tried.distinct(), sketches, threshold), sets, threshold)[0]


def _classes(signed: DataFrame) -> DataFrame:
    return signed.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def links(documents: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """a, b, a_copies, b_copies: every link between different sets that reaches the threshold, each by the
    smallest doc_id of its set, with the number of rows that have the set. Words and shingles are as in
    similar. As many rows as links: they grow with the square of a group of near copies."""
    signed, pairs = _class_links(documents, width, threshold)
    classes = _classes(signed)
    u, v = (classes.select(F.col("sid").alias(k), F.struct("doc_id", "copies").alias(f"_{k}")) for k in "uv")
    low, high = F.least("_u", "_v"), F.greatest("_u", "_v")
    return pairs.join(u, "u").join(v, "v").select(low["doc_id"].alias("a"), high["doc_id"].alias("b"), low["copies"].alias("a_copies"), high["copies"].alias("b_copies"))


def link_counts(documents: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_links of every row: how many other rows are linked to it, copies of its own set among them."""
    signed, pairs = _class_links(documents, width, threshold)
    classes = written(_classes(signed))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(classes.select(F.col("sid").alias("v"), "copies"), "v").groupBy(F.col("u").alias("sid")).agg(F.sum("copies").alias("n"))
    each = classes.select("sid", "copies").join(near, "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return signed.join(each, "sid", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


#: op6 in SQL over all pairs that share a shingle, with its threshold in hundredths to be filled in.
_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, s from (
    select doc_id, array_to_string(w[i:i+3], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from d where len(w) >= 4)
    union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 3)),
n as (select doc_id, count(*) as n from s group by doc_id),
-- copies of a set are one vertex
h as (select doc_id, md5(string_agg(s, chr(10) order by s)) as g from s group by doc_id),
r as (select g, min(doc_id) as rep from h group by g),
rs as (select doc_id, s from s where doc_id in (select rep from r)),
i as (select a.doc_id as a, b.doc_id as b, count(*) as m from rs a join rs b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * m >= {hundredths} * (na.n + nb.n - m)),
e as (select a, b from l union select b, a from l),
c(v, o) as (select rep, rep from r union select e.b, c.o from c join e on e.a = c.v),
m as (select v, min(o) as c from c group by v)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.c, d.doc_id) as component_id, case when m.c is null then 1 else count(*) over (partition by m.c) end as component_size
from d left join n using (doc_id) left join h using (doc_id) left join r using (g) left join m on m.v = r.rep
"""


def oracle(hundredths: int) -> str:
    """SQL of similar for shingles of four words."""
    return _SQL.replace("{hundredths}", str(hundredths))
