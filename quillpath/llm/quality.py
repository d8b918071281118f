"""Quality classifier: nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpath.llm.common import ASCII_SPACE, map_arrow, row_slices, small_batches, utf8, word_hashes

#: Hashed byte trigrams.
TRIGRAMS = 4096
#: Shares of words equal to the word before, each a term of a document that reaches it, and their weight.
REPEATS, REPEAT_WEIGHT = (0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8), 0.4
FEATURES = TRIGRAMS + len(REPEATS)
DIMENSIONS = 48
#: Labelled documents that the model is fitted on and holds as neighbours, at most. This bounds the
#: broadcast (FEATURES + SAMPLE vectors of DIMENSIONS floats) whatever the corpus.
SAMPLE = 4096
NEIGHBOURS = 15
#: Rows whose products with all neighbours are computed at once.
BLOCK = 128


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row, over its whole text: log(1 + count) of the hashed byte trigrams, then the repeat terms (rows, FEATURES)."""
    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES), np.float32)
    words, before = word_hashes(data, offsets, ASCII_SPACE)
    size = np.diff(before)
    of = np.repeat(np.arange(rows), size)
    same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    share = np.bincount(of[1:][same], minlength=rows) / np.maximum(size, 1)
    out[:, TRIGRAMS:] = share[:, None] >= np.array(REPEATS)
    if len(data) < 3:
        return out
    x = data.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h >>= np.uint32(32 - 12)
    of = np.repeat(np.arange(rows), np.diff(offsets))
    keep = of[:-2] == of[2:]
    cell = of[:-2][keep] * TRIGRAMS + h[keep]
    out[:, :TRIGRAMS] = np.log1p(np.bincount(cell, minlength=rows * TRIGRAMS).reshape(rows, TRIGRAMS))
    return out


def packed(row: np.ndarray) -> bytes:
    """A row of counts as half floats, deflated, as most are 0: the driver gets all labelled rows at once."""
    return zlib.compress(row.astype(np.float16).tobytes(), 1)


def unpacked(row: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(row), np.float16)


def _counted(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = utf8(column)
    for a, b in row_slices(offsets):
        for c in range(a, b, BLOCK):
            d = min(c + BLOCK, b)
            yield c, term_counts(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])


def fit(counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Inverse document frequencies, the leading right singular vectors by randomised iteration, and the labelled rows'
    vectors. counts are half floats, which are widened by blocks of rows."""
    blocks = [counts[a : a + BLOCK] for a in range(0, len(counts), BLOCK)]
    found = sum((b > 0).sum(axis=0, dtype=np.float64) for b in blocks)
    idf = np.log((1 + len(counts)) / (1 + found)).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(7))
    basis = rng.standard_normal((FEATURES, DIMENSIONS + 16)).astype(np.float32)
    for _ in range(4):
        rows = (weighted(b.astype(np.float32), idf) for b in blocks)
        basis, _ = np.linalg.qr(sum(r.T @ (r @ basis) for r in rows))
    _, _, right = np.linalg.svd(np.concatenate([weighted(b.astype(np.float32), idf) @ basis for b in blocks]), full_matrices=False)
    axes = (basis @ right.T[:, :DIMENSIONS]).astype(np.float32)
    model = {"idf": idf, "axes": axes, "labels": labels.astype(np.float32), "prior": np.float32(labels.mean() if len(labels) else 0.5)}
    return model | {"vectors": np.concatenate([vectors(b.astype(np.float32), model) for b in blocks])}


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf rows of the trigrams, followed by the weighted repeat terms."""
    rows = counts * idf
    rows[:, :TRIGRAMS] /= np.maximum(np.linalg.norm(rows[:, :TRIGRAMS], axis=1, keepdims=True), 1e-9)
    rows[:, TRIGRAMS:] = counts[:, TRIGRAMS:] * REPEAT_WEIGHT
    return rows


def vectors(counts: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    v = weighted(counts, model["idf"]) @ model["axes"]
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def vote(v: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """The mean label of the nearest neighbours by exact cosine, each weighted by the fourth power of its similarity."""
    known, labels, prior = model["vectors"], model["labels"], float(model["prior"])
    k = min(NEIGHBOURS, len(known))
    if not k:
        return np.full(len(v), prior)
    near = v @ known.T
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** 4
    total = weight.sum(axis=1)
    score = (weight * labels[best]).sum(axis=1) / np.maximum(total, 1e-12)
    return np.clip(np.where(total > 1e-12, score, prior), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model from at most `sample` labelled documents that are not held out: those of the least
    hash of doc_id; of rows that share one the least text. They are counted in tasks; the driver gets FEATURES counts of each."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, counts in _counted(batch["text"]):
                small = [packed(row) for row in counts]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, len(small)), batch["quality"].slice(a, len(small)), pa.array(small, pa.binary())], ["doc_id", "quality", "counts"])

    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = map_arrow(rows, count, "doc_id long, quality int, counts binary").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return {"idf": np.zeros(FEATURES, np.float32), "axes": np.zeros((FEATURES, DIMENSIONS), np.float32), "labels": np.zeros(0, np.float32), "prior": np.float32(0.5), "vectors": np.zeros((0, DIMENSIONS), np.float32)}
    counts = np.empty((rows.num_rows, FEATURES), np.float16)
    for row, r in zip(counts, rows["counts"], strict=True):
        row[:] = unpacked(r.as_py())
    known_labels = rows["quality"].to_numpy().copy()
    del rows
    pa.default_memory_pool().release_unused()
    return fit(counts, known_labels)


def scored(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """All columns of documents and score (0 to 1, higher where label 1 is likelier), predicted (1 if
    score >= threshold).

    Every whole text is turned into tf-idf weights of hashed byte trigrams and projected on the latent
    axes; its cosine with every labelled vector is computed in blocks. Null and empty texts, and all
    texts if there are no labels, have the share of label 1 (0.5 without labels). Equal texts have
    equal scores; repeated rows stay; columns named score or predicted are replaced.
    """
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(trained(documents, labels, sample))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        scores = [vote(vectors(counts, held.value), held.value) for _, counts in _counted(text)]
        return pa.array(np.concatenate(scores).astype(np.float64) if scores else np.zeros(0))

    # only texts go to Python and only scores come back; the other columns wait in Spark
    return documents.drop("score", "predicted").withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
