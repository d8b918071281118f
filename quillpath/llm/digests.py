"""Canonical exact digests of documents, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpath.llm.common import only_ids, written

_ICU = "com.ibm.icu"


def canonical(text: Column) -> Column:
    """text in compatibility composition with full case folding, runs of white space as one space, trimmed."""
    composed = F.reflect(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit(f"{_ICU}.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, r"(?U)[\s\p{Z}]+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits in hexadecimal digits: two xxhash64 of the bytes, the second from another seed."""
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (F.xxhash64(text), F.xxhash64(F.lit("second"), text)))))


def _bucket(df: DataFrame, key: str, buckets: int) -> Column:
    """The number of the quantile range of key; nulls have -1. Bounds are kept in groups, so that a
    row is held against about twice the square root of their number."""
    bounds = sorted({int(x) for x in df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    heads = F.array(*(F.lit(g[-1]) for g in groups))
    inner = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    group = F.size(F.filter(heads, lambda b: F.col(key) > b))
    return F.when(F.col(key).isNull(), -1).otherwise(group * (step + 1) + F.coalesce(F.size(F.filter(F.get(inner, group), lambda b: F.col(key) > b)), F.lit(0)))


def with_next(docs: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """docs with the value of the next row in descending order of key; the last row has the first one's.

    Rows are dealt into quantile ranges of key; to each range comes a copy of the row that follows
    it, so that no window spans more than a range. Equal keys are ordered by value. Rows with a
    null key are ordered by value among themselves, and the last of them has an empty next.
    """
    spark = docs.sparkSession
    buckets = min(65536, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("_bucket", _bucket(docs, key, buckets))
    top = sorted((r[0], r[1]) for r in docs.where(F.col(key).isNotNull()).groupBy("_bucket").agg(F.max(key)).collect())
    follows = [(bucket, top[i - 1][1]) for i, (bucket, _) in enumerate(top)]
    kind = docs.schema[key].dataType.simpleString()
    extra = spark.createDataFrame(follows, f"_to int, {key} {kind}")
    copies = docs.join(F.broadcast(extra), key).withColumn("_bucket", F.col("_to")).drop("_to").withColumn("_copy", F.lit(1))
    both = docs.withColumn("_copy", F.lit(0)).unionByName(copies)
    # the copy of the first row stands after all others even where its key is the highest
    order = Window.partitionBy("_bucket").orderBy("_copy", F.desc_nulls_last(key), value)
    return both.withColumn(out, F.coalesce(F.lead(value).over(order), F.lit(""))).where("_copy = 0").drop("_copy", "_bucket")


def digests(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, copy_of (smallest doc_id of the same canonical text), copies (how many have it).

    The edited text has its last third replaced by the beginning of the next document in descending
    doc_id. A fingerprint is the wide hash of the canonical text; where texts of different bytes
    meet in one hash, the SHA-256 of the canonical text follows it. As the digest is exact, likeness
    is 1 for equal canonical bytes and 0 otherwise. Null texts are empty. Repeated rows each give
    a row; an empty table gives none; other columns are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next", F.lit(1), third))
    rows = (
        with_next(docs, "doc_id", "text", "next")
        .select("doc_id", "text", "next", edited.alias("edited"))
        .select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(canonical(F.col(c)).alias(c) for c in ("text", "edited", "next")))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            wide_hash(F.col("text")).alias("fingerprint"),
            wide_hash(F.col("edited")).alias("edited_fingerprint"),
            F.sha2(F.col("text").cast("binary"), 256).alias("_own"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("_edited"),
            (F.col("text") == F.col("edited")).cast("double").alias("near_edited"),
            (F.col("text") == F.col("next")).cast("double").alias("near_next"),
        )
    )
    rows = written(rows)
    # written, so that the join below has plain shuffles on both sides and a hot fingerprint can be split
    buckets = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies")).where("copies > 1"))
    texts = docs.select("doc_id", canonical(F.col("text")).alias("text")).withColumn("fingerprint", wide_hash(F.col("text")))
    mixed = only_ids(texts, buckets, "fingerprint").groupBy("fingerprint").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("fingerprint")
    mixed = written(mixed)
    if not mixed.isEmpty():  # of 128 bits, hardly ever
        clash = mixed.withColumn("_clash", F.lit(True))
        for own, hash_ in (("_own", "fingerprint"), ("_edited", "edited_fingerprint")):
            rows = rows.join(clash.withColumnRenamed("fingerprint", hash_), hash_, "left")
            rows = rows.withColumn(hash_, F.when(F.col("_clash"), F.concat(hash_, F.lit("-"), own)).otherwise(F.col(hash_))).drop("_clash")
        buckets = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(buckets, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )
