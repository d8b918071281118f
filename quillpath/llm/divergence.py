"""Source divergence audit: which terms, and which other sources, a source of a language differs from most.

Terms are counted once per language and source. What a term contributes to a group depends on its count there
and on its share in the language, so terms of a group fall into buckets by count, and the least share in
the language that a bucket has bounds all its values. Buckets are evaluated from the highest bound down until
the bounds of the others are below the value of the last rank. Pairs of sources come from postings: terms that
both have are met in the postings of the term, all else follows from how often each count occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpath.llm.common import ASCII_LETTER, distinct_ranges, folded, map_arrow, row_slices, utf8, word_ranges, written
from quillpath.llm.manifest import indexed

#: Documents of a language that a term must be in to be kept, and ranks of the term part.
LEAST_DOCUMENTS, RANKS = 3, 200
#: A share of one, in units.
UNITS = 1_000_000_000
#: Counts of (group, term) that a task holds before it gives them away.
HELD = 1_000_000
#: Sources of a language whose postings of a term lie in one row.
BLOCK = 1024
#: Pairs of postings that are evaluated at once.
PAIRS = 1_000_000
#: Groups (lang, source) that may be broadcast, about 100 bytes each.
FEW = 100_000


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term, in parts for each task. Terms are runs of ASCII
    letters, with A-Z folded, and characters outside ASCII. Null texts, languages and sources are empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        terms: dict[bytes, int] = {}
        key, n, docs = (np.zeros(0, np.int64) for _ in range(3))

        def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            key, n, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            return key[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (n, docs))

        def given() -> pa.RecordBatch:
            names, words = list(groups), pa.array([t.decode() for t in terms], pa.string())
            group, term = key >> 32, pa.array(key & 0xFFFFFFFF)
            lang, source = (pa.array([g[k] for g in names], pa.string()).take(pa.array(group)) for k in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, words.take(term), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            data, offsets = utf8(batch["text"])
            pairs = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True))
            of = np.array([groups.setdefault((lang or "", source or ""), len(groups)) for lang, source in pairs], np.int64)
            for a, b in row_slices(offsets, 1 << 20):
                part = folded(data[offsets[a] : offsets[b]])
                starts, ends, before = word_ranges(part, offsets[a : b + 1] - offsets[a], ASCII_LETTER)
                if not len(starts):
                    continue
                codes, first = distinct_ranges(part, starts, ends)
                text = part.tobytes()
                ids = np.array([terms.setdefault(text[x:y], len(terms)) for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)
                row = np.repeat(np.arange(b - a), np.diff(before))
                found, times = np.unique(row * len(first) + codes, return_counts=True)
                row, code = np.divmod(found, len(first))
                key, n, docs = merged([(key, n, docs), (of[a + row] << 32 | ids[code], times, np.ones(len(found), np.int64))])
                if len(key) > HELD or len(terms) > HELD:
                    yield given()
                    groups, terms, (key, n, docs) = {}, {}, (np.zeros(0, np.int64) for _ in range(3))
                    of = np.array([groups.setdefault((lang or "", source or ""), len(groups)) for lang, source in pairs], np.int64)
        if len(key):
            yield given()

    return map_arrow(documents.select("lang", "source", "text"), count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNITS * (count + 1) / total), in whole numbers of 64 bits for totals up to 2.9e14: UNITS is 31250 * 32000."""
    high = F.lit(31250) * (count + 1)
    return F.lit(1) + F.call_function("div", high, total) * 32000 + F.call_function("div", (high % total) * 32000, total)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _beside(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """rows with what groups has for them: broadcast if it is small."""
    few = groups.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(groups) if few else groups.hint("merge"), on)


def _ranked(df: DataFrame, value: str, item: str) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc(value), F.asc(item)))


def top_terms(postings: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """lang, source, term, value, rank: the terms with shares over those of the language, up to `ranks` of each group."""
    about = groups.select("lang", "source", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"))
    bucket = F.when(F.col("count") < 64, F.col("count")).otherwise(64 + F.floor(8 * F.log2("count")))
    rows = _beside(postings, about, ["lang", "source"]).select("lang", "source", "term", bucket.cast("int").alias("bucket"), share(F.col("count"), F.col("total")).alias("p"), share(F.col("lang_count"), F.col("lang_total")).alias("q")).where("p > q")
    by = ["lang", "source", "bucket"]
    # in a bucket no share is over p, and none of the language under q
    bounds = rows.groupBy(*by).agg(F.count("*").alias("terms"), F.max("p").alias("p"), F.min("q").alias("q")).withColumn("bound", divergence(F.col("p"), F.col("q")))
    above = F.sum("terms").over(Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("terms")
    bounds = written(bounds.select(*by, "bound", (above < ranks).alias("first")))
    value = divergence(F.col("p"), F.col("q")).alias("value")
    some = _beside(rows, bounds.where("first").select(*by), by).select("lang", "source", "term", value)
    last = some.withColumn("rank", _ranked(some, "value", "term")).where(F.col("rank") <= ranks).groupBy("lang", "source").agg(F.when(F.count("*") == ranks, F.min("value")).otherwise(-1).alias("last"))
    last = written(last)
    open_ = written(bounds.join(last, ["lang", "source"]).where("bound >= last").select(*by, "last"))
    rest = _beside(rows, open_, by).select("lang", "source", "term", value, "last").where("value >= last")
    return rest.withColumn("rank", _ranked(rest, "value", "term")).where(F.col("rank") <= ranks).select("lang", "source", "term", "value", "rank")


def _common(postings: DataFrame) -> DataFrame:
    """lang, a, b, value for pairs of groups: over the terms that both have, what these make beyond what they would make if
    each group's terms were absent in the other. postings: lang, term, gid, p, p0, where p0 is the group's share of an absent term."""
    blocks = postings.groupBy("lang", "term", F.floor(F.col("gid") / BLOCK).alias("block")).agg(F.collect_list(F.struct("gid", "p", "p0")).alias("here"))
    apart = (postings.agg(F.max("gid")).first()[0] or 0) >= BLOCK
    if apart:
        met = blocks.select("lang", "term", "here").join(blocks.select("lang", "term", F.col("here").alias("there")), ["lang", "term"])
    else:
        met = blocks.withColumn("there", F.col("here"))
    met = met.where(F.lit(apart) | (F.size("here") > 1))
    columns = [F.col(side)[c].alias(f"{side}_{c}") for side in (("here", "there") if apart else ("here",)) for c in ("gid", "p", "p0")]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = lambda p, q: (p - q) ** 2 // q
        for batch in batches:
            of = {c: pa.compute.list_flatten(batch[c]).to_numpy() for c in batch.schema.names if c != "lang"}
            sizes = {s: np.asarray(pa.compute.list_value_length(batch[f"{s}_gid"]), np.int64) for s in ("here", "there") if f"{s}_gid" in batch.schema.names}
            x, y = sizes["here"], sizes["there" if apart else "here"]
            x_at, y_at = (np.concatenate([[0], np.cumsum(s)]) for s in (x, y))
            langs, lang = np.unique(np.array(batch["lang"].to_pylist(), object), return_inverse=True)
            done = np.concatenate([[0], np.cumsum(x * y)])
            row = 0
            while row < len(x):
                to = max(row + 1, int(np.searchsorted(done, done[row] + PAIRS, "right")) - 1)
                n = (x * y)[row:to]
                r = np.repeat(np.arange(row, to), n)
                place = np.arange(len(r)) - np.repeat(done[row:to] - done[row], n)
                i, j = x_at[r] + place // y[r], y_at[r] + place % y[r]
                side = "there" if apart else "here"
                a, b, p, q, p0, q0 = of["here_gid"][i], of[f"{side}_gid"][j], of["here_p"][i], of[f"{side}_p"][j], of["here_p0"][i], of[f"{side}_p0"][j]
                keep = a != b
                value = (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))[keep]
                l, a, b = lang[r][keep], a[keep], b[keep]
                order = np.lexsort((b, a, l))
                l, a, b, value = l[order], a[order], b[order], value[order]
                if len(l):
                    first = np.flatnonzero(np.concatenate([[True], (l[1:] != l[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                    yield pa.RecordBatch.from_arrays([pa.array(langs[l[first]].tolist(), pa.string()), *map(pa.array, (a[first], b[first], np.add.reduceat(value, first)))], ["lang", "a", "b", "value"])
                row = to

    return map_arrow(met.select("lang", *columns), pairs, "lang string, a long, b long, value long")


def pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for all pairs of sources of a language."""
    here = _beside(postings, groups.select("lang", "source", "gid", (F.col("n") + F.col("v")).alias("total")), ["lang", "source"])
    here = here.select("lang", "term", "gid", "count", share(F.col("count"), F.col("total")).alias("p"), share(F.lit(0), F.col("total")).alias("p0"))
    common = _common(here)
    each = here.groupBy("lang", "gid", "p").agg(F.count("*").alias("terms"))
    each = written(each.groupBy("lang", "gid").agg(F.collect_list(F.struct("p", "terms")).alias("each"), F.sum("terms").alias("has")))
    absent = groups.where("v > 0").select("lang", "gid", "v", share(F.lit(0), F.col("n") + F.col("v")).alias("p0")).join(each.select("lang", "gid", "has"), ["lang", "gid"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
    absent = written(absent)
    other = absent.select("lang", F.col("gid").alias("b"), F.col("p0").alias("q0"), F.col("has").alias("there"))
    base = _beside(absent, other, ["lang"]).where("gid <> b").select("lang", F.col("gid").alias("a"), "b", ((F.col("v") - F.col("has") - F.col("there")) * divergence(F.col("p0"), F.col("q0"))).alias("value"))
    met = _beside(each, other.select("lang", "b", "q0"), ["lang"]).where("gid <> b")
    over = lambda f: F.aggregate("each", F.lit(0).cast("long"), lambda s, x: s + x["terms"] * f(x["p"]))
    forth = met.select("lang", F.col("gid").alias("a"), "b", over(lambda p: divergence(p, F.col("q0"))).alias("value"))
    back = met.select("lang", F.col("b").alias("a"), F.col("gid").alias("b"), over(lambda p: divergence(F.col("q0"), p)).alias("value"))
    none = groups.where("v = 0").select("lang", "gid")
    zero = _beside(none, none.withColumnRenamed("gid", "b"), ["lang"]).where("gid <> b").select("lang", F.col("gid").alias("a"), "b", F.lit(0).cast("long").alias("value"))
    total = written(base.unionByName(forth).unionByName(back).unionByName(common).unionByName(zero).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    names = groups.select("lang", "source", "gid")
    named = _beside(total, names.select("lang", F.col("gid").alias("a"), "source"), ["lang", "a"])
    return _beside(named, names.select("lang", F.col("gid").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", "item", "value")


def audit(documents: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair holds how far the shares of all kept terms in a source are from those in each
    other source of its language, part term the terms whose share in the source is above that in the language, up to `ranks`.

    Terms in LEAST_DOCUMENTS documents of a language are kept. A share is 1 + floor(UNITS * (count + 1) / (kept occurrences + kept
    terms)), and a value floor((p - q)**2 / q), all in whole numbers. Equal values are ranked by the item's bytes. Null
    texts, languages and sources are empty; repeated rows count each; groups without terms have shares and pairs, but no terms;
    languages without kept terms have pairs of value 0. An empty table gives no rows; other columns are left out.
    """
    names = (F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    sources = indexed(written(documents.select(*names).distinct()), "lang", ["source"]).select("lang", "source", F.col("_index").alias("gid"))
    counts = written(term_counts(documents).groupBy("lang", "source", "term").agg(F.sum("n").alias("count"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    postings = written(counts.drop("docs").join(kept, ["lang", "term"]))
    langs = postings.groupBy("lang").agg(F.sum("count").alias("lang_n"))
    terms = postings.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    own = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = written(sources.join(own, ["lang", "source"], "left").join(langs.join(terms, "lang"), "lang", "left").fillna(0, ["n", "lang_n", "v"]))

    found = top_terms(postings, groups, ranks).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    between = pairs(postings, groups)
    return between.select("lang", "source", F.lit("pair").alias("part"), "item", "value", _ranked(between, "value", "item").alias("rank")).unionByName(found)


#: op13 in SQL, over every group and every kept term.
ORACLE_SQL = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
o as (select k, lang, source, unnest(w) as term from d),
c as (select lang, source, term, count(*) as c, count(distinct k) as docs from o group by all),
kept as (select lang, term, sum(c) as lc from c group by all having sum(docs) >= 3),
v as (select lang, count(*) as v, sum(lc) as n from kept group by lang),
g as (select distinct lang, source from d),
n as (select g.lang, g.source, coalesce(sum(c.c) filter (kept.term is not null), 0) as n from g left join c using (lang, source) left join kept on kept.lang = c.lang and kept.term = c.term group by all),
p as (
  select n.lang, n.source, kept.term, coalesce(c.c, 0) as c, 1 + 1000000000::hugeint * (coalesce(c.c, 0) + 1) // (n.n + v.v) as p, 1 + 1000000000::hugeint * (lc + 1) // (v.n + v.v) as q
  from n join v using (lang) join kept using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = kept.term),
t as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from p where c > 0 and p > q),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select * from t)
select lang, source, part, item, value::bigint as value, rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r) where part = 'pair' or rank <= 200
"""
