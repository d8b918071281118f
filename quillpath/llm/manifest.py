"""Merkle manifest of a dataset: a tree over each source's documents, a tree over the sources, and a proof for every document.

Leaves are numbered by ranges that every task keeps in order. A task collects the digests of children under their
parents by index; a parent is done when it has as many children as the number of leaves says, and then is itself
a child of the next. What a task cannot finish (its frontier: a few nodes at its two ends, whatever it holds) is
shuffled by the ancestor that joins it with its neighbours' ends, and combined in the same way. Proofs go
the other way: nodes get the siblings up to the node that they were combined into, and then what that one got.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpath.llm.common import map_arrow, written

#: Children of a node.
ARITY = 3
#: Leaves of a part, about: one group of a task. On the driver there is one bound for each part.
PART_ROWS = 200_000
#: Levels of the tree that one reshuffle of frontiers joins: ARITY**LEVELS neighbouring parts meet in a group.
LEVELS = 5
_NODE = "_group string, _level int, _index long, _size long, digest string"


def record_digest(*values: Column) -> Column:
    """Hexadecimal SHA-256 of values in a row: each with its number of UTF-8 bytes and a colon before it, a null as `-`."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, source, leaf of every document."""
    return documents.select("doc_id", "source", record_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"))


def _hash(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _family(index: int, size: int) -> int:
    """Children of the parent of a node, of which its level has size."""
    return min(ARITY, size - index + index % ARITY)


def indexed(df: DataFrame, group: str, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """df with _part, _index (from 0 within the group) and _size (of the group), by ascending order columns.

    Rows are dealt into sorted ranges of (group, order), numbered there, and each range learns how many rows of the
    group lie before it. A group of any size is cut into ranges; only rows that are equal in all those columns stay together.
    """
    spark = df.sparkSession
    df = df.drop("_part", "_place", "_index", "_size")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // part_rows))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = np.empty(batch.num_rows, np.int64)
            for k, g in enumerate(batch[group].to_pylist()):
                seen = seen + 1 if g == last else 0
                last, places[k] = g, seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places)], [*batch.schema.names, "_part", "_place"])

    dealt = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = written(map_arrow(dealt, number, f"{schema}, _part int, _place long"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("n"))
    spans = counts.select(group, "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(Window.partitionBy(group)).alias("_size"))
    return placed.join(written(spans), [group, "_part"]).withColumn("_index", F.col("_before") + F.col("_place")).drop("_before", "_place")


class _Combined:
    """Nodes that arrive in any order, and the ancestors that come of them."""

    def __init__(self, nodes: Iterable[tuple[str, int, int, int, str]]):
        self.known: dict[tuple[str, int, int], str] = {}
        self.waiting: dict[tuple[str, int, int], dict[int, str]] = {}
        self.sizes: dict[tuple[str, int], int] = {}
        self.roots: list[tuple[str, int]] = []
        self.paths: dict[tuple[str, int, int], tuple[str, int, int]] = {}
        for group, level, index, size, digest in nodes:
            while True:
                self.known[group, level, index] = digest
                self.sizes[group, level] = size
                if size == 1:
                    self.roots.append((group, level))
                    break
                parent = group, level + 1, index // ARITY
                children = self.waiting.setdefault(parent, {})
                children[index % ARITY] = digest
                if len(children) < _family(index, size):
                    break
                del self.waiting[parent]
                digest = _hash(children[k] for k in range(len(children)))
                level, index, size = level + 1, index // ARITY, -(-size // ARITY)

    def frontier(self) -> list[tuple[str, int, int, int, str]]:
        """Nodes whose parents are not there: children of unfinished ones, and roots."""
        ends = [(g, level - 1, ARITY * index + k) for (g, level, index), children in self.waiting.items() for k in children]
        return [(g, level, index, self.sizes[g, level], self.known[g, level, index]) for g, level, index in [*ends, *((g, level, 0) for g, level in self.roots)]]

    def path(self, group: str, level: int, index: int) -> tuple[str, int, int]:
        """Siblings of a node and of its ancestors, and the level and index of the last ancestor that is there."""
        steps = []
        while (found := self.paths.get((group, level, index))) is None:
            if (group, level + 1, index // ARITY) not in self.known:
                found = self.paths[group, level, index] = "", level, index
                break
            low = index - index % ARITY
            siblings = "".join(self.known[group, level, k] for k in range(low, low + _family(index, self.sizes[group, level])) if k != index)
            steps.append((level, index, siblings))
            level, index = level + 1, index // ARITY
        for level, index, siblings in reversed(steps):
            found = siblings + found[0], found[1], found[2]
            if level:  # leaves are asked for once
                self.paths[group, level, index] = found
        return found


def _nodes(table: pa.Table) -> Iterator[tuple[str, int, int, int, str]]:
    return zip(*(table[c].to_pylist() for c in ("_group", "_level", "_index", "_size", "digest")), strict=True)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[] for _ in schema], schema, strict=True)], schema=schema)


_ARROW_NODE = pa.schema([("_group", pa.string()), ("_level", pa.int32()), ("_index", pa.int64()), ("_size", pa.int64()), ("digest", pa.string())])
_ARROW_LINK = pa.schema([("_group", pa.string()), ("_level", pa.int32()), ("_index", pa.int64()), ("_top_level", pa.int32()), ("_top_index", pa.int64()), ("siblings", pa.string())])
_LINK = "_group string, _level int, _index long, _top_level int, _top_index long, siblings string"


def _frontier(table: pa.Table) -> pa.Table:
    return _table(_Combined(_nodes(table)).frontier(), _ARROW_NODE)


def _links(table: pa.Table) -> pa.Table:
    nodes = list(_nodes(table))
    tree = _Combined(nodes)
    rows = []
    for g, level, index, _, _ in nodes:
        siblings, top_level, top_index = tree.path(g, level, index)
        rows.append((g, level, index, top_level, top_index, siblings))
    return _table(rows, _ARROW_LINK)


def _combined(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From leaves (_part, _group, _index, _size, digest): the root of each group (_group, digest), and for every node at which
    a part ends (_part, _group, _level, _index) the siblings from there to the root."""

    def local(table: pa.Table) -> pa.Table:
        part = table["_part"][0].as_py()
        out = _frontier(table)
        return out.append_column("_part", pa.array([part] * len(out), pa.int32()))

    ends = written(numbered.withColumn("_level", F.lit(0)).select("_part", "_group", "_level", "_index", "_size", "digest").groupBy("_part").applyInArrow(local, f"{_NODE}, _part int"))
    most, parts, rows = numbered.agg(F.max("_size"), F.max("_part"), F.count("*")).first()
    depth, per_part = 0, max(1, (rows or 0) // ((parts or 0) + 1))
    while ARITY**depth < (most or 0):
        depth += 1
    level, done = next(k for k in range(64) if ARITY**k >= per_part), 0
    roots, open_, rounds = [ends.where("_size = 1")], ends.drop("_part").where("_size > 1"), []
    while done < depth:
        level = done = level + LEVELS
        up = F.greatest(F.lit(level) - F.col("_level"), F.lit(0))
        keyed = open_.select("*", F.floor(F.col("_index") / F.pow(F.lit(float(ARITY)), up)).cast("long").alias("_block"), F.greatest(F.lit(level), F.col("_level")).alias("_at"))
        groups = keyed.groupBy("_group", "_at", "_block")
        rounds.append(written(groups.applyInArrow(_links, _LINK)))
        above = written(groups.applyInArrow(_frontier, _NODE))
        roots.append(above.where("_size = 1"))
        open_ = above.where("_size > 1")
    all_roots = roots[0].select("_group", "digest")
    for r in roots[1:]:
        all_roots = all_roots.unionByName(r.select("_group", "digest"))
    tails = None
    for links in reversed(rounds):
        if tails is not None:
            upper = tails.select("_group", F.col("_level").alias("_top_level"), F.col("_index").alias("_top_index"), F.col("siblings").alias("_more"))
            links = links.join(upper, ["_group", "_top_level", "_top_index"], "left").withColumn("siblings", F.concat("siblings", F.coalesce("_more", F.lit("")))).select(*links.columns)
        tails = links.select("_group", "_level", "_index", "siblings")
    at = ends.select("_part", "_group", "_level", "_index")
    if tails is None:
        return written(all_roots), at.withColumn("siblings", F.lit(""))
    return written(all_roots), at.join(tails, ["_group", "_level", "_index"], "left").withColumn("siblings", F.coalesce("siblings", F.lit("")))


def _paths(numbered: DataFrame, tails: DataFrame, finish: Callable[[dict, str, dict], tuple], schema: str, arrow: pa.Schema) -> DataFrame:
    """finish(leaf's row, its siblings, the row of tails at the end of its part's path) for every leaf."""

    def prove(table: pa.Table, ends: pa.Table) -> pa.Table:
        rows = table.append_column("_level", pa.array(np.zeros(len(table), np.int32)))
        tree = _Combined(_nodes(rows))
        end = {(r["_group"], r["_level"], r["_index"]): r for r in ends.to_pylist()}
        out = []
        for row in table.to_pylist():
            siblings, level, index = tree.path(row["_group"], 0, row["_index"])
            tail = end[row["_group"], level, index]
            out.append(finish(row, siblings + tail["siblings"], tail))
        return _table(out, arrow)

    return numbered.groupBy("_part").cogroup(tails.groupBy("_part")).applyInArrow(prove, schema)


def fold(digest: str, siblings: str, places: Iterable[tuple[int, int]]) -> str:
    """The root that a digest leads to with the siblings of its proof, through trees in which it has (index, number of leaves)."""
    at = 0
    for index, size in places:
        while size > 1:
            place, others = index % ARITY, 64 * (_family(index, size) - 1)
            cut = at + 64 * place
            digest = sha256((siblings[at:cut] + digest + siblings[cut : at + others]).encode()).hexdigest()
            at += others
            index, size = index // ARITY, -(-size // ARITY)
    return digest


def manifest(rows: DataFrame, check: str | None = None, proofs: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, source, leaf, place, places, source_place, sources, subroot, root, proof_sha256 for rows of doc_id, source, leaf.

    Leaves of a source ascend by doc_id (null first), then leaf; sources ascend by their bytes, null first. Every ARITY
    neighbours of a level make the next one. place of places leaves and source_place of sources say where a row is, and so
    how a proof is folded. With check, the name of a column of other leaf digests (null: the leaf itself), folded_root
    is the root that this digest leads to, and verified whether it is the root. With proofs, proof has the siblings themselves, level by level.
    Repeated rows are leaves of their own; an empty table gives no rows; other columns are left out.
    """
    group = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("_group")
    base = rows.select("doc_id", group, F.col("leaf").alias("digest"), (F.col(check) if check else F.lit(None)).cast("string").alias("_check"))
    numbered = written(indexed(written(base), "_group", ["doc_id", "digest"], part_rows))
    subroots, tails = _combined(numbered)
    tops = written(indexed(subroots.select(F.col("_group").alias("_source"), "digest").withColumn("_group", F.lit("")), "_group", ["_source"], part_rows))
    root, ends = _combined(tops)
    root = root.first()
    root = root["digest"] if root else None

    arrow = pa.schema([("_group", pa.string()), ("subroot", pa.string()), ("source_place", pa.int64()), ("sources", pa.int64()), ("source_siblings", pa.string())])
    schema = "_group string, subroot string, source_place long, sources long, source_siblings string"
    sources = written(_paths(tops, ends, lambda row, siblings, tail: (row["_source"], row["digest"], row["_index"], row["_size"], siblings), schema, arrow))

    kinds = {"doc_id": pa.int64(), "source": pa.string(), "leaf": pa.string(), "place": pa.int64(), "places": pa.int64(), "source_place": pa.int64(), "sources": pa.int64(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string()}
    if check:
        kinds |= {"folded_root": pa.string(), "verified": pa.bool_()}
    if proofs:
        kinds["proof"] = pa.string()

    def finish(row: dict, siblings: str, tail: dict) -> tuple:
        siblings += tail["source_siblings"]
        where = (row["_index"], row["_size"]), (tail["source_place"], tail["sources"])
        out = [row["doc_id"], row["_group"][1:] if row["_group"] else None, row["digest"], *where[0], *where[1], tail["subroot"], root, _hash([siblings])]
        if check:
            folded = fold(row["_check"] or row["digest"], siblings, where)
            out += [folded, folded == root]
        return tuple(out + [siblings] * proofs)

    types = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return _paths(numbered, tails.join(sources, "_group"), finish, ", ".join(f"{k} {types[v]}" for k, v in kinds.items()), pa.schema(list(kinds.items())))


def audited(documents: DataFrame) -> DataFrame:
    """manifest of documents, checked against the same documents with the line feeds deleted from the text of those
    whose unsigned crc32 of the decimal doc_id is even (a null doc_id has none)."""
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    after = F.when(touched, record_digest(*values, F.translate("text", "\n", "")))
    return manifest(documents.select("doc_id", "source", record_digest(*values, F.col("text")).alias("leaf"), after.alias("_after")), "_after")


#: op11 in SQL: both trees level by level, and every leaf up through the runs that it is in.
ORACLE_SQL = r"""
with recursive e as (
  select *, coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-') || coalesce(strlen(lang)::varchar || ':' || lang, '-') || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') as head from documents),
crc(i, k, c) as (select i, 0, i::ubigint from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from crc where k < 8),
tab as (select list(c order by i) as t from crc where k = 8),
ck(doc_id, k, c) as (
  select distinct doc_id, 0, 4294967295::ubigint from documents where doc_id is not null
  union all select doc_id, k + 1, xor(c >> 8, t[(xor(c & 255, ascii(substr(doc_id::varchar, k + 1, 1))::ubigint))::int + 1]) from ck, tab where k < length(doc_id::varchar)),
even as (select doc_id, xor(c, 4294967295::ubigint) % 2 = 0 as hit from ck where k = length(doc_id::varchar)),
d as (
  select e.doc_id, coalesce('+' || source, '') as g, sha256(head || coalesce(strlen(text)::varchar || ':' || text, '-')) as leaf,
    case when hit then sha256(head || coalesce(strlen(replace(text, chr(10), ''))::varchar || ':' || replace(text, chr(10), ''), '-')) end as after
  from e left join even on even.doc_id = e.doc_id),
o as (select *, row_number() over () as k, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from d),
t(g, l, i, n, x) as (
  select g, 0, i, n, leaf from o
  union all select g, l + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(x, '' order by i)) from t where n > 1 group by g, l, i // 3),
s as (select g, x, row_number() over (order by g) - 1 as i, count(*) over () as n from t where n = 1),
u(l, i, n, x) as (
  select 0, i, n, x from s
  union all select l + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(x, '' order by i)) from u where n > 1 group by l, i // 3),
tr as (select g, l, i // 3 as p, list(x order by i) as xs from t where n > 1 group by all),
ur as (select l, i // 3 as p, list(x order by i) as xs from u where n > 1 group by all),
f(k, g, l, i, n, x, sib) as (
  select k, g, 0, i, n, coalesce(after, leaf), '' from o
  union all select k, f.g, f.l + 1, i // 3, (n + 2) // 3, sha256(array_to_string(list_concat(list_concat(xs[:i % 3], [x]), xs[i % 3 + 2:]), '')), sib || array_to_string(list_concat(xs[:i % 3], xs[i % 3 + 2:]), '')
  from f join tr on tr.g = f.g and tr.l = f.l and tr.p = f.i // 3 where n > 1),
v(k, l, i, n, x, sib) as (
  select f.k, 0, s.i, s.n, f.x, f.sib from f join s on s.g = f.g where f.n = 1
  union all select k, v.l + 1, i // 3, (n + 2) // 3, sha256(array_to_string(list_concat(list_concat(xs[:i % 3], [x]), xs[i % 3 + 2:]), '')), sib || array_to_string(list_concat(xs[:i % 3], xs[i % 3 + 2:]), '')
  from v join ur on ur.l = v.l and ur.p = v.i // 3 where n > 1)
select o.doc_id, substr(nullif(o.g, ''), 2) as source, o.leaf, o.i::bigint as place, o.n as places, s.i::bigint as source_place, s.n as sources, s.x as subroot, r.x as root, sha256(v.sib) as proof_sha256, v.x as folded_root, v.x = r.x as verified
from o join s on s.g = o.g join v on v.k = o.k and v.n = 1, (select x from u where n = 1) r
"""
