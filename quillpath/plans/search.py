"""Completion, prefix and fuzzy search over metadata tables, and validation of many paths at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillpath.functions.lookups import DEFAULT_LOOKUPS, LOOKUPS, TRANSFORMS
from quillpath.plans.metadata import stored
from quillpath.plans.paths import ATTRIBUTE_PATH, FILTERS, RELATION_ONLY

#: Names listed for a class, at most.
CLASS_LIMIT = 50


def lookup_table(spark: SparkSession) -> DataFrame:
    """kind, lookup, ordinal."""
    return spark.createDataFrame([(k, n, i) for k, ns in LOOKUPS.items() for i, n in enumerate(ns)], "kind string, lookup string, ordinal int")


def transform_table(spark: SparkSession) -> DataFrame:
    """name, input_kind, output_kind."""
    return spark.createDataFrame([(n, k, out) for n, (out, kinds) in TRANSFORMS.items() for k in kinds], "name string, input_kind string, output_kind string")


def kinds_of_lookups(lookups: DataFrame) -> DataFrame:
    """lookup and the sorted kinds that take it."""
    return lookups.groupBy("lookup").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def visible(fields: DataFrame, method: str) -> DataFrame:
    """Fields that a method's paths may name."""
    out = fields.where("not endswith(name, '+')")
    return out.where("provenance <> 'related_query_alias'") if method in ATTRIBUTE_PATH else out


def completions(fields: DataFrame, model: str, prefix: str, method: str = "filter") -> DataFrame:
    """name, group, depth, is_relation, kind for a partial path under model: its fields, for filters
    their lookups, and the fields one relation further; ordered by group, depth, relations first and name."""
    *done, partial = prefix.split("__")
    at = visible(fields, method)
    here = fields.sparkSession.createDataFrame([(model,)], "model string")
    for segment in done:
        here = at.where(F.col("name") == segment).where("is_relation").join(here, "model", "left_semi").select(F.col("target").alias("model"))
    own = at.join(here, "model", "left_semi")
    if method in RELATION_ONLY:
        own, at = own.where("is_relation"), at.where("is_relation")
    parts = [own.select("name", F.lit(0).alias("group"), F.lit(0).alias("depth"), "is_relation", "kind")]
    if method in FILTERS:
        lookups = F.broadcast(lookup_table(fields.sparkSession))
        parts.append(own.where("not is_relation").join(lookups, "kind").select(F.concat_ws("__", "name", "lookup").alias("name"), F.lit(2).alias("group"), F.lit(1).alias("depth"), F.lit(False).alias("is_relation"), F.lit("lookup_operator").alias("kind")))
    if len(done) <= 2:
        below = at.select(F.col("model").alias("target"), F.col("name").alias("_name"), F.col("is_relation").alias("_rel"), F.col("kind").alias("_kind"))
        parts.append(own.where("is_relation").join(below, "target").select(F.concat_ws("__", "name", "_name").alias("name"), F.lit(2).alias("group"), F.lit(1).alias("depth"), F.col("_rel").alias("is_relation"), F.col("_kind").alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("name").startswith(partial)).distinct().orderBy("group", "depth", F.desc("is_relation"), F.lower("name"), "name")


def with_prefix(items: DataFrame, column: str, prefix: str, limit: int = CLASS_LIMIT, fold: bool = False) -> DataFrame:
    """The first `limit` items in order whose column begins with prefix."""
    c = F.lower(column) if fold else F.col(column)
    return items.where(c.startswith(prefix.lower() if fold else prefix)).orderBy(column).limit(limit)


def fuzzy(items: DataFrame, column: str, text: str, most: int = 2) -> DataFrame:
    """Items within an edit distance of 1 to most, without case, nearest first."""
    d = F.levenshtein(F.lower(column), F.lit(text.lower()), most)
    return items.withColumn("distance", d).where(F.col("distance").between(1, most)).orderBy("distance", column)


def _edited(word: Column, deleted: int, replaced: int) -> Column:
    """Structs of key, places and chars for every way to delete so many characters of a word and then to replace so many: key is what is left,
    places and chars the replaced characters in order. Of deletions that leave the same only one is given."""
    none = F.lit("")

    def cut(s: Column, i: Column) -> tuple[Column, Column, Column]:
        """What is before character i, the character, and what is after it."""
        return F.substring(s["key"], F.lit(1), i - 1), F.substring(s["key"], i, F.lit(1)), F.substring(s["key"], i + 1, F.length(s["key"]))

    def without(s: Column, i: Column) -> Column:
        before, _, after = cut(s, i)
        return F.struct(F.concat(before, after).alias("key"), none.alias("places"), none.alias("chars"), F.lit(0).alias("at"))

    def masked(s: Column, i: Column) -> Column:
        before, char, after = cut(s, i)
        return F.struct(F.concat(before, F.lit("*"), after).alias("key"), F.concat_ws(",", s["places"], i).alias("places"), F.concat(s["chars"], char).alias("chars"), i.alias("at"))

    def each(s: Column, make: Callable[[Column, Column], Column]) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.length(s["key"])), lambda i: i > s["at"]), lambda i: make(s, i))

    now = F.array(F.struct(word.alias("key"), none.alias("places"), none.alias("chars"), F.lit(0).alias("at")))
    for _ in range(deleted):
        now = F.array_distinct(F.flatten(F.transform(now, lambda s: each(s, without))))
    for _ in range(replaced):
        now = F.flatten(F.transform(now, lambda s: each(s, masked)))
    return now


def _spread(sides: list[DataFrame]) -> tuple[list[set[int]], dict[int, list[int]]]:
    """The lengths of each side's words, and of each length the places, from 1, at which the words of all sides differ at all: what equal-length words replace lies there."""
    sided = [df.select("w", F.lit(i).alias("side")) for i, df in enumerate(sides)]
    words = sided[0] if len(sided) == 1 else sided[0].unionByName(sided[1])
    chars = words.select("w", "side", F.length("w").alias("n"), F.explode(F.sequence(F.lit(0), F.length("w"))).alias("p"))
    code = F.when(F.col("p") > 0, F.ascii(F.substring("w", F.col("p"), F.lit(1)))).otherwise(0)
    lengths: list[set[int]] = [set() for _ in sides]
    free: dict[int, list[int]] = {}
    for n, at, first, last, differ in chars.groupBy("n", "p").agg(F.min("side"), F.max("side"), (F.min(code) != F.max(code))).orderBy("n", "p").collect():
        lengths[first].add(n)
        lengths[last].add(n)
        if differ:
            free.setdefault(n, []).append(at)
    return lengths, free


def _places(free: dict[int, list[int]]) -> Column:
    """The free places of a word w, null without any."""
    return F.expr("element_at(map(" + ",".join(f"{n},array({','.join(map(str, at))})" for n, at in free.items()) + "), length(w))")


def _char(at: Column | str) -> Column:
    return F.substring("w", F.col(at) if isinstance(at, str) else at, F.lit(1))


def _without(*at: str) -> Column:
    """w without the characters at ascending places."""
    first, last = F.substring("w", F.lit(1), F.col(at[0]) - 1), F.substring("w", F.col(at[-1]) + 1, F.length("w"))
    return F.concat(first, *(F.substring("w", F.col(p) + 1, F.col(q) - F.col(p) - 1) for p, q in zip(at, at[1:])), last)


def _grouped(sides: list[DataFrame], parts: int) -> DataFrame:
    """Rows of text, w and more by equal texts: for each side, arrays of the other columns, named by them and the side's number."""
    rows = [df.withColumn("side", F.lit(i)) for i, df in enumerate(sides)]
    rows = (rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])).withColumn("key", F.xxhash64("text")).repartition(parts, "key", "text")
    rest = sides[0].columns[1:]
    lists = [F.collect_list(F.when(F.col("side") == i, F.struct(*rest))).alias(f"l{i}") for i in range(len(sides))]
    return rows.groupBy("key", "text").agg(*lists).select(*(F.col(f"l{i}.{c}").alias(f"{c}_{i}") for i in range(len(sides)) for c in rest))


def _both(groups: DataFrame, sides: int) -> DataFrame:
    """groups with the first side's arrays named _a, and the last's, which may be the same, _b."""
    return groups.select(*(F.col(c).alias(f"{c[:-2]}_{x}") for x, i in (("a", 0), ("b", sides - 1)) for c in groups.columns if c.endswith(f"_{i}")))


def _each_with_each(groups: DataFrame, code: str, hit: str, *more: str) -> DataFrame:
    """a, b, x, y, and `more` by name and _a or _b: of the arrays of groups, elements that meet by their codes x and y. Only those that hit are looked up."""
    columns = [f"{c}_{x}" for x in "ab" for c in ("w", *more)]
    pairs = groups.select(*columns, f"{code}_b", F.posexplode(f"{code}_a").alias("i", "x"))
    if hit == "x = y":
        pairs = pairs.select(*columns, "i", "x", (F.array_position(f"{code}_b", F.col("x")) - 1).cast("int").alias("j"), F.col("x").alias("y")).where("j >= 0")
    else:
        pairs = pairs.select(*columns, "i", "x", F.posexplode(f"{code}_b").alias("j", "y")).where(hit)
    return pairs.select("x", "y", *(F.get(f"{c}_{x}", F.col(k)).alias(x if c == "w" else f"{c}_{x}") for x, k in (("a", "i"), ("b", "j")) for c in ("w", *more)))


def _open(words: DataFrame, free: dict[int, list[int]]) -> DataFrame:
    """text, w, c: each word without the character at its last free place, and the character's code. Words of one text differ there only."""
    rows = words.select("w", F.element_at(_places(free), -1).alias("p")).where("p is not null")
    return rows.select(_without("p").alias("text"), "w", F.ascii(_char("p")).alias("c"))


def _replaced(groups: DataFrame, side: int, free: dict[int, list[int]], r: int) -> DataFrame:
    """key, text, w, c, c1 to cr: a side's groups without the characters at every r free places before the last, and these characters' codes."""
    at = [f"p{i}" for i in range(1, r + 1)]
    rows = groups.select(F.col(f"w_{side}").alias("ws"), F.col(f"c_{side}").alias("c")).where("size(ws) > 0").withColumn("w", F.get("ws", F.lit(0))).withColumn("left", _places(free))
    rows = rows.select("ws", "c", "w", F.element_at("left", -1).alias("last"), F.slice("left", F.lit(1), F.size("left") - 1).alias("left"))
    for k in range(r):
        rows = rows.select("ws", "c", "w", "last", *at[:k], "left", F.posexplode("left").alias("i", at[k]))
        rows = rows.withColumn("left", F.slice("left", F.col("i") + 2, F.size("left")))
    codes = (F.ascii(_char(p)).alias(f"c{i}") for i, p in enumerate(at, 1))
    return rows.select(F.concat_ws(",", *at, _without(*at, "last")).alias("text"), F.col("ws").alias("w"), "c", *codes).select(F.xxhash64("text").alias("key"), "*")


def _shortened(words: DataFrame, free: dict[int, list[int]]) -> DataFrame:
    """text, w, first, twin, span: each word without one character of each of its runs of equal ones that begins or ends at a free place.

    first is the run's first place; twin its last if the next but one has the same character, else 0; span holds the place where, of what is left, the next
    characters end to be equal, and in its lower half the place before the run.
    """
    n, p = F.length("w"), F.col("p")
    rows = words.select("w", _places(free).alias("free")).select("w", "free", F.explode("free").alias("p"))
    ends, begins = (p == n) | (_char(p) != _char(p + 1)), (p == 1) | (_char(p) != _char(F.greatest(p - 1, F.lit(1))))
    first = F.when(ends, F.length(F.rtrim(F.substring("w", F.lit(1), p), _char(p))) + 1).otherwise(p)
    last = F.when(ends, p).otherwise(n - F.length(F.ltrim(F.substring("w", p, n), _char(p))))
    rows = rows.select("w", "free", ends.alias("ends"), begins.alias("begins"), first.alias("first"), last.alias("last")).where("ends or begins and not array_contains(free, last)")
    last = F.col("last")
    level = F.when(last == n, F.lit(2**30)).otherwise(n - 1 - F.length(F.ltrim(F.substring("w", last + 1, n), _char(last + 1))))
    span = F.shiftleft(level.cast("long"), 32) + F.col("first") - 1
    return rows.select(_without("first").alias("text"), "w", "first", F.when(_char(last) == _char(last + 2), last).otherwise(0).alias("twin"), span.alias("span"))


#: Which of two shortened words lost the earlier character, by their spans, so that more than two places differ.
_EARLIER = "shiftright({0}, 32) < ({1} & 4294967295)"
#: That this way of two words counts: it is their only one, or its first word the smaller.
_ONLY = "({0} < {1} or twin_{0} = 0 or substring({0}, twin_{0}, first_{1} - twin_{0}) <> substring({1}, twin_{0} + 1, first_{1} - twin_{0}))"


def near_pairs(left: DataFrame, right: DataFrame, column: str, most: int = 2, once: bool = False) -> DataFrame:
    """a, b, distance: different words of left and of right that are at most `most` edits apart, without case; with once only those whose a is before b.

    Words of one length that differ in r places meet by what is left of them without the characters there, all of which must differ, so what meets is a
    pair, met once, and up to two places are its distance. Only places are taken at which the words of that length differ at all: names with running
    numbers have few. Words that differ in the last of these places at most are one row, and meet those of another row all at once.
    Words of one length that a deletion and an insertion make equal meet by what is left without one character, one for each run of equal ones. If a's
    is before b's, the characters between them are shifted, and each change among these is a place where a and b differ; those that differ in two places
    only were met before. Two words can meet so in two ways, if they alternate between two characters there; then the way counts whose first is the smaller.
    In other cases deletions of d characters of a, of e of b, and replacements of r in the same places of what is left lead words within that distance to the
    same string, with d + e + r up to most; only strings that a partner's length allows are made, and pairs are made single and compared.

    All is joined for equality by shuffles whatever the sizes look like, as a word has about n**r / 2 such strings. Lengths of words and their free places
    come to the driver. There are as many rows as near pairs, which for names that end in running numbers are hundreds or thousands a word.
    """
    # few words make many strings, and these many pairs, so a count of partitions is given, which adaptive execution does not lower by their size
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kept = [stored(df.where(F.col(column).isNotNull()).select(F.lower(column).alias("w")).distinct().repartition(parts, "w")) for df in ((left,) if left is right else (left, right))]
    words = [kept[0].toDF("a"), kept[-1].toDF("b")]
    lengths, free = _spread(kept)

    def given(side: int, name: str, d: int, e: int, r: int) -> DataFrame | None:
        fits = sorted(n for n in lengths[-side] if n - d >= r and n - d + e in lengths[side - 1])
        if not fits:
            return None
        rows = words[side].where(F.length(name).isin(fits)).select(name, F.explode(_edited(F.col(name), d, r)).alias("_e"))
        return rows.select(name, F.xxhash64("_e.key", "_e.places").alias("key"), F.col("_e.chars").alias(f"_{name}")).repartition(parts, "key")

    named = lambda df, x: df.select("key", "text", *(F.col(c).alias(f"{c}_{x}") for c in df.columns[2:]))
    far = F.levenshtein("a", "b", most)
    none = words[0].select("a", F.col("a").alias("b")).limit(0)
    out, again = none.withColumn("distance", F.lit(0)), none
    if free and most:
        groups = stored(_grouped([_open(df, free) for df in kept], parts))
        met = _both(groups, len(kept))
        for r in range(most + 1 if max(map(len, free.values())) > 1 else 1):
            hit = "x < y" if once else "x <> y"
            if r:
                a, b = (named(_replaced(groups, i, free, r).repartition(parts, "key", "text"), x) for i, x in ((0, "a"), (len(kept) - 1, "b")))
                met = a.join(b.hint("merge"), ["key", "text"]).where(" and ".join(f"c{i}_a {'<' if once and i == 1 else '<>'} c{i}_b" for i in range(1, r + 1)))
                hit = "x = y" if r == most else "true"
            found = _each_with_each(met, "c", hit)
            out = out.unionByName(found.select("a", "b", (F.when(F.col("x") == F.col("y"), r).otherwise(r + 1) if r + (r < most) < 3 else far).alias("distance")))
    if free and most == 2:
        met = _both(_grouped([_shortened(df, free) for df in kept], parts), len(kept))
        found = _each_with_each(met, "span", f"{_EARLIER.format('x', 'y')} or {_EARLIER.format('y', 'x')}", "first", "twin")
        found = found.where("a < b" if once else "true").where(" or ".join(f"{_EARLIER.format(*xy)} and {_ONLY.format(*ab)}" for xy, ab in (("xy", "ab"), ("yx", "ba"))))
        out = out.unionByName(found.select("a", "b", F.lit(2).alias("distance")))
    other = lambda i: F.substring("_a", i, 1) != F.substring("_b", i, 1)
    apart = F.size(F.filter(F.sequence(F.lit(1), F.length("a")), lambda i: F.substring(F.col("a"), i, F.lit(1)) != F.substring(F.col("b"), i, F.lit(1)))) > most
    for d in range(most + 1):
        for e in range(most + 1 - d):
            for r in range(most + 1 - d - e) if d != e or d and most > 2 else ():
                a, b = given(0, "a", d, e, r), given(1, "b", e, d, r)
                if a is None or b is None:
                    continue
                pairs = a.join(b.hint("merge"), "key").where("a < b" if once else "a <> b")
                for i in range(1, r + 1):
                    pairs = pairs.where(other(i))
                again = again.unionByName((pairs.where(apart) if d == e else pairs).select("a", "b"))
    return out.unionByName(again.distinct().withColumn("distance", far)).where("distance >= 0")


def with_prefixes(items: DataFrame, column: str, prefixes: DataFrame, limit: int = CLASS_LIMIT, fold: bool = False) -> DataFrame:
    """prefix, `column`, rank: for every row of prefixes (column prefix) the first `limit` different items in order that begin with it.

    Items are cut to each length that a prefix has, and joined with the prefixes for equality; a prefix that most items have keeps its first
    in every task before any are shuffled. Lengths come to the driver, of which there are as many as the longest prefix has letters.
    """
    text = F.lower if fold else F.col
    asked = prefixes.where("prefix is not null").select("prefix", text("prefix").alias("_key")).distinct()
    lengths = sorted(r[0] for r in asked.select(F.length("_key")).distinct().collect())
    if not lengths:
        return asked.select("prefix", F.lit(None).cast("string").alias(column), F.lit(0).alias("rank"))
    own = text(column)
    cuts = F.array(*(F.when(F.length(own) >= n, F.substring(own, 1, n)) for n in lengths))
    cut = items.where(F.col(column).isNotNull()).select(column).distinct().select(column, F.explode(F.array_compact(cuts)).alias("_key"))
    met = cut.join(asked, "_key")
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(column))
    return met.select("prefix", column, place.alias("rank")).where(F.col("rank") <= limit)


def candidates(items: DataFrame, column: str, text: str, usage: DataFrame | None = None) -> DataFrame:
    """Items by prefix without case, or near ones where no item has the prefix; exact beginnings first, then the most used, then by name."""
    low = F.lower(column)
    by_prefix = items.where(low.startswith(text.lower())).withColumn("tier", F.when(F.col(column).startswith(text), 0).otherwise(1))
    none = by_prefix.limit(1).agg(F.count("*").alias("_found"))
    near = fuzzy(items, column, text).drop("distance").withColumn("tier", F.lit(2)).crossJoin(F.broadcast(none)).where("_found = 0").drop("_found")
    out = by_prefix.unionByName(near)
    if usage is None:
        return out.withColumn("uses", F.lit(0)).orderBy("tier", column)
    return out.join(usage.withColumnRenamed("name", column), column, "left").withColumn("uses", F.coalesce("uses", F.lit(0))).orderBy("tier", F.desc("uses"), column)


def relation_targets(models: DataFrame, prefix: str, runtime: DataFrame | None = None) -> DataFrame:
    """Models whose label, name, module or import path begins with prefix, by label; with the labels of a running
    project (runtime: label) is_runtime is added, and its models go first."""
    hit = F.col("label").startswith(prefix) | F.col("name").startswith(prefix) | F.col("module").startswith(prefix) | F.concat_ws(".", "module", "name").startswith(prefix)
    found = models.where(hit)
    if runtime is None:
        return found.orderBy(F.lower("label"))
    live = runtime.select("label", F.lit(True).alias("is_runtime")).dropDuplicates(["label"])
    return found.join(live, "label", "left").withColumn("is_runtime", F.coalesce("is_runtime", F.lit(False))).orderBy(F.desc("is_runtime"), F.lower("label"))


def virtual_completions(names: DataFrame, prefix: str) -> DataFrame:
    """name, group, kind of annotations (name, kind) that begin with prefix, and after a whole name and __ its lookups."""
    head, mark, tail = prefix.partition("__")
    own = names.where(F.col("name").startswith(prefix)).select("name", F.lit(0).alias("group"), "kind")
    if not mark:
        return own.orderBy("group", "name")
    looked = names.where(F.col("name") == head).join(F.broadcast(lookup_table(names.sparkSession)), "kind").where(F.col("lookup").startswith(tail))
    return own.unionByName(looked.select(F.concat_ws("__", "name", "lookup").alias("name"), F.lit(2).alias("group"), F.lit("lookup_operator").alias("kind"))).orderBy("group", "name")


def without_aliases(fields: DataFrame) -> DataFrame:
    """fields without the query aliases of a reverse relation that its model also offers under another name to the same target."""
    other = fields.where("direction = 'reverse' and provenance <> 'related_query_alias'").select("model", "target", F.col("declared_on").alias("_on"))
    return fields.where("provenance <> 'related_query_alias'").unionByName(fields.where("provenance = 'related_query_alias'").join(other, (fields["model"] == other["model"]) & (fields["target"] == other["target"]), "left_anti"))


#: Names that a preview of a relation target lists of each kind.
PREVIEW = 8


def target_previews(nodes: DataFrame) -> DataFrame:
    """nodes with the first PREVIEW names of each array, and how many there are."""
    arrays = ("field_names", "relation_names", "reverse_names")
    return nodes.select("model", *(F.slice(c, 1, PREVIEW).alias(c) for c in arrays), *(F.size(c).alias(f"n_{c}") for c in arrays))


def resolved_targets(refs: DataFrame, models: DataFrame) -> DataFrame:
    """id, ref, target, reason of references (id, ref, context): a label, an import path, a unique object name; `self` is the context."""
    by_label = models.select(F.col("label").alias("ref"), F.col("label").alias("_a"))
    by_path = models.select(F.concat_ws(".", "module", "name").alias("ref"), F.col("label").alias("_b")).dropDuplicates(["ref"])
    by_name = models.groupBy(F.col("name").alias("ref")).agg(F.count("*").alias("_n"), F.min("label").alias("_c"))
    j = refs.join(by_label, "ref", "left").join(by_path, "ref", "left").join(by_name, "ref", "left")
    target = F.when(F.col("ref") == "self", F.col("context")).otherwise(F.coalesce("_a", "_b", F.when(F.col("_n") == 1, F.col("_c"))))
    reason = F.when(target.isNotNull(), "").when(F.col("ref") == "self", "missing_context").when(F.col("_n") > 1, "ambiguous").otherwise("not_found")
    return j.select("id", "ref", target.alias("target"), reason.alias("reason"))


def first_wins(*lists: DataFrame, key: str) -> DataFrame:
    """All rows of lists in their order, of one key the first."""
    out = None
    for i, df in enumerate(lists):
        part = df.withColumn("_list", F.lit(i))
        out = part if out is None else out.unionByName(part)
    n = F.row_number().over(Window.partitionBy(key).orderBy("_list"))
    return out.withColumn("_n", n).where("_n = 1").drop("_n", "_list")


# ---- validation -----------------------------------------------------------------------------------------

def validated(usages: DataFrame, fields: DataFrame) -> DataFrame:
    """id, path, resolved, reason, missing, target of usages (id, model, method, path), by one join to
    fields for each level, all usages together. fields is the metadata of a project and may be large,
    so nothing forces its broadcast. There are as many levels as the longest path has segments.
    """
    norm = F.when(F.col("method") == "order_by", F.regexp_replace(F.trim("path"), "^-", "")).otherwise(F.trim("path"))
    at = usages.select("id", "model", "method", "path").withColumn("segments", F.filter(F.split(norm, "__"), lambda s: s != ""))
    at = at.withColumns({"at": F.col("model"), "used": F.lit(0), "kind": F.lit(None).cast("string"), "target": F.lit(None).cast("string"), "relation": F.lit(False), "open": F.lit(True)})
    table = visible(fields, "filter").select(F.col("model").alias("_m"), F.col("name").alias("_n"), F.col("kind").alias("_k"), F.col("target").alias("_t"), F.col("is_relation").alias("_r"), (F.col("provenance") == "related_query_alias").alias("_alias"))
    attribute = F.col("method").isin(*ATTRIBUTE_PATH)
    for i in range(at.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0]):
        at = stored(at) if i % 8 == 7 else at  # short plans for long paths
        name = F.get("segments", F.lit(i))
        j = at.join(table, (F.col("at") == F.col("_m")) & (name == F.col("_n")) & F.col("open") & ~(attribute & F.col("_alias")), "left")
        hit = F.col("_n").isNotNull()
        at = j.select(
            "id", "model", "method", "path", "segments", F.when(hit, F.when(F.col("_r"), F.col("_t"))).otherwise(F.col("at")).alias("at"), (F.col("used") + hit.cast("int")).alias("used"),
            F.when(hit, F.col("_k")).otherwise(F.col("kind")).alias("kind"), F.when(hit, F.col("_n")).otherwise(F.col("target")).alias("target"), F.when(hit, F.col("_r")).otherwise(F.col("relation")).alias("relation"), (F.col("open") & hit).alias("open"),
        )
    n = F.size("segments")
    rest = F.slice("segments", F.col("used") + 1, F.greatest(n - F.col("used"), F.lit(0)))
    base = F.regexp_replace("kind", "^reverse_", "")
    lookups, changed = _table_of(LOOKUPS), {k: {t: out for t, (out, kinds) in TRANSFORMS.items() if k in kinds} for k in LOOKUPS}
    outputs = F.create_map(*(x for k, ts in changed.items() for t, out in ts.items() for x in (F.lit(f"{k}/{t}"), F.lit(out))))

    def step(a: F.Column, s: F.Column) -> F.Column:
        """State after one operator: kind, whether a lookup ended it, the first segment that fits nothing."""
        to = F.element_at(outputs, F.concat(a["kind"], F.lit("/"), s))
        takes = F.array_contains(F.coalesce(F.element_at(lookups, a["kind"]), F.array(*map(F.lit, DEFAULT_LOOKUPS))), s)
        ok = a["bad"].isNull()
        return F.struct(
            F.when(ok & ~a["ended"] & to.isNotNull(), to).otherwise(a["kind"]).alias("kind"), (a["ended"] | (ok & to.isNull() & takes)).alias("ended"),
            F.when(~ok, a["bad"]).when(a["ended"] | (to.isNull() & ~takes), s).alias("bad"),
        )

    end = F.aggregate(rest, F.struct(base.alias("kind"), F.lit(False).alias("ended"), F.lit(None).cast("string").alias("bad")), step)
    filters = F.col("method").isin(*FILTERS)
    missing = F.get("segments", F.col("used"))
    reason = (
        F.when(n == 0, "empty").when(F.col("used") == 0, "segment_not_found")
        .when((F.col("used") < n) & filters, F.when(end["bad"].isNotNull(), "invalid_lookup_operator"))
        .when(F.col("used") < n, F.when(F.col("relation"), "segment_not_found").otherwise("non_relation_intermediate"))
        .when(F.col("method").isin(*RELATION_ONLY) & ~F.col("relation"), "relation_required")
    )
    out = at.withColumn("reason", F.coalesce(reason, F.lit("")))
    lost = F.when(F.col("reason") == "invalid_lookup_operator", end["bad"]).when(F.col("reason") == "non_relation_intermediate", F.get("segments", F.col("used") - 1)).when(F.col("reason") == "segment_not_found", missing)
    return out.select("id", "path", (F.col("reason") == "").alias("resolved"), "reason", F.coalesce(lost, F.lit("")).alias("missing"), F.coalesce("target", F.lit("")).alias("target"))


def direct_errors(usages: DataFrame, fields: DataFrame) -> DataFrame:
    """id, model, name of usages (id, model, name) that name no field of their own model: create, update, constraints
    and bulk_update take no traversal, no operator and no reverse relation."""
    own = fields.where("direction is distinct from 'reverse'").select("model", "name").distinct()
    return usages.join(own, ["model", "name"], "left_anti").select("id", "model", "name")


def _table_of(table: dict[str, tuple[str, ...]]) -> F.Column:
    return F.create_map(*(x for k, ns in table.items() for x in (F.lit(k), F.array(*map(F.lit, ns)))))


def diagnostics(results: DataFrame) -> DataFrame:
    """id, severity, message of paths that do not resolve; an ambiguous target is a warning."""
    p, m = F.col("path"), F.col("missing")
    message = (
        F.when(F.col("reason") == "segment_not_found", F.format_string("Unknown field `%s` in lookup `%s`.", m, p))
        .when(F.col("reason") == "non_relation_intermediate", F.format_string("`%s` in lookup `%s` is no relation.", m, p))
        .when(F.col("reason") == "invalid_lookup_operator", F.format_string("Unknown operator `%s` in lookup `%s`.", m, p))
        .when(F.col("reason") == "relation_required", F.format_string("`%s` must end at a relation.", p))
        .otherwise(F.format_string("`%s`: %s.", p, F.col("reason")))
    )
    return results.where("reason <> ''").select("id", F.when(F.col("reason") == "ambiguous", "warning").otherwise("error").alias("severity"), message.alias("message"))


def without_unfinished(results: DataFrame, offered: DataFrame) -> DataFrame:
    """Unresolved results without those whose path only begins a longer name that is offered (id, name)."""
    longer = offered.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    begun = (F.col("id") == F.col("_id")) & F.col("_name").startswith(F.col("path")) & (F.length("_name") > F.length("path"))
    return results.where("reason <> ''").join(longer, begun, "left_anti")
