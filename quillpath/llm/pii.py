"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

Everything that touches documents is DataFrame functions. The trees are grown on the driver from a
small set of made-up spans, whose features the same functions compute, and become expressions.
"""

from __future__ import annotations

from collections.abc import Callable
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive repeats and the look-behind change no match; they keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a base pattern to match it, as a cheap test.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_AT = r" ?(?:@|\(at\)|\[at\]|\{at\}|(?<= )at(?= )) ?"
_LOCAL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+"
_NEEDS_AT = r"(?i)@|[(\[{]at[)\]}]| at "
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
#: Generators of further candidates, with their kind and a cheap test that every text with a match passes.
#: Each is wide; most of what it gives is rejected. Where two of a kind give different spans, the likelier one counts.
GENERATORS = (
    ("email", _LOCAL + _AT + r"[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= )) ?[A-Za-z0-9-]{1,63}){1,4}", _NEEDS_AT),
    ("email", _LOCAL + _AT + r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}", _NEEDS_AT),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    ("ip", rf"(?<![0-9A-Za-z:.])(?=(?:[0-9A-Fa-f]{{0,4}}:){{2,8}}[0-9A-Fa-f]{{0,4}}(?![0-9A-Za-z:]))(?:{_GROUPS})?::(?:{_GROUPS})?(?![0-9A-Za-z:])", "::"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ ./-]{0,2}+[0-9]){12,18}+(?![0-9A-Za-z])", "[0-9](?:[ ./-]{0,2}[0-9]){12}"),
    ("phone", r"(?<![0-9A-Za-z.+])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])", "[0-9]{2,4}[)]?[ ./-]{1,2}[0-9]{3,4}"),
    ("phone", r"(?<![0-9A-Za-z.+])\([0-9]{2,4}\)[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])", r"\([0-9]{2,4}\)[0-9]{3}"),
    ("phone", r"(?<![0-9A-Za-z.+])(?:\([0-9]{2,4}\)[ ./-]{0,2}|[0-9]{2,4}[ ./-]{1,2})[0-9]{2}(?:[ ./-]{1,2}[0-9]{2}){2,4}(?![0-9A-Za-z])", "[0-9]{2}(?:[ ./-]{1,2}[0-9]{2}){2}"),
)
_SPAN = "array<struct<kind:string,start:int,end:int,text:string,before:string,after:string>>"
#: Characters before and after a span that its features see.
CONTEXT = 24
#: Matches of a text that are placed together.
BLOCK = 64


def _apply(name: str, array: Column, function: str) -> Column:
    """A higher-order function with its function written in SQL. Expressions of thousands of calls are SQL texts here, as PySpark takes milliseconds for each call."""
    return F.call_function(name, array, F.expr(function))


def _located(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches with their places in code points: what lies between them gives the places.

    Places add up in blocks of BLOCK matches, so that no long array is copied for each match.
    """
    cut = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none, blocks = f"cast(array() as {_SPAN})", f"sequence(0, greatest(cast(ceil(size(s.found) / {BLOCK}) as int) - 1, 0))"
    numbers = f"sequence(b * {BLOCK}, least((b + 1) * {BLOCK}, size(s.found)) - 1)"
    start, m = "a.at + length(get(s.between, i))", "get(s.found, i)"
    span = f"named_struct('kind', '{kind}', 'start', {start}, 'end', {start} + length({m}), 'text', {m}, 'before', lower(right(get(s.between, i), {CONTEXT})), 'after', left(get(s.between, i + 1), {CONTEXT}))"
    sums = f"transform({blocks}, b -> aggregate({numbers}, 0, (x, i) -> x + length(get(s.between, i)) + length({m})))"
    each = f"aggregate({numbers}, named_struct('at', get(first, b), 'spans', {none}), (a, i) -> named_struct('at', {start} + length({m}), 'spans', array_append(a.spans, {span})), a -> a.spans)"
    first = f"aggregate({sums}, array(0), (x, v) -> array_append(x, element_at(x, -1) + v))"
    return _apply("transform", F.array(cut), f"s -> if(size(s.found) = 0, {none}, transform(array({first}), first -> flatten(transform({blocks}, b -> {each})))[0])")[0]


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(number: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    d = "cast(substr(n, length(n) - i, 1) as int)"
    doubled = f"if(i % 2 = 1, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d})"
    return f"transform(array({number}), n -> length(n) > 0 and aggregate(sequence(0, greatest(length(n), 1) - 1), 0, (x, i) -> x + {doubled}) % 10 = 0)[0]"


def _valid(kind: str, m: str) -> str:
    if kind == "email":
        return "true"
    if kind == "ip":
        return rf"{m} rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){{4}}$'"
    if kind == "card":
        return f"(length({_digits(m)}) between 16 and 19 and {_luhn(_digits(m))})"
    return f"length({_digits(m)}) between 8 and 15"


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> list[Column]:
    """Spans of each kind's base pattern that hold, ascending."""
    empty = F.array().cast(_SPAN)
    found = []
    for kind in KINDS:
        needed = text.contains(NEEDS[kind]) if kind == "email" else text.rlike(NEEDS[kind])
        found.append(F.when(needed, _apply("filter", _located(text, BASE[kind], kind), f"s -> {_valid(kind, 's.text')}")).otherwise(empty))
    return found


def proposed(text: Column) -> list[Column]:
    """What each generator proposes, ascending; spans of different generators may overlap."""
    empty = F.array().cast(_SPAN)
    return [F.when(text.rlike(need), _located(text, pattern, kind)).otherwise(empty) for kind, pattern, need in GENERATORS]


def candidates(text: Column) -> Column:
    """What the generators propose, once; for short texts, as repeats are looked for among all."""
    return F.array_distinct(F.concat(*proposed(text)))


# ---- runs: ascending spans that do not overlap each other, searched by bisection ------------------


def _below(ascending: str, x: str) -> str:
    """How many numbers of an ascending array are below x."""
    steps = ", ".join(str(1 << k) for k in range(30, -1, -1))
    return f"aggregate(array({steps}), 0, (place, step) -> if(coalesce(get({ascending}, place + step - 1) < {x}, false), place + step, place))"


def _runs(spans: list[Column]) -> Column:
    """Starts, ends and the spans themselves of runs, to be bound to a name."""
    return F.struct(*(F.struct(a["start"].alias("start"), a["end"].alias("end"), a.alias("spans")).alias(f"run{k}") for k, a in enumerate(spans)))


def _end_before(runs: str, n: int, x: str) -> str:
    """The last end of a span that starts before x in any of n runs; 0 where none does."""
    last = (f"coalesce(get({runs}.run{k}.`end`, {_below(f'{runs}.run{k}.start', x)} - 1), 0)" for k in range(n))
    return f"greatest({', '.join(last)})"


def _overlapping(run: str, s: str) -> str:
    """The spans of a run that overlap s."""
    upto = _below(f"{run}.start", f"{s}.`end`")
    return f"transform(array({_below(f'{run}.`end`', f'{s}.start + 1')}), low -> slice({run}.spans, low + 1, greatest({upto} - low, 0)))[0]"


# ---- features, trees, thresholds -------------------------------------------------------------------


def features(c: str) -> str:
    """Numbers about a candidate's format and context, as an array."""
    t, before, after, n = f"{c}.text", f"{c}.before", f"{c}.after", _digits(f"{c}.text")
    flag = lambda x: f"cast(coalesce({x}, false) as double)"
    count = lambda p: f"cast(regexp_count({t}, r'{p}') as double)"
    like = lambda x, p: f"{x} rlike r'{p}'"
    near = lambda words: flag(like(before, rf"(?:{words})[^a-z0-9]*(?:[a-z]+[^a-z0-9]*)?$"))
    numbers = [
        *(flag(f"{c}.kind = '{k}'") for k in KINDS),
        f"cast(length({n}) as double)",
        f"cast(length({t}) as double)",
        count("[ ]"), count("[.]"), count("[-/]"), count("[()\\[\\]{}]"),
        flag(f"length({n}) between 13 and 19 and {_luhn(n)}"),
        flag(like(t, r"(?i)[(\[{]at[)\]}]")),
        flag(like(t, r"(?i)[(\[{]dot[)\]}]|\.")),
        flag(like(t, r"^(?:[0-9]{4}[ ./-]){3}[0-9]{4}$|^3[47][0-9]{2}[ ./-]?[0-9]{6}[ ./-]?[0-9]{5}$")),
        flag(like(t, r"^\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$")),
        flag(like(t, r"^(?:19|20)[0-9]{2}[./-]|^[0-9]{1,2}[./-][0-9]{1,2}[./-]")),
        near("tel|phone|call|fax|mobile|cell"),
        near("card|visa|mastercard|amex|credit"),
        near("mail|contact|write to|reach"),
        near("ip|host|addr|address|server"),
        near("order|no|nr|id|isbn|ref|version|token|date"),
        flag(like(before, "[a-z0-9]$")),
        flag(like(after, "^[0-9A-Za-z]")),
        flag(f"{like(before, r'[0-9][ .,-]*$')} or {like(after, r'^[ .,-]*[0-9]')}"),
        count("[:]"), flag(f"contains({t}, '::')"), flag(f"contains({t}, '@')"), flag(like(t, "(?i) at ")), flag(f"contains({t}, '. ')"),
        flag(like(t, r"(?i)(?:\.|[(\[{]dot[)\]}] ?)[a-z]{2,6}$")),
        flag(like(t, r"^0[1-9]([ ./-])[0-9]{2}(?:\1[0-9]{2}){3}$")),
    ]
    return f"array({', '.join(numbers)})"


def _examples(seed: int = 3) -> list[tuple[str, int]]:
    """Made-up texts with one candidate each and whether it is personal data."""
    rng = np.random.Generator(np.random.PCG64(seed))
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[rng.integers(len(x))]
    name = lambda: "".join(pick(*"abdehiklmnoprstu") for _ in range(rng.integers(3, 9)))

    def checked(body: str, right: bool) -> str:
        total = sum((2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) if i % 2 == 0 else int(x) for i, x in enumerate(reversed(body)))
        last = -total % 10
        return body + str(last if right else (last + rng.integers(1, 10)) % 10)

    def grouped(n: str) -> str:
        sep = pick(".", "/", "-", " ", "")
        return sep.join((n[:4], n[4:10], n[10:])) if len(n) == 15 else sep.join(n[i : i + 4] for i in range(0, len(n), 4))

    out = []
    for _ in range(260):
        mail = pick("mail: ", "contact ", "e-mail ", "write to ", "")
        out.append((f"{mail}{name()} {pick('(at)', '[at]', '{at}')} {name()} {pick('(dot)', '[dot]', '.')} {pick('com', 'org', 'net')}", 1))
        out.append((f"the {name()} at {name()} dot {name()} {name()}", 0))
        out.append((f"{name()} at {name()} [dot] {name()} {name()}", 0))
        out.append((pick("card ", "visa ", "", "paid by ") + grouped(checked("4" + d(14), True)), 1))
        out.append((pick("amex ", "card ", "") + grouped(checked("37" + d(12), True)), 1))
        out.append((pick("order no ", "", "ref ", f"{name()} ") + grouped(checked(d(15), False)), 0))
        out.append((pick("id ", "", "token ") + checked(d(int(rng.integers(12, 17))), False), 0))
        out.append((f"isbn 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", 0))
        out.append((pick("call ", "tel. ", "phone: ", "") + pick(f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"), 1))
        out.append((pick("tel ", "fax ", "mobile: ") + f"0{d(3)} {d(3)} {d(4)}", 1))
        out.append((pick("", "date ", f"{name()} ") + f"{pick('19', '20')}{d(2)}-{d(4)} {d(4)}", 0))
        out.append((pick("", "order ", f"{name()} ") + f"{d(3)} {d(3)} {d(3)}", 0))
        out.append((f"{d(2)} {d(4)} {d(4)} {d(2)} {d(3)} {name()}", 0))
        out.append((pick("", "version ", "no ") + f"{d(2)}.{d(3)}.{d(3)}", 0))
        out.append((pick("ip ", "host ", "", "server ") + ":".join(f"{rng.integers(0x1000, 0xFFFF):x}" for _ in range(8)), 1))
        out.append((":".join(d(2) for _ in range(8)), 0))
        some = lambda low, high: ":".join(f"{rng.integers(1, 0xFFFF):x}" for _ in range(rng.integers(low, high)))
        out.append((pick("ip ", "host ", "", "server ", "address ") + pick(f"2001:db8::{some(1, 4)}", f"fe80::{some(2, 5)}", f"{some(2, 4)}::{some(1, 4)}"), 1))
        out.append((pick("", f"{name()} ", "in ") + pick("add::face", "a::b", "::", "dead::beef", f"{pick(*'abcdef')}::{pick('add', 'bad', 'fed', 'dad')}", "::add"), 0))
        place, word = pick("com", "org", "net", "de", "fr"), f"{name()} at {name()}"
        out.append((f"{mail}{pick(name(), name() + '.' + name())}{pick(' @ ', ' @', '@ ')}{name()}.{place}", 1))
        out.append((pick("mail: ", "contact ", "e-mail ", "write to ") + f"{word}.{place}", 1))
        out.append((pick("we met ", "it was ", f"{name()}. ") + f"{word}.{pick(' ', '  ')}{name().capitalize()}", 0))
        out.append((f"{word}. {name()}. {name().capitalize()}", 0))
        out.append((pick("we met ", "", "it was ") + f"{name()}{pick('', '.', '. ')} at {name()}. {pick('La', 'De', 'The', 'It', name())}", 0))
        between = pick(" ", ".", "-", " ")
        out.append((pick("tel ", "call ", "", "mobile: ", "fax ") + between.join([f"0{rng.integers(1, 10)}", *(d(2) for _ in range(4))]), 1))
        out.append((pick("", "order ", "no ", f"{name()} ") + between.join([f"{rng.integers(1, 10)}{d(1)}", *(d(2) for _ in range(rng.integers(3, 6)))]), 0))
        out.append((" ".join([f"0{rng.integers(1, 10)}", *(d(2) for _ in range(rng.integers(5, 12)))]), 0))
    return [(f"{name()} {name()} {t} {name()}", y) for t, y in out]


class Trees:
    """Gradient-boosted regression trees of depth three under logistic loss; `trees` are nested tuples."""

    def __init__(self, rounds: int = 30, rate: float = 0.3, least: int = 12):
        self.rounds, self.rate, self.least = rounds, rate, least
        self.trees: list = []
        self.base = self.slope = self.shift = 0.0

    def _grow(self, bins: np.ndarray, values: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int):
        """bins has the place of each number among its feature's values; every place between two is tried as a cut, from sums by place."""
        leaf = float(self.rate * g.sum() / (h.sum() + 1.0))
        best = (1e-6, None)
        for f in range(bins.shape[1]) if depth else ():
            n, gs, hs = (np.cumsum(np.bincount(bins[:, f], w, len(values[f]))) for w in (None, g, h))
            gain = gs**2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0) - gs[-1] ** 2 / (hs[-1] + 1.0)
            gain[(n < self.least) | (n > len(g) - self.least)] = 0.0
            if gain.max() > best[0]:
                best = (float(gain.max()), (f, int(gain.argmax())))
        if best[1] is None:
            return leaf
        f, place = best[1]
        left = bins[:, f] <= place
        return f, float(values[f][place]), self._grow(bins[left], values, g[left], h[left], depth - 1), self._grow(bins[~left], values, g[~left], h[~left], depth - 1)

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, self._value(a, x), self._value(b, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Every third row is kept from the trees and calibrates their margin by a logistic line."""
        hold = np.arange(len(x)) % 3 == 2
        xt, yt = x[~hold], y[~hold]
        self.base = float(np.log(yt.mean() / (1 - yt.mean())))
        values, places = zip(*(np.unique(column, return_inverse=True) for column in xt.T), strict=True)
        bins, margin = np.stack(places, axis=1), np.full(len(xt), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            self.trees.append(self._grow(bins, list(values), yt - p, p * (1 - p), 3))
            margin = margin + self._value(self.trees[-1], xt)
        m, yh = self.margin(x[hold]), y[hold]
        a, b = 1.0, 0.0
        for _ in range(200):
            e = 1 / (1 + np.exp(-(a * m + b))) - yh
            a, b = a - 0.05 * float((e * m).mean() + 1e-3 * (a - 1)), b - 0.05 * float(e.mean())
        self.slope, self.shift = a, b
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def expression(self, x: str) -> str:
        def of(tree) -> str:
            return f"{tree!r}D" if not isinstance(tree, tuple) else f"if({x}[{tree[0]}] <= {tree[1]!r}D, {of(tree[2])}, {of(tree[3])})"

        total = " + ".join([f"{self.base!r}D", *map(of, self.trees)])
        return f"1 / (1 + exp(-({self.slope!r}D * ({total}) + {self.shift!r}D)))"


#: Share of right ones among the accepted calibration spans that a kind's threshold must reach.
PRECISION = 0.99
#: What trained() gave, as it depends on nothing but this module.
_TRAINED: list[tuple[Trees, dict[str, float]]] = []


def trained(spark: SparkSession) -> tuple[Trees, dict[str, float]]:
    """Trees, and for each kind the least probability from which PRECISION is kept on the calibration rows. Grown once in a process."""
    if _TRAINED:
        return _TRAINED[0]
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(_examples())], "i int, text string, y int")
    each = rows.select("i", "y", F.explode(candidates(F.col("text"))).alias("c")).select("i", "y", "c.kind", F.expr(features("c")).alias("x"))
    got = sorted((r["i"], r["kind"], r["y"], r["x"]) for r in each.collect())
    x, y, kind = np.array([r[3] for r in got]), np.array([r[2] for r in got], float), np.array([r[1] for r in got])
    model = Trees().fit(x, y)
    hold = np.arange(len(x)) % 3 == 2
    p = model.probability(x)
    cuts = {}
    for k in KINDS:
        own = hold & (kind == k)
        steps = [c for c in np.arange(0.5, 1.0, 0.02) if (a := own & (p >= c)).any() and y[a].mean() >= PRECISION]
        cuts[k] = float(min(steps, default=2.0))
    _TRAINED.append((model, cuts))
    return model, cuts


def with_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with base and more, arrays of spans (kind, start, end in code points, end exclusive).

    base has what the base patterns find. more has the generators' candidates whose calibrated
    probability reaches the threshold of their kind, without those that overlap a base span or a
    likelier one of any kind. Null texts have none; repeated rows stay. Each pattern's matches are a
    run, so what overlaps a span is found by bisection, and a text's cost grows as n log n with its spans.
    """
    model, cuts = trained(documents.sparkSession)
    slim = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    t = F.coalesce(F.col(text), F.lit(""))
    found = documents.withColumn("base", F.struct(*(a.alias(k) for k, a in zip(KINDS, base_spans(t), strict=True))))
    found = found.withColumn("_proposed", F.struct(*(a.alias(f"g{g}") for g, a in enumerate(proposed(t)))))

    # proposals that no base span overlaps, with the number of their generator
    own = lambda g: f"transform(filter(_proposed.g{g}, c -> {_end_before('runs', len(KINDS), 'c.`end`')} <= c.start), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.`end`, 'text', c.text, 'before', c.before, 'after', c.after, 'g', {g}))"
    free = _apply("transform", F.array(_runs([F.col("base")[k] for k in KINDS])), f"runs -> concat({', '.join(own(g) for g in range(len(GENERATORS)))})")[0]
    cut = " ".join(f"when '{k}' then {v!r}D" for k, v in cuts.items())
    score = f"c -> transform(array({features('c')}), v -> named_struct('p', {model.expression('v')}, 'kind', c.kind, 'start', c.start, 'end', c.`end`, 'g', c.g))[0]"
    any_proposed = F.greatest(*(F.size(F.col("_proposed")[f"g{g}"]) for g in range(len(GENERATORS)))) > 0
    found = found.withColumn("_likely", F.when(any_proposed, _apply("filter", _apply("transform", free, score), f"s -> s.p >= case s.kind {cut} end")).otherwise(F.array()))

    # of overlapping spans the least counts: the likelier, then the earlier, the first kind, the longer, the first generator
    order = lambda s: f"named_struct('p', -{s}.p, 'start', {s}.start, 'kind', {s}.kind, 'end', -{s}.`end`, 'g', {s}.g)"
    beaten = " or ".join(f"exists({_overlapping(f'runs.run{g}', 's')}, o -> {order('o')} < {order('s')})" for g in range(len(GENERATORS)))
    by_generator = _runs([_apply("filter", F.col("_likely"), f"s -> s.g = {g}") for g in range(len(GENERATORS))])
    unbeaten = _apply("transform", F.array(by_generator), f"runs -> filter(_likely, s -> not ({beaten}))")[0]
    more = F.when(F.size("_likely") > 1, unbeaten).otherwise(F.col("_likely"))
    return found.withColumn("more", slim(more)).withColumn("base", slim(F.concat(*(F.col("base")[k] for k in KINDS)))).drop("_proposed", "_likely")


def listed(spans: Column) -> Column:
    """kind:start:end of all spans by kind as in KINDS, then start."""
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    parts = [F.transform(F.array_sort(F.transform(F.filter(spans, _of(k)), place)), written) for k in KINDS]
    return F.array_join(F.concat(*parts), ",")


def span_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    found = with_spans(documents.select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "more")).alias("spans"))


#: Code points of a block of a long text, from which pieces are cut.
CUT = 4096


def _without(n: int) -> str:
    """A text with marks for its spans, from x.spans, which ascend by start and falling length, x.runs, the same in n runs, and x.blocks of CUT code points."""
    first = f"(s, i) -> {_end_before('x.runs', n, 's.start')} <= s.start and (i = 0 or get(x.spans, i - 1).start < s.start)"
    low, high = f"cast(floor(e.a / {CUT}) as int)", f"cast(floor((e.b - 1) / {CUT}) as int)"
    own = f"array_join(slice(x.blocks, {low} + 1, {high} - {low} + 1), '')"
    piece = lambda a, b: f"transform(array(named_struct('a', {a}, 'b', {b})), e -> if(e.a < e.b, substr({own}, e.a - {low} * {CUT} + 1, e.b - e.a), ''))[0]"
    marked = f"s -> concat({piece(_end_before('x.runs', n, 's.start'), 's.start')}, '[', upper(s.kind), ']')"
    rest = piece(_end_before("x.runs", n, "2147483647"), "x.length")
    return f"x -> array_join(concat(transform(filter(x.spans, {first}), {marked}), array({rest})), '')"


def redacted(documents: DataFrame) -> DataFrame:
    """documents with every span of text replaced by its kind in brackets, and n_chars after it.

    Of overlapping spans the first, or the longer of two with one start, gives the mark, and all that they cover goes.
    Null texts stay null. Columns of any names stay as they are.
    """
    found = with_spans(documents.select(F.struct(*documents.columns).alias("row"), "text"))
    sorted_ = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"), s["end"].alias("end"))))
    found = found.withColumn("_all", sorted_(F.concat("base", "more")))
    # what was added overlaps nothing, so it is a run beside those of the kinds
    runs = _runs([*(F.filter("base", _of(k)) for k in KINDS), sorted_(F.col("more"))])
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}+"), F.lit(0))
    given = F.struct(F.col("_all").alias("spans"), runs.alias("runs"), blocks.alias("blocks"), F.length("text").alias("length"))
    done = _apply("transform", F.array(given), _without(len(KINDS) + 1))[0]
    out = found.select("row", F.when(F.size("_all") > 0, done).otherwise(F.col("text")).alias("text"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.length("text").cast(documents.schema["n_chars"].dataType).alias("n_chars")
        return F.col("row")[name].alias(name)

    return out.select(*(column(name) for name in documents.columns))
