"""Personal data by candidate gradient boosting, with DataFrame functions alone.

Base spans follow four fixed patterns with checks.  High-recall generators
propose further, overlapping spans: every sequence of neighbouring digit groups
with 8 to 19 digits, every dotted quad, and address-like strings.  Boosted trees
see each proposal's format (digits, groups, separators, sign, check digit,
octets) and context (what stands before and behind, nearby words).  They learn
from weak rules that hold wherever a proposal stands, also where the fixed
patterns swallow or miss it (RIGHT), on all documents outside the calibration
fold: the trees need no more than how often each combination of features is
right, a table whose size the features' ranges bound.  On the fold, isotonic
calibration finds for each kind the lowest margin that is right at least TARGET
of the time, and the threshold lies halfway between it and the next lower one; new spans above it are added, base spans always stay.

Texts are read once: digit zones and addresses, with what stands beside them,
are written to the shared folder; the rest works on a row for each proposal.
No expression inside a lambda function refers to a computed column outside it,
since the engine would then compute that column anew for each element.

Null text is empty; rows are independent, so ties and repeated rows give equal
rows; other columns are ignored; an empty table gives an empty table.  A null
doc_id teaches the trees.  Without any right proposal nothing is added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, written so that each attempt ends where it must (no backtracking over long runs).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: A longest run of digits and signs between them: no match of the last three patterns reaches beyond one.
ZONE = r"[+(]?[0-9][0-9 ().+/-]*[0-9]"
ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?@ ?| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)++"
WORDS = r"(?i)(tel|fon|fax|mobil|call|card|kart|carte|tarjeta|visa|\bip\b|mail|host|addr)"
#: Digit groups that one proposal may join; more than 19 groups have more than 19 digits.
GROUPS = 19
#: Code points before a zone or an address in which words are looked for.
NEAR = 24
FEATURES = ("kind", "digits", "groups", "signs", "plus", "left", "right", "check", "octets", "longest", "words")
#: The weak rules by kind: an address whose last label is a word; a quad of octets that no dot carries on; a number of
#: evenly grouped digits with its check digit; a number that stands alone behind a plus sign or a telling word.
RIGHT = """case kind
  when 0 then longest between 2 and 6 and tail rlike '^[A-Za-z]+$'
  when 1 then octets = 1 and groups = 4 and left <> 6 and right <> 6
  when 2 then check = 1 and signs < 3 and (groups = 1 or longest = 4)
  else digits between 8 and 15 and right < 4 and (plus = 1 or (words = 1 and left < 4)) end"""
TREES, RATE, TARGET, FOLDS = 24, 0.3, 0.9, 5


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` standing for `value`, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _starts(lengths: str) -> str:
    """Exclusive prefix sums of an array of lengths, in pieces of 256 so that long arrays stay cheap."""
    sums = """aggregate(
      transform(sequence(0, greatest(cast(ceil(size(w) / 256) as int) - 1, 0)), c -> slice(w, c * 256 + 1, 256)),
      named_struct('done', cast(array() as array<bigint>), 'total', 0L),
      (o, part) -> aggregate(part, named_struct('mine', cast(array() as array<bigint>), 'total', o.total),
        (a, x) -> named_struct('mine', concat(a.mine, array(a.total)), 'total', a.total + x),
        a -> named_struct('done', concat(o.done, a.mine), 'total', a.total)),
      o -> o.done)"""
    return _let(lengths, "w", sums)


def _spans(text: str, pattern: str) -> str:
    """Array of (at, to, hit, before, behind) of the pattern's matches, in code points."""
    p = _quoted(pattern)
    sizes = _starts("transform(m.h, (x, i) -> cast(length(x) + length(m.g[i]) as bigint))")
    each = f"""transform(q.h, (x, i) -> named_struct('at', q.s[i] + length(q.g[i]), 'to', q.s[i] + length(q.g[i]) + length(x),
      'hit', x, 'before', right(q.g[i], {NEAR}), 'behind', left(q.g[i + 1], 1)))"""
    with_starts = _let(f"named_struct('h', m.h, 'g', m.g, 's', {sizes})", "q", each)
    return _let(f"named_struct('h', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))", "m", with_starts)


def _only_digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    term = "cast(substr(ds, length(ds) - k + 1, 1) as int) * if(k % 2 = 0, 2, 1)"
    return _let(digits, "ds", f"aggregate(sequence(1, length(ds)), 0, (s, k) -> s + if({term} > 9, {term} - 9, {term})) % 10 = 0")


def _checked(kind: str, hits: str) -> str:
    """(at, to) of the matches that pass their kind's check."""
    d = _only_digits("y.hit")
    fits = {
        "email": "true",
        "ip": f"y.hit rlike {_quoted(OCTETS)}",
        "card": f"if(length({d}) between 16 and 19, {_luhn(d)}, false)",
        "phone": f"length({d}) between 8 and 15",
    }[kind]
    return f"transform(filter({hits}, y -> {fits}), y -> named_struct('at', y.at, 'to', y.to))"


def marked(docs: DataFrame) -> DataFrame:
    """A row for each document: its checked base spans, its digit zones and its addresses with what stands beside them."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    at = " or ".join(f"contains(text, '{a}{b}{c}')" for a in "[(" for b in ("at", "AT") for c in "])")
    of = lambda when, pattern: _spans(f"if({when}, text, '')", pattern)
    base = [f"'{k}', if(length({_only_digits('z.hit')}) >= {least}, {_checked(k, _spans('z.hit', BASE[k]))}, cast(array() as array<struct<at:bigint,to:bigint>>))" for k, least in (("ip", 4), ("card", 16), ("phone", 8))]
    zones = f"filter({of('text rlike ' + _quoted('[0-9]'), ZONE)}, z -> length({_only_digits('z.hit')}) >= 4)"
    zones = f"transform({zones}, z -> named_struct('at', z.at, 'to', z.to, 'hit', z.hit, 'before', z.before, 'behind', z.behind, {', '.join(base)}))"
    return df.select(
        "row",
        "doc_id",
        F.expr(_checked("email", of("contains(text, '@')", BASE["email"]))).alias("email"),
        F.expr(of(f"contains(text, '@') or {at}", ADDRESS)).alias("addresses"),
        F.expr(zones).alias("zones"),
    )


def _absolute(kind: str) -> Column:
    """The base spans of all zones, in places of the text."""
    return F.expr(f"flatten(transform(zones, z -> transform(z.{kind}, y -> named_struct('at', z.at + y.at, 'to', z.at + y.to))))")


def _side(sign: str) -> str:
    """Class of a neighbouring sign: 0 none or blank, 1 letter, 2 digit, 3 other."""
    return f"case when {sign} is null or {sign} = '' or {sign} rlike '^\\\\s$' then 0 when {sign} rlike '^\\\\p{{L}}$' then 1 when {sign} rlike '^[0-9]$' then 2 else 3 end"


def _inside(sign: str) -> str:
    """Class of a sign that stands beside a span inside its zone: 4 blank, 5 other, 6 dot."""
    return f"case when {sign} = ' ' then 4 when {sign} = '.' then 6 else 5 end"


def _numbers(rows: DataFrame) -> DataFrame:
    """A row for each sequence of neighbouring digit groups."""
    zone = rows.select("row", "fold", F.explode("zones").alias("z"))
    # in each zone its digit groups, what stands before each, and where each of the two begins
    groups = "named_struct('g', regexp_extract_all(z.hit, '[0-9]+', 0), 'b', split(z.hit, '[0-9]+', -1))"
    begins = _starts("transform(u.g, (t, e) -> cast(length(t) + length(u.b[e]) as bigint))")
    parts = zone.withColumn("p", F.expr(_let(groups, "u", f"named_struct('g', u.g, 'b', u.b, 's', {begins})")))
    windows = f"""transform(sequence(0, size(v.g) - 1), i -> named_struct('i', i, 'n', size(v.g), 'at', v.s[i] + length(v.b[i]), 'g', slice(v.g, i + 1, {GROUPS}), 'b', slice(v.b, i + 1, {GROUPS + 1})))"""
    # a base span as one number, to look a proposal up by
    keys = f"concat({', '.join(f'transform(z.{k}, y -> (y.at * 1048576L + (y.to - y.at)) * 4 + {i})' for i, k in enumerate(KINDS) if i)})"
    spans = "concat(z.ip, z.card, z.phone)"
    each = parts.select(
        "row", "fold", F.col("z.at").alias("zone"), F.col("z.before").alias("before"), F.col("z.behind").alias("behind"),
        F.expr(keys).alias("keys"), F.expr(spans).alias("base"), F.explode(F.expr(_let("p", "v", windows))).alias("w"),
    )
    # the digits and the place behind each number of groups; dotted quads may be short
    ends = """transform(sequence(1, size(t.g)), j -> named_struct('j', j, 'digits', aggregate(slice(t.g, 1, j), 0, (s, x) -> s + length(x)),
      'quad', j = 4 and t.b[1] = '.' and t.b[2] = '.' and t.b[3] = '.'))"""
    ends = f"filter({ends}, e -> e.digits between 8 and 19 or (e.quad and e.digits < 8))"
    each = each.withColumn("c", F.explode(F.expr(_let("w", "t", ends))))
    hit = _let("named_struct('g', w.g, 'b', w.b, 'j', c.j)", "t", "aggregate(if(t.j > 1, sequence(1, t.j - 1), cast(array() as array<int>)), t.g[0], (s, k) -> concat(s, t.b[k], t.g[k]))")
    each = each.select(
        "row", "fold", "zone", "base", "keys", "before", "behind", F.col("c.digits").alias("digits"), F.col("c.j").alias("groups"),
        F.expr("if(w.b[0] like '%+', 1, 0)").alias("plus"), F.col("w.at").alias("first"), F.expr(hit).alias("hit"),
        F.expr("if(w.i = 0, null, left(w.b[0], 1))").alias("a"), F.expr("if(w.i + c.j = w.n, null, left(w.b[c.j], 1))").alias("b"),
        F.expr("array_max(transform(slice(w.g, 1, c.j), x -> length(x)))").alias("longest"),
    )
    octets = f"if(hit rlike {_quoted(OCTETS)}, 1, 0)"
    signs = "regexp_replace(hit, '[0-9]', '')"
    shaped = each.select(
        "row", "fold", "zone", "base", "keys", "digits", "plus", (F.col("first") - F.col("plus")).alias("at"), (F.col("first") + F.length("hit")).alias("to"),
        F.least("groups", F.lit(7)).alias("groups"), F.expr(octets).alias("octets"),
        F.expr(f"case when {signs} = '' then 0 when {signs} rlike '^ +$' then 1 when {signs} rlike '^-+$' then 2 when {signs} rlike '^[.]+$' then 3 else 4 end").alias("signs"),
        F.expr(f"case when a is not null then {_inside('a')} else {_side('right(before, 1)')} end").alias("left"),
        F.expr(f"case when b is not null then {_inside('b')} else {_side('behind')} end").alias("right"),
        F.expr(f"if(digits >= 16, if({_luhn(_only_digits('hit'))}, 1, 0), 2)").alias("check"),
        "longest", F.expr(f"if(before rlike {_quoted(WORDS)}, 1, 0)").alias("words"), F.lit("").alias("tail"),
    )
    kind = F.expr("case when octets = 1 and groups = 4 then 1 when plus = 0 and digits >= 16 then 2 else 3 end")
    shaped = shaped.withColumn("kind", kind).withColumn("known", F.expr("array_contains(keys, (at * 1048576L + (to - at)) * 4 + kind)"))
    free = F.expr("not exists(base, y -> y.at < to and at < y.to)")
    return shaped.withColumn("free", free).withColumn("at", F.col("zone") + F.col("at")).withColumn("to", F.col("zone") + F.col("to"))


def _addresses(rows: DataFrame) -> DataFrame:
    """A row for each address-like string."""
    each = rows.select("row", "fold", F.explode("addresses").alias("z")).select("row", "fold", "z.*")
    digits = f"least(length({_only_digits('hit')}), 19)"
    tail = "element_at(split(hit, '[^A-Za-z0-9-]+'), -1)"
    shaped = each.select(
        "row", "fold", F.col("at").alias("zone"), F.expr(digits).alias("digits"), F.expr("if(hit like '%+%', 1, 0)").alias("plus"), "at", "to",
        F.expr("least(size(split(hit, '[.]')), 7)").alias("groups"), F.lit(0).alias("octets"), F.expr("if(hit like '% %', 1, 0)").alias("signs"),
        F.expr(_side("right(before, 1)")).alias("left"), F.expr(_side("behind")).alias("right"), F.lit(2).alias("check"),
        F.expr(f"least(length({tail}), 19)").alias("longest"), F.expr(f"if(before rlike {_quoted(WORDS)}, 1, 0)").alias("words"),
        F.expr(tail).alias("tail"), F.lit(0).alias("kind"),
    )
    # the few spans of the whole document are compared when the new ones have been chosen
    return shaped.withColumn("known", F.lit(False)).withColumn("free", F.lit(True))


def proposals(rows: DataFrame) -> DataFrame:
    """A row for each proposal of the marked documents: its place, its features, and whether it is right."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    folded = rows.withColumn("fold", fold)
    out = [x.select("row", "fold", "zone", "at", "to", "free", *(F.col(f).cast("int").alias(f) for f in FEATURES), (F.col("known") | F.coalesce(F.expr(RIGHT), F.lit(False))).alias("is_right")) for x in (_numbers(folded), _addresses(folded))]
    return out[0].unionByName(out[1])


@dataclass(frozen=True)
class Tree:
    """A leaf value, or a split: left where feature <= at."""

    value: float = 0.0
    feature: int = -1
    at: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def of(self, x: tuple) -> float:
        if self.feature < 0:
            return self.value
        return (self.left if x[self.feature] <= self.at else self.right).of(x)

    def sql(self, row: str) -> str:
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"if({row}.{FEATURES[self.feature]} <= {self.at}, {self.left.sql(row)}, {self.right.sql(row)})"


def _grow(rows: list[tuple], deep: int) -> Tree:
    """rows: (features, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Tree(value=round(-RATE * g / (h + 1), 9))
    best, gain = None, 1e-9
    if deep:
        for f in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for x, a, b in rows:
                s = by.setdefault(x[f], [0.0, 0.0])
                s[0] += a
                s[1] += b
            a = b = 0.0
            for v in sorted(by)[:-1]:
                a, b = a + by[v][0], b + by[v][1]
                new = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if new > gain:
                    best, gain = (f, v), new
    if best is None:
        return leaf
    f, v = best
    return Tree(0.0, f, v, _grow([r for r in rows if r[0][f] <= v], deep - 1), _grow([r for r in rows if r[0][f] > v], deep - 1))


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]

    def margin(self, x: tuple) -> float:
        return self.start + sum(t.of(x) for t in self.trees)


def boost(rows: list[tuple[tuple, int, int]]) -> Model:
    """rows: (features, right, wrong) counts, in a fixed order."""
    right, wrong = sum(r[1] for r in rows), sum(r[2] for r in rows)
    start = math.log((right + 1) / (wrong + 1))
    margins, trees = [start] * len(rows), []
    for _ in range(TREES if right else 0):
        work = []
        for (x, a, b), m in zip(rows, margins, strict=True):
            p = 1 / (1 + math.exp(-m))
            work.append((x, p * (a + b) - a, p * (1 - p) * (a + b)))
        tree = _grow(work, 3)
        trees.append(tree)
        margins = [m + tree.of(r[0]) for m, r in zip(margins, rows, strict=True)]
    return Model(start, tuple(trees), (math.inf,) * len(KINDS))


def calibrate(model: Model, rows: list[tuple[tuple, int, int]]) -> Model:
    """Isotonic share of right proposals by margin; for each kind the lowest margin at TARGET or above.

    Proposals of one margin stand or fall together, so they are one step before the fit.
    """
    out = []
    for kind in range(len(KINDS)):
        by: dict[float, list[int]] = {}
        for x, a, b in rows:
            if x[0] == kind:
                s = by.setdefault(round(model.margin(x), 9), [0, 0])
                s[0] += a
                s[1] += a + b
        steps: list[list[float]] = []  # lowest margin, highest, right, all
        for m, (a, n) in sorted(by.items()):
            steps.append([m, m, a, n])
            while len(steps) > 1 and steps[-2][2] * steps[-1][3] >= steps[-1][2] * steps[-2][3]:
                _, high, a, n = steps.pop()
                steps[-1] = [steps[-1][0], high, steps[-1][2] + a, steps[-1][3] + n]
        good = [i for i, (_, _, a, n) in enumerate(steps) if n and a / n >= TARGET]
        # halfway to the last step that is not right often enough
        out.append((steps[good[0]][0] + steps[good[0] - 1][1]) / 2 if good and good[0] else steps[0][0] - 1e-8 if good else math.inf)
    return Model(model.start, model.trees, tuple(out))


def fit(proposed: DataFrame) -> Model:
    """Learns from all proposals; only counts of feature combinations reach the driver."""
    counted = proposed.groupBy("fold", *FEATURES).agg(F.count_if("is_right").alias("n_right"), F.count_if(~F.col("is_right")).alias("n_wrong"))
    n = len(FEATURES)
    rows = sorted((r[0], tuple(r[1 : n + 1]), r[n + 1], r[n + 2]) for r in counted.collect())
    return calibrate(boost([r[1:] for r in rows if not r[0]]), [r[1:] for r in rows if r[0]])


def chosen(proposed: DataFrame, model: Model) -> DataFrame:
    """New spans of each row: of overlapping ones that with the higher margin, then the longer, then the first."""
    margin = " + ".join([f"{model.start!r}D", *(t.sql("x") for t in model.trees)])
    enough = " or ".join(f"(kind = {i} and margin >= {t!r}D)" for i, t in enumerate(model.thresholds) if t < math.inf) or "false"
    scored = proposed.filter("free").withColumn("x", F.struct(*FEATURES)).withColumn("margin", F.expr(margin)).filter(enough)
    # spans of one zone may overlap, those of different zones don't
    by_zone = scored.groupBy("row", "zone").agg(F.sort_array(F.collect_list(F.struct(-F.col("margin"), F.col("at") - F.col("to"), "at", "to", "kind"))).alias("all"))
    greedy = "aggregate(all, cast(array() as array<struct<at:bigint,to:bigint,kind:int>>), (s, c) -> if(exists(s, y -> y.at < c.to and c.at < y.to), s, concat(s, array(named_struct('at', c.at, 'to', c.to, 'kind', c.kind)))))"
    return by_zone.select("row", F.expr(greedy).alias("new")).groupBy("row").agg(F.flatten(F.collect_list("new")).alias("new"))


def redactions(rows: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as kind:start:end."""
    df = rows.select("row", "doc_id", "email", *(_absolute(k).alias(k) for k in KINDS[1:]))
    added = "coalesce(new, cast(array() as array<struct<at:bigint,to:bigint,kind:int>>))"
    # numbers inside an address that stands, and addresses over a number that stands, are told already
    address = f"filter({added}, c -> c.kind = 0)"
    every = "concat(email, ip, card, phone)"
    both = _let(
        f"named_struct('b', {every}, 'm', email, 'n', {added}, 'a', {address})", "r",
        "filter(r.n, c -> not exists(if(c.kind = 0, r.b, r.m), y -> y.at < c.to and c.at < y.to) and (c.kind = 0 or not exists(r.a, y -> y.at < c.to and c.at < y.to)))",
    )
    df = df.join(new, "row", "left").select("row", "doc_id", *KINDS, F.expr(both).alias("new"))
    text = lambda spans, kind: f"transform({spans}, s -> concat('{kind}:', s.at, ':', s.to))"
    base = f"concat_ws(',', concat({', '.join(text(k, k) for k in KINDS)}))"
    whole = [text(f"array_sort(concat({k}, transform(filter(new, c -> c.kind = {i}), c -> named_struct('at', c.at, 'to', c.to))))", k) for i, k in enumerate(KINDS)]
    return df.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(base), 256).alias("base_sha256"),
        F.expr(f"concat_ws(',', concat({', '.join(whole)}))").alias("spans"),
        F.size("new").cast("long").alias("n_added"),
    )


def find(docs: DataFrame) -> DataFrame:
    """Marks, proposes, learns and adds."""
    rows = written(marked(docs))
    proposed = written(proposals(rows))
    return redactions(rows, chosen(proposed, fit(proposed)))
