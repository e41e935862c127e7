"""Personal data: candidate spans, boosted trees over their features, calibrated thresholds.

Generators propose spans of four kinds, overlapping where their patterns do. The
base generators are fixed rules: what passes their check is always a finding. The
others recall more (numbers inside a longer run of digits, addresses spelt out in the
lengths that mail and host names may have, phone numbers without a country code) and
are decided by gradient boosted trees
over format and context features. The trees are trained on all candidates of the
corpus, counted by distinct feature vector, so the training table is bounded by the
features and not by the data; a validator labels them (check digit, value range,
digit count, or a cue word in front). Of every kind the lowest probability at which
the wanted precision is reached on the documents held out becomes its threshold;
where no probability reaches it, the kind adds nothing.

Everything is made of column functions: the pieces between the matches of a pattern
give the positions, and joining pieces and replacements again gives the masked text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.shared import fresh, land

KINDS = ("email", "ip", "card", "phone")
#: Share of true candidates among those accepted on the held-out documents.
PRECISION = 0.98
TREES, DEPTH = 8, 3
#: Characters of context before a candidate.
CONTEXT = 24
#: Matches of a text whose positions are summed together.
CHUNK = 64
#: Documents held out for the thresholds: those whose text hashes to 0 modulo this.
HOLD_OUT = 5

# The rules that base findings have to follow, in a form without repeated backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# What the further generators look for.
TOKEN_CARD = r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
DIALLED = r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])"
SPELT_EMAIL = (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[a-z0-9-]{1,63}+"
               r"(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}])\x20?[a-z0-9-]{1,63}+)++")
TOKEN_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|kontakt|correo|courriel)\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|addr|client)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|credit|account|karte|tarjeta|carte)\W*(?:no|number|nr)?\W*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone)\W*$",
}


@dataclass(frozen=True)
class Generator:
    """A pattern that proposes spans of ``kind`` in texts that pass the cheap test ``where``."""

    kind: str
    pattern: str
    where: str
    base: bool = False


GENERATORS = (
    Generator("email", EMAIL, "@", base=True),
    Generator("ip", IP, r"[0-9]\.[0-9]++\.[0-9]", base=True),
    Generator("card", CARD, r"[0-9](?:[\x20-]?[0-9]){15}", base=True),
    Generator("phone", PHONE, r"\+", base=True),
    Generator("email", SPELT_EMAIL, r"(?i)[(\[{]\x20?at\x20?[)\]}]"),
    Generator("ip", TOKEN_IP, r"[0-9]\.[0-9]++\.[0-9]"),
    Generator("card", TOKEN_CARD, r"[0-9](?:[\x20-]?[0-9]){15}"),
    Generator("phone", DIALLED, r"\+[0-9]"),
    Generator("phone", LOCAL_PHONE, r"[0-9]{3}[\x20.-][0-9]{4}"),
)
FEATURES = ("generator", "digits", "separators", "brackets", "valid", "cue", "glued", "currency", "upper_share")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("[^0-9]"), F.lit(""))


def is_valid(kind: str, match: Column) -> Column:
    """Whether a match passes the check of its kind."""
    digits = _digits(match)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})"  # what follows leading zeros, nothing after zeros alone
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


def _split_at(df: DataFrame, text: Column, generators: tuple[Generator, ...]) -> tuple[DataFrame, list[Column]]:
    """``df`` with the matches of every generator and the pieces of text around them, zipped as (m, p, n).

    The columns stand in projections of their own, so no pattern runs twice. Where the
    cheap test fails there are no matches.
    """
    none = F.array().cast("array<string>")
    names = fresh(df, *[f"pii_{x}{i}" for i in range(len(generators)) for x in "mpz"])
    new, zipped = {}, {}
    for i, g in enumerate(generators):
        m, p, z = names[3 * i:3 * i + 3]
        possible = text.contains(g.where) if g.where == "@" else text.rlike(g.where)
        new[m] = F.when(possible, F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0))).otherwise(none)
        new[p] = F.when(possible, F.split(text, g.pattern, -1)).otherwise(none)
        zipped[z] = F.arrays_zip(F.col(m).alias("m"), F.slice(p, F.lit(1), F.size(m)).alias("p"),
                                 F.slice(p, F.lit(2), F.size(m)).alias("n"))
    keep = [f"`{c}`" for c in df.columns]
    return df.withColumns(new).select(*keep, *[c.alias(z) for z, c in zipped.items()]), [F.col(z) for z in zipped]


def _features(g: Generator, match: Column, before: Column, after: Column) -> Column:
    """Small whole numbers, so that few distinct vectors are left."""
    digits = F.length(_digits(match))
    near = F.right(before, F.lit(CONTEXT))
    one = lambda c: c.cast("double")
    return F.array(
        F.lit(float(GENERATORS.index(g))),
        F.least(digits, F.lit(24)).cast("double"),
        F.least(F.length(F.regexp_replace(match, F.lit(r"[^\x20.-]"), F.lit(""))), F.lit(8)).cast("double"),
        one(match.rlike(r"[()\[\]{}]")),
        one(is_valid(g.kind, match)),
        one(near.rlike(CUES[g.kind])),
        one(near.rlike(r"[\p{L}0-9_/=#]$") | F.left(after, F.lit(1)).rlike(r"^[\p{L}0-9_/=]")),
        one(near.rlike(r"[$€£]\x20?$")),
        F.round(4 * F.length(F.regexp_replace(match, F.lit("[^A-Z]"), F.lit(""))) / F.length(match)).cast("double"))


KIND_TYPE = "struct<at:int,end:int,valid:boolean,f:array<double>>"


def _chunks(zipped: Column) -> Column:
    """Numbers of the stretches of ``CHUNK`` matches, one at least."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.size(zipped) / CHUNK).cast("int") - 1, F.lit(0)))


def _candidates(zipped: Column, g: Generator, scored: bool) -> Column:
    """array<struct<at, end, valid, f>> of a generator; ``f`` is null unless ``scored``.

    Positions are sums of lengths: first where each stretch of matches starts, then
    within a stretch, so that a step copies one stretch and not all that was found before.
    """
    stretch = lambda c: F.slice(zipped, c * CHUNK + 1, F.lit(CHUNK))
    lengths = F.transform(_chunks(zipped), lambda c: F.aggregate(
        stretch(c), F.lit(0), lambda acc, x: acc + F.length(x["p"]) + F.length(x["m"])))
    none = F.array().cast("array<struct<c:int,at:int>>")
    place = F.struct(F.lit(0).alias("pos"), none.alias("out"))
    starts = F.aggregate(lengths, place, lambda acc, n: F.struct(
        (acc["pos"] + n).alias("pos"),
        F.concat(acc["out"], F.array(F.struct(F.size(acc["out"]).alias("c"), acc["pos"].alias("at")))).alias("out")))["out"]

    def step(acc, x):
        at = acc["pos"] + F.length(x["p"])
        end = at + F.length(x["m"])
        f = _features(g, x["m"], x["p"], x["n"]) if scored else F.lit(None).cast("array<double>")
        new = F.struct(at.alias("at"), end.alias("end"), is_valid(g.kind, x["m"]).alias("valid"), f.alias("f"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(new.cast(KIND_TYPE))).alias("out"))

    def found(s):
        start = F.struct(s["at"].alias("pos"), F.array().cast(f"array<{KIND_TYPE}>").alias("out"))
        return F.aggregate(stretch(s["c"]), start, step)["out"]

    return F.flatten(F.transform(starts, found))


def _inside(x: Column, spans: Column) -> Column:
    """Whether a span lies in one of ``spans``, which are in order and do not overlap; by binary search."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int"))

    def halve(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        before = F.get(spans, middle)["at"] <= x["at"]
        low = F.when((acc["low"] < acc["high"]) & before, middle + 1).otherwise(acc["low"])
        high = F.when((acc["low"] < acc["high"]) & ~before, middle).otherwise(acc["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    begun = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve)["low"]
    return F.coalesce(F.get(spans, begun - 1)["end"] >= x["end"], F.lit(False))


def _in_order(spans: Column) -> Column:
    """Distinct spans by start and end; as numbers, which are told apart by hash."""
    numbers = F.transform(spans, lambda x: F.shiftleft(x["at"].cast("long"), 32) + x["end"])
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: F.struct(
        F.shiftright(n, 32).cast("int").alias("at"), n.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end")))


@dataclass(frozen=True)
class Trees:
    """Boosted trees as nested tuples (feature, threshold, left, right) or numbers, and a threshold per kind."""

    trees: tuple = ()
    thresholds: tuple = (2.0,) * len(KINDS)  # above any probability

    def chance(self, f: Column) -> Column:
        margin = sum((self._branch(t, f) * w for w, t in self.trees), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def _branch(self, node, f: Column) -> Column:
        if not isinstance(node, tuple):
            return F.lit(node)
        at, limit, left, right = node
        return F.when(f[at] <= limit, self._branch(left, f)).otherwise(self._branch(right, f))

    def threshold(self, kind: str) -> float:
        return self.thresholds[KINDS.index(kind)]

    def adds(self, g: Generator) -> bool:
        return not g.base and self.threshold(g.kind) <= 1


def _read_tree(lines: list[str]):
    """A tree from its printed form, one node a line: If (feature 3 <= 0.5), Else (...), Predict: 0.1."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    at, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _read_tree(lines)
    lines.pop(0)  # Else
    return int(at), float(limit), left, _read_tree(lines)


def fit_trees(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Trees:
    """Trees and thresholds from all candidates of ``docs``; nothing is added where one class is missing."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"))
    rows, zipped = _split_at(rows.select("text", (F.pmod(F.xxhash64("text"), F.lit(HOLD_OUT)) == 0).alias("held")),
                             F.col("text"), GENERATORS)
    found = F.concat(*[F.transform(_candidates(z, g, True), lambda x: x["f"])
                       for z, g in zip(zipped, GENERATORS, strict=True)])
    rows = (rows.select("held", F.explode(found).alias("f")).groupBy("held", "f").count()
            .select("held", "f", F.col("count").cast("double").alias("n")))
    at = {name: F.col("f")[i] for i, name in enumerate(FEATURES)}
    needs_cue = at["generator"].isin(*[float(i) for i, g in enumerate(GENERATORS) if g.pattern in (LOCAL_PHONE, SPELT_EMAIL)])
    true = (at["valid"] == 1) & (at["glued"] == 0) & (at["currency"] == 0) & (~needs_cue | (at["cue"] == 1))
    rows = land(rows.withColumn("label", true.cast("double")), "pii-candidates")
    train = rows.where("NOT held")
    if train.select("label").distinct().count() < 2:
        return Trees()
    data = train.select("label", "n", array_to_vector("f").alias("features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, weightCol="n", seed=1).fit(data)
    printed = [[x for x in t.toDebugString.split("\n")[1:] if x.strip()] for t in model.trees]
    trees = Trees(tuple(zip(map(float, model.treeWeights), map(_read_tree, printed), strict=True)))
    thresholds = []
    scored = rows.where("held").withColumn("p", F.round(trees.chance(F.col("f")), 3))
    for kind in KINDS:
        own = [float(i) for i, g in enumerate(GENERATORS) if g.kind == kind]
        levels = (scored.where(at["generator"].isin(*own)).groupBy("p")
                  .agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("hits")).collect())
        best, n, hits = 2.0, 0.0, 0.0  # at most 1001 levels
        for level in sorted(levels, key=lambda r: -r.p):
            n, hits = n + level.n, hits + level.hits
            if level.p < 0.5 or hits < precision * n:
                break
            best = float(level.p) - 0.0005
        thresholds.append(best)
    return Trees(trees.trees, tuple(thresholds))


def find_spans(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with columns sure_<kind> and all_<kind>: arrays of struct<at, end>.

    ``sure`` are the base spans in order, ``all`` those and the accepted further ones,
    sorted. A further span inside a base span of its kind is not repeated. Positions
    are code points, the end is exclusive. A null text is an empty one.
    """
    name, = fresh(docs, "pii_text")
    rows = docs.withColumn(name, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    used = tuple(g for g in GENERATORS if g.base or trees.adds(g))
    rows, zipped = _split_at(rows, F.col(name), used)
    keep = [f"`{c}`" for c in docs.columns if c != text_col]
    ends = lambda xs: F.transform(xs, lambda x: F.struct(x["at"].alias("at"), x["end"].alias("end")))
    found: dict[str, list[Column]] = {f"{which}_{kind}": [] for kind in KINDS for which in ("sure", "more")}
    for z, g in zip(zipped, used, strict=True):
        limit = trees.threshold(g.kind)
        accepted = (lambda x: x["valid"]) if g.base else (lambda x: trees.chance(x["f"]) >= limit)  # noqa: B023
        found[f"{'sure' if g.base else 'more'}_{g.kind}"].append(ends(F.filter(_candidates(z, g, not g.base), accepted)))
    none = F.array().cast("array<struct<at:int,end:int>>")
    rows = rows.select(*keep, *[F.concat(none, *xs).alias(n) for n, xs in found.items()])
    every = {}
    for kind in KINDS:
        sure = F.col(f"sure_{kind}")
        outside = F.filter(f"more_{kind}", lambda x: ~_inside(x, sure))  # noqa: B023
        every[kind] = F.when(F.size(f"more_{kind}") > 0, _in_order(F.concat(sure, outside))).otherwise(sure)
    return rows.select(*keep, *[f"sure_{k}" for k in KINDS], *[c.alias(f"all_{k}") for k, c in every.items()])


def span_text(spans: dict[str, Column]) -> Column:
    """kind:start:end of all spans, comma-joined, by kind as listed and start."""
    def named(kind: str, xs: Column) -> Column:
        return F.transform(xs, lambda x: F.concat_ws(":", F.lit(kind), x["at"], x["end"]))

    return F.array_join(F.concat(*[named(*kv) for kv in spans.items()]), ",")


def _masking(g: Generator, trees: Trees):
    """Maps a match to the text before it and the match or its kind in brackets."""
    def put(x):
        hit = (is_valid(g.kind, x["m"]) if g.base
               else trees.chance(_features(g, x["m"], x["p"], x["n"])) >= trees.threshold(g.kind))
        return F.concat(x["p"], F.when(hit, F.lit(f"[{g.kind.upper()}]")).otherwise(x["m"]))

    return put


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", trees: Trees | None = None) -> DataFrame:
    """``docs`` with every finding replaced by its kind in brackets, generator after generator, and ``length_col``, if there, set to the new length.

    Every row stays, null and empty texts as they are.
    """
    trees = fit_trees(docs, text_col) if trees is None else trees
    masked, = fresh(docs, "pii_masked")
    rows = docs.withColumn(masked, F.col(text_col).cast("string"))
    for g in [*(g for g in GENERATORS if g.base), *(g for g in GENERATORS if trees.adds(g))]:
        columns = rows.columns
        rows, (zipped,) = _split_at(rows, F.col(masked), (g,))
        put = F.transform(zipped, _masking(g, trees))
        done = F.concat(F.array_join(put, ""), F.element_at(zipped, -1)["n"])
        rows = rows.withColumn(masked, F.when(F.size(zipped) > 0, done).otherwise(F.col(masked))).select(
            *[f"`{c}`" for c in columns])
    new = {text_col: F.col(masked).cast(docs.schema[text_col].dataType)}
    if length_col in docs.columns:
        new[length_col] = F.length(masked).cast(docs.schema[length_col].dataType)
    return rows.withColumns(new).select(*[f"`{c}`" for c in docs.columns])
