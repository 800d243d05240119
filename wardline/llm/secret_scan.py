"""Operator 5, secret scans: fixed patterns and a randomness test battery; DataFrame operations only.

Base spans are the leftmost non-overlapping matches of the patterns below (kinds
assign, access, hex). Spans are code points, end exclusive.

The battery takes the other unbroken runs of key characters that touch no base
span and infers each run's encoding (hex, letters, base 32, letters and digits,
base 64); a run counts from its encoding's least length on. Under the
hypothesis "uniform over the encoding" it computes a chi-squared uniformity
test (Wilson-Hilferty), a runs test and a lag-1 serial correlation; none may
reject. Under the hypothesis "written text" three counts are held against their
laws, whose spread follows the length: equal symbols meet far more often (equal
pairs, Poisson), kinds of character (lower and upper case, digit, mark) change
rarely, and vowels and consonants alternate. Their mean z gives a p-value, and
the p-values of a document's candidates go through Benjamini-Hochberg, so many
candidates need more evidence each. What passes both is a span of kind
``random``. The family is the document, not the table: what is found in a text
must not depend on which others are scanned with it.

A uniform random string alone in its document is found with a chance of 0.9 or
more at every counted length (README has the figures).

Defined results: null text is empty; every row of repeated rows is scanned;
equal runs (ties) are judged alike; an empty table gives an empty result; other
columns of docs are not read. The battery takes steps in proportion to a run's
length (a run of a million characters takes seconds), offsets of m matches
about m^1.5 steps, and all else is linear, so a text that is nothing but matches
or one unbroken run stays feasible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import once

#: Fixed patterns, in the order of kinds. A match must also meet its minimum length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Stands for the characters of base spans where runs are looked for: no run touches it.
FILLER = "\uFDD0"
RUN = rf"(?<![A-Za-z0-9+/_{FILLER}-])[A-Za-z0-9+/_-]{{20,}}+={{0,2}}+(?!{FILLER})"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
#: Encodings in order of inference: pattern, alphabet, least length; of written text the chance that two symbols agree and that neighbours differ in kind.
ENCODINGS = (
    ("^([0-9a-f]+|[0-9A-F]+)$", 16, 20, 0.12, 0.15),
    ("^([a-z]+|[A-Z]+)$", 26, 26, 0.066, None),
    ("^[A-Z2-7]+$", 32, 24, 0.066, 0.15),
    ("^([0-9a-z]+|[0-9A-Z]+)$", 36, 20, 0.066, 0.15),
    (".", 64, 20, 0.060, 0.38),
)
#: Of written text, the chance that of two letters side by side one is a vowel; hex has too few letters for it.
ALTERNATE = 0.66
VOWELS = (0, 4, 8, 14, 20)
LIMIT_Z = 3.29
FALSE_RATE = 0.01


def before(lengths: str) -> str:
    """SQL: sum of the entries before each entry of an int array, in blocks of about its root."""
    x = lengths
    parts = f"transform(sequence(0, ({x}_n - 1) div {x}_w), b -> slice({x}, cast(b * {x}_w + 1 as int), {x}_w))"
    sums = "aggregate({a}, named_struct('t', 0, 'o', cast(array() as array<int>)), (s, v) -> named_struct('t', s.t + v, 'o', concat(s.o, array(s.t))), s -> s.o)"
    starts = sums.format(a=f"transform({parts}, p -> aggregate(p, 0, (s, v) -> s + v))")
    return f"flatten(zip_with({parts}, {starts}, (p, s0) -> transform({sums.format(a='p')}, v -> v + s0)))"


def located(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """rows with ``name``: array of (start, end, text) of the pattern's matches in ``text``; null where there is none."""
    regex = F.lit(pattern)
    rows = rows.withColumn("found", F.regexp_extract_all("text", regex, F.lit(0)))
    some = F.size("found") > 0
    gaps = F.when(some, F.split("text", pattern, -1))
    rows = rows.withColumn("gaps", gaps)
    # gap 0, match 0, gap 1, match 1, ...: lengths of gap i and match i taken together start match i + 1
    own = F.when(some, F.transform("found", lambda m, i: F.length(m) + F.length(F.get("gaps", i + 1))))
    rows = rows.withColumn("own", own).withColumn("own_n", F.size("own")).withColumn("own_w", F.ceil(F.sqrt(F.size("own").cast("double"))).cast("int"))
    lead = F.when(some, F.expr(before("own")))
    rows = rows.withColumn("lead", lead)
    spans = F.when(some, F.transform("found", lambda m, i: F.struct((F.length(F.get("gaps", F.lit(0))) + F.get("lead", i)).alias("start"), (F.length(F.get("gaps", F.lit(0))) + F.get("lead", i) + F.length(m)).alias("end"), m.alias("m"))))
    return rows.withColumn(name, spans).drop("found", "gaps", "own", "own_n", "own_w", "lead")


def normal_cdf(z: Column) -> Column:
    return 1 / (1 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), -1.5976 * z - 0.07056 * z * z * z))))


def blanked(text: Column, pattern: str, counts) -> Column:
    """The text with every match that counts overwritten by as many fillers."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    shown = lambda m: F.when(counts(m), F.repeat(F.lit(FILLER), F.length(m))).otherwise(F.coalesce(m, F.lit("")))
    return F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(g, shown(m))), "")


def tested(run: Column) -> Column:
    """Struct long (enough for its encoding), p (written text could look so random) and random (no test rejects uniformity) of a run's text."""
    bare = F.rtrim(run, F.lit("="))
    traits = [F.lit(float("nan") if v is None else float(v)) for v in ENCODINGS[-1][1:]]
    for pattern, *values in reversed(ENCODINGS[:-1]):
        here = F.regexp_like(bare, F.lit(pattern))
        traits = [F.when(here, float("nan") if v is None else float(v)).otherwise(t) for v, t in zip(values, traits, strict=True)]
    codes = F.transform(F.split(bare, ""), lambda c: F.instr(F.lit(ALPHABET), c).cast("double"))
    bound = F.array(F.struct(codes.alias("x"), *[t.alias(n) for n, t in zip("alct", traits, strict=True)]))
    # a value that lambdas over the run read is bound by a struct of its own first, else each character would work it out again
    bound = F.transform(bound, lambda s: with_fields(s, symbols(s)))
    bound = F.transform(bound, lambda s: with_fields(s, above_mean(s)))
    return F.get(F.transform(bound, battery), F.lit(0))


def with_fields(s: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        s = s.withField(name, value)
    return s


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def symbols(s: Column) -> dict[str, Column]:
    """n, mean and the sum of the squared counts of symbols of a run s."""
    x = s["x"]
    n = F.size(x).cast("double")
    counts = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda w: w == v)).cast("double"))
    return {"n": n, "mean": total(x) / n, "square": total(F.transform(counts, lambda o: o * o))}


def above_mean(s: Column) -> dict[str, Column]:
    """Which symbols lie above the mean, and how many."""
    high = F.transform(s["x"], lambda v: F.when(v > s["mean"], 1.0).otherwise(0.0))
    return {"high": high, "n1": total(high)}


def kind_of(code: Column) -> Column:
    """Digit, lower case, upper case or mark, by the place in ALPHABET (from 1)."""
    return F.when(code <= 10, 0).when(code <= 36, 1).when(code <= 62, 2).otherwise(3)


def vowel(code: Column) -> Column:
    """Whether a letter is a vowel; null for digits and marks."""
    return F.when(code.between(11, 62), F.pmod(code.cast("int") - 11, F.lit(26)).isin(*VOWELS))


def battery(s: Column) -> Column:
    x, a, c, t, n, mean, square = (s[k] for k in ("x", "a", "c", "t", "n", "mean", "square"))
    sides = lambda of, f: F.zip_with(F.slice(of, F.lit(1), F.size(of) - 1), F.slice(of, F.lit(2), F.size(of)), f)
    chi = a * square / n - n
    df = a - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    n1 = s["n1"]
    n0 = n - n1
    changes = total(sides(s["high"], lambda p, q: F.when(p != q, 1.0).otherwise(0.0)))
    runs_mean = 2 * n1 * n0 / n + 1
    runs_var = F.greatest((runs_mean - 1) * (runs_mean - 2) / (n - 1), F.lit(1e-9))
    z_runs = F.abs(changes + 1 - runs_mean) / F.sqrt(runs_var)
    var = total(F.transform(x, lambda v: (v - mean) * (v - mean)))
    lag = total(sides(x, lambda p, q: (p - mean) * (q - mean)))
    z_lag = F.abs(lag / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    pairs, expected = (square - n) / 2, n * (n - 1) / 2 * c
    z_pairs = (expected - pairs - 0.5) / F.sqrt(expected)
    kinds = total(sides(x, lambda p, q: F.when(kind_of(p) != kind_of(q), 1.0).otherwise(0.0)))
    z_kinds = F.when(~F.isnan(t), (kinds - 0.5 - (n - 1) * t) / F.sqrt((n - 1) * t * (1 - t)))
    mixed = F.filter(sides(x, lambda p, q: (vowel(p) != vowel(q)).cast("double")), lambda v: v.isNotNull())
    m = F.size(mixed).cast("double")
    z_vowels = F.when((a > 16) & (m > 0), (m * ALTERNATE - total(mixed) - 0.5) / F.sqrt(m * ALTERNATE * (1 - ALTERNATE)))
    parts = F.array_compact(F.array(z_pairs, z_kinds, z_vowels))
    p = normal_cdf(-total(parts) / F.sqrt(F.size(parts).cast("double")))
    return F.struct((n >= s["l"]).alias("long"), p.alias("p"), ((z_chi < LIMIT_Z) & (z_runs < LIMIT_Z) & (z_lag < LIMIT_Z)).alias("random"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, rank, end, kind), by start and then kind."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    for name, pattern in kinds.items():
        rows = located(rows, name, pattern)
    least = {"assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8, "access": lambda m: F.length(m) >= 16, "hex": lambda m: m.isNotNull()}
    span = lambda rank: lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    kept = lambda counts: lambda s: counts(s["m"])
    base = [F.coalesce(F.transform(F.filter(F.col(k), kept(least[k])), span(i)), none) for i, k in enumerate(kinds)]
    rows = rows.withColumn("base", F.concat(*base)).drop(*kinds)
    # where base spans are, runs are looked for in a copy of the text that has fillers in their place
    for name, pattern in kinds.items():
        rows = rows.withColumn("text", F.when(F.size("base") > 0, blanked(F.col("text"), pattern, least[name])).otherwise(F.col("text")))
    rows = located(rows, "runs", RUN)
    judged = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), tested(r["m"]).alias("t")))
    rows = rows.withColumn("found", F.when(F.size("runs") > 0, F.filter(judged, lambda r: r["t"]["long"])))
    # Benjamini-Hochberg: the largest p-value that is at most its rank's share of the rate
    ranked = F.sort_array(F.transform("found", lambda r: r["t"]["p"]))
    cut = F.array_max(F.transform(ranked, lambda p, i: F.when(p <= FALSE_RATE * (i + 1) / F.size("found"), p)))
    rows = rows.withColumn("cut", cut)
    more = F.transform(F.filter("found", lambda r: r["t"]["random"] & (r["t"]["p"] <= F.col("cut"))), span(3))
    return once(rows, ["doc_id"], spans=F.sort_array(F.concat("base", F.coalesce(more, none))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
