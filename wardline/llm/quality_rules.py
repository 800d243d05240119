"""Operator 7, quality rules as a bitmask ledger; DataFrame operations only.

``ledger`` evaluates every rule once per document: measurements and one
failure bit per rule. ``apply_policy`` reads a named, versioned set of rules
off the bits, and ``ablations`` tells from bitwise aggregates what each rule
does in a policy, without touching a text again.

Defined results: null text has no words; every row of repeated rows has its
own ledger row (ties do not arise: no row is compared with another); texts may
have any length; other columns of docs are not read; an empty table gives an
empty ledger, and ablations of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import SPACES, once

BLANK = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rules in bit order: name and the SQL condition under which a document fails.
RULES = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * word_chars"),
    ("repeated_lines", "n_lines >= 10 and 10 * n_dup_lines > 8 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "10 * word_chars < 12 * n_words"),
    ("symbols_by_word", "10 * n_symbols > n_words"),
    ("repeated_lines_30", "n_lines >= 10 and 10 * n_dup_lines > 3 * n_lines"),
    ("long_words_15", "word_chars > 15 * n_words"),
    ("short_words_3", "word_chars < 3 * n_words"),
    ("capitals", "10 * n_capitals > 4 * word_chars"),
    ("stutter", "10 * n_stutter > 3 * n_words"),
)
#: Policies by version: the rules that reject.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    # loose bounds that only gross faults break
    "v1": ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "long_words", "short_words"),
    # bounds that clean labelled documents keep and junk breaks
    "v2": ("too_few_words", "repeated_windows", "symbols_by_word", "repeated_lines_30", "long_words_15", "short_words_3", "capitals", "stutter"),
}
CURRENT = "v2"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mask(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def words(text):
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare != "", F.split(bare, BLANK)).otherwise(F.array().cast("array<string>"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, fail_bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("text"))
    base = base.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    n = F.size("w")
    grams = F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.col("w")[i + j] for j in range(WINDOW)])))
    base = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("text") - F.length(F.translate("text", CAPITALS, ""))).cast("long").alias("n_capitals"),
        F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1))).cast("long").alias("n_stutter"),
        grams.alias("grams"),
    )
    # only a text with equal windows pays for sorting them
    ordered = F.when(F.size("grams") > F.size(F.array_distinct("grams")), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    base = base.withColumn("ordered", ordered).drop("grams")
    o = F.col("ordered")
    twin = F.filter(o, lambda x, j: (x["g"] == F.get(o, j - 1)["g"]) | (x["g"] == F.get(o, j + 1)["g"]))
    base = base.withColumn("at", F.sort_array(F.transform(twin, lambda x: x["i"]))).drop("ordered")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("at", start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"])
    measured = {c: F.col(c) for c in base.columns if c not in ("doc_id", "at")} | {"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")}
    base = once(base, ["doc_id"], **measured)
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), 1 << i).otherwise(0)
    return base.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rows with policy, kept: whether no rule of the policy failed."""
    return rows.withColumns({"policy": F.lit(policy), "kept": F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0})


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that the policy keeps without it."""
    m = mask(policy)
    # at most 2^rules patterns; several policies' ablations share this one exchange
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n")).withColumn("bits", F.col("fail_bits").bitwiseAND(F.lit(m)))
    rules = [(i, n) for i, (n, _) in enumerate(RULES) if m >> i & 1]
    sums = [x for i, _ in rules for x in (F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0)), F.sum(F.when(F.col("bits") == 1 << i, F.col("n")).otherwise(0)), F.sum(F.when(F.col("bits").bitwiseAND(F.lit(m & ~(1 << i))) == 0, F.col("n")).otherwise(0)))]
    cells = [F.struct(F.lit(n).alias("rule"), *[F.coalesce(sums[3 * j + c], F.lit(0)).alias(name) for c, name in enumerate(("n_fail", "n_only", "n_kept_without"))]) for j, (_, n) in enumerate(rules)]
    return patterns.agg(F.array(*cells).alias("x")).select(F.inline("x"))
