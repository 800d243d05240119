"""Operator 9, benchmark decontamination by spaced seeds; DataFrame operations only.

Texts and benchmark items are lower-cased and split into runs of letters and
digits (ASCII marks and white space separate); of scripts written without
blanks (Chinese, Japanese, Thai and others) each character is a token, and
their marks separate. Each fixed mask reads six of
some ten consecutive tokens and ignores the others, so a seed survives
substitutions at the ignored places. The seeds of every position of every text
meet the items' seeds; each hit fixes an alignment, and is confirmed if some
stretch of ``min_tokens`` aligned tokens around it (the whole item if shorter)
agrees in ``min_share`` of its places. The masks can all miss an item of 10 to
12 tokens with two substitutions; such items also have three seeds of three
consecutive tokens each, of which two substitutions leave one whole. Only where
there are such items do texts have these seeds.

Items of EXACT to SPAN - 1 tokens must stand word for word; their seed is their
first EXACT tokens, which texts have only where there are such items.

A seed row has a fixed width (hash, place, item key, item length), so a bound on
their count bounds what is broadcast: up to BROADCAST_SEEDS rows, and then
scan, seeding, lookup and cutting out the aligned words are one stage without a
shuffle. Beyond that the seeds are joined by shuffle and hits meet their texts
again. The items' words come in for the hits only, broadcast up to
BROADCAST_CHARS characters.

Defined results: null or short texts match nothing; items of fewer than EXACT
tokens are phrases that any text may hold and match nothing; marks never make
a token; rows that repeat doc_id and text count once, as do rows of benchmark
that repeat item_id and text; equal items of several ids each report; of equal
alignments (ties) the earliest is named; empty tables give an empty result;
the length of texts is not bounded.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import FILE_ROWS, keyed, partitions, scanned, settle, whole_rows

#: Fixed masks: the token places that a seed reads.
MASKS = ((0, 1, 3, 6, 7, 9), (0, 2, 3, 5, 8, 9), (0, 1, 4, 5, 7, 8))
SPAN = 10
#: The mask of items of SPAN to SURE - 1 tokens, and where they are read.
SHORT, SHORT_AT = (0, 1, 2), (0, 3, 6)
SURE = 13
#: The mask of items of EXACT to SPAN - 1 tokens, read at their start.
EXACT = 5
WHOLE = tuple(range(EXACT))
BROADCAST_SEEDS = 2_000_000
BROADCAST_CHARS = 64_000_000
#: Keys of contaminated documents (16 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_FOUND = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters of scripts written without blanks, and their marks.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
UNSPACED_MARKS = r"\u3000-\u303F\u30FB\uFF01-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65"
#: The same classes as the SQL of query 9 writes them.
UNSPACED_SQL, MARKS_SQL, SEPARATORS_SQL = (re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", x) for x in (UNSPACED, UNSPACED_MARKS, SEPARATORS))


def tokens(text):
    apart = F.trim(F.regexp_replace(F.regexp_replace(text, f"[{UNSPACED_MARKS}]", " "), f"([{UNSPACED}])", " $1 "))
    whole = F.split(F.lower(F.when(text.rlike(f"[{UNSPACED}{UNSPACED_MARKS}]"), apart).otherwise(text)), SEPARATORS)
    return F.array_remove(whole, "")  # what stands before a leading mark and after a closing one


def seed_of(m: int, mask: tuple, at):
    return F.xxhash64(F.lit(m), *[F.get("words", at + i) for i in mask])


def item_seeds(listed: DataFrame, m: int, mask: tuple, places) -> DataFrame:
    return listed.withColumn("q", F.explode(places)).select(seed_of(m, mask, F.col("q")).alias("seed"), "q", "item_key", "n")


def text_seeds(rows: DataFrame, masks: dict[int, tuple], span: int) -> DataFrame:
    """rows with one row per position p and mask: column seed. A mask that reads beyond the end reads nulls: such a seed is confirmed or not, like any other."""
    placed = rows.withColumn("p", F.explode(F.when(F.size("words") >= span, F.sequence(F.lit(0), F.size("words") - span))))
    return placed.withColumn("seed", F.explode(F.array(*[seed_of(m, mask, F.col("p")) for m, mask in masks.items()])))


def items(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, words, n: once per item_id and text."""
    text = F.col("text").cast("string")
    rows = benchmark.select(F.xxhash64(F.col("item_id").cast("string"), text).alias("item_key"), "item_id", tokens(text).alias("words"))
    return rows.withColumn("n", F.size("words")).where(F.col("n") >= EXACT).dropDuplicates(["item_key"])


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 13, min_share: float = 0.8) -> DataFrame:
    """k, h, doc_id, item_id, matched (most equal tokens in a stretch), first (token where the earliest confirmed alignment begins)."""
    listed = items(benchmark)
    n = F.col("n")
    some = listed.agg(F.count(F.when(n < SPAN, 1)).alias("exact"), F.count(F.when(n.between(SPAN, SURE - 1), 1)).alias("few"), F.coalesce(F.sum(F.length(F.array_join("words", " "))), F.lit(0)).alias("chars")).first()
    masks, span = dict(enumerate(MASKS)), SPAN
    keys = [item_seeds(listed, m, mask, F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN))) for m, mask in masks.items()]
    if some["few"]:
        masks[len(masks)], span = SHORT, len(SHORT)
        keys.append(item_seeds(listed.where(n.between(SPAN, SURE - 1)), len(masks) - 1, SHORT, F.array(*map(F.lit, SHORT_AT))))
    if some["exact"]:
        masks[len(masks)], span = WHOLE, min(span, EXACT)
        keys.append(item_seeds(listed.where(n < SPAN), len(masks) - 1, WHOLE, F.array(F.lit(0))))
    keys = reduce(DataFrame.union, keys)
    texts = keyed(docs).select("doc_id", "k", "h", tokens(F.col("text")).alias("words"))
    start = (F.col("p") - F.col("q")).alias("start")
    aligned = F.slice("words", F.greatest(start, F.lit(0)) + 1, n).alias("part")
    if keys.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        # one generated loop: only confirmed candidates' few words leave it, never the whole array per position
        hits = text_seeds(texts, masks, span).join(F.broadcast(keys), "seed").select("k", "h", "doc_id", "item_key", "n", start, aligned).distinct()
    else:
        found = text_seeds(texts, masks, span).select("k", "h", "p", "seed").join(keys, "seed").select("k", "h", "item_key", "n", start).distinct()
        hits = found.withColumns({"p": F.col("start"), "q": F.lit(0)}).join(texts, ["k", "h"]).select("k", "h", "doc_id", "item_key", "n", "start", aligned).distinct()
    full = listed.select("item_key", "item_id", F.col("words").alias("item"))
    hits = hits.join(F.broadcast(full) if some["chars"] <= BROADCAST_CHARS else full, "item_key")
    wide = F.least(n, F.lit(min_tokens))
    skip = F.greatest(F.lit(0), -F.col("start"))
    equal = F.transform("part", lambda x, i: F.when(x == F.get("item", i + skip), 1).otherwise(0))
    hits = hits.withColumn("equal", equal).withColumn("wide", wide)
    sums = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("equal") - F.col("wide"))), lambda a: F.aggregate(F.slice("equal", a + 1, F.col("wide")), F.lit(0), lambda s, x: s + x))
    need = F.when(n < SPAN, n).otherwise(F.ceil(F.col("wide") * min_share))
    best = hits.select("k", "h", "doc_id", "item_id", "start", F.array_max(sums).alias("matched"), need.alias("need"))
    out = best.groupBy("k", "h", "doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.min(F.when(F.col("matched") >= F.col("need"), F.col("start"))).cast("long").alias("first"))
    return out.where(F.col("first").isNotNull())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, unchanged, whatever their columns are named."""
    found = settle(contaminated(scanned(docs), benchmark).select("k", "h").distinct(), FILE_ROWS * (partitions(docs.sparkSession) // 8))
    few = found.limit(BROADCAST_FOUND + 1).count() <= BROADCAST_FOUND
    return whole_rows(scanned(docs)).join(F.broadcast(found) if few else found, ["k", "h"], "left_anti").select("row.*")
