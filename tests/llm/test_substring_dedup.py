import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, noisy
from wardline.llm.substring_dedup import substring_dedup


def brute(rows, window=20):
    docs = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows})
    seen, out = {}, {}
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", d[1]) for d in docs}
    for d in docs:
        w, gone = split[d], set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.setdefault(key, (d, s))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted((i, *out[-(2**63) if i is None else i, t or ""]) for i, t in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = noisy(seed, vocabulary=40 if seed == 1 else 3)
    got = substring_dedup(frame(spark, texts).repartition(5)).collect()
    have = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got)
    assert have == brute(list(enumerate(texts)))
    assert sum(r.n_removed for r in got) > 100


def test_repeated_rows_long_text_and_empty_table(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    long = " ".join(str(i % 1000 + i // 1000) for i in range(60000))
    rows = [(5, passage), (5, passage), (2, "a b " + passage), (9, long), (9, long)]
    got = substring_dedup(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    have = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got)
    assert have == brute(rows)
    assert substring_dedup(frame(spark, [])).collect() == []
    assert substring_dedup(frame(spark, ["x"], [None])).collect()[0].n_words == 1


def test_a_passage_between_ever_new_words_in_every_document(spark):
    """Its edge windows stand in as many regions as there are documents; each task sends them on about once."""
    from pyspark.sql import functions as F

    from wardline.llm import substring_dedup as sd

    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"{i}a{j}" for j in range(25)) + " " + passage + " " + " ".join(f"{i}b{j}" for j in range(25))) for i in range(400)]
    got = substring_dedup(frame(spark, [t for _, t in rows]).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == brute(rows)
    docs = frame(spark, [t for _, t in rows]).select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"), "text", F.array(F.struct(F.lit(25).alias("s"), F.lit(11).alias("n"), F.lit(False).alias("whole"))).alias("marks"))
    out = docs.coalesce(2).mapInArrow(lambda it: sd.extend(it, 20), sd.ddl(sd.WINDOWS))
    assert out.where("w1 is not null").groupBy("w1", "w2").count().agg(F.max("count")).first()[0] <= 2 * docs.coalesce(2).rdd.getNumPartitions()


def test_what_was_met_lately_is_a_repeat_only_after_an_earlier_one():
    import numpy as np

    from wardline.llm.substring_dedup import Lately

    r = np.random.default_rng(1)
    lately, first = Lately(64), {}
    for _ in range(300):
        w = np.unique(r.integers(-50, 50, 20))
        k, h, s = r.integers(0, 30, len(w)), r.integers(0, 2, len(w)), r.integers(0, 5, len(w))
        for x, row, known in zip(w.tolist(), zip(k.tolist(), h.tolist(), s.tolist()), lately.known(w, w * 7, k, h, s), strict=True):
            assert not known or first[x] < row
            first[x] = min(first.get(x, row), row)


def test_columns_of_any_name(spark):
    docs = frame(spark, ["a b c"]).withColumnsRenamed({"lang": "marks", "source": "runs", "region": "w1"})
    assert [(r.doc_id, r.kept_text) for r in substring_dedup(docs).collect()] == [(0, "a b c")]


def test_many_rows_of_one_document(spark):
    """100,000 rows of one doc_id and text, beside an earlier document that holds the text, and a later one."""
    text = " ".join(f"w{i % 150}x{i}" for i in range(200))
    docs = spark.range(100_002).select(F.when(F.col("id") < 100_000, 2).when(F.col("id") == 100_000, 1).otherwise(3).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = substring_dedup(docs.repartition(8)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 200, 0, 1), (2, 200, 200, 100_000), (3, 200, 200, 1)]
