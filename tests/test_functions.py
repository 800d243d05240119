"""Hand-derived answers of single functions and operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.functions import clean, policy
from wardline.operators import augment, calibrate, candidates, history, metrics, numbering, records, retrieval
from wardline.operators.ranking import rank_catalogue
from wardline.streaming import incremental


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long'}" for n, v in values.items())).select(column.alias("x")).first()[0] if names else spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "want"), [("3.9", 3), (" 7 ", 7), ("", -1), ("abc", -1), ("-2", -2), ("NaN", -1), ("1e3", 1000)])
def test_tolerant_int(spark, text, want):
    assert one(spark, clean.to_int(F.col("t"), -1), t=text) == want


@pytest.mark.parametrize(("line", "want"), [("1::2::5", ["1", "2", "5"]), ("1\t2,3", ["1", "2,3"]), ("1,2", ["1", "2"]), ("(1,2) 3", ["(1,2)", "3"])])
def test_split_precedence(spark, line, want):
    assert one(spark, clean.split_line(F.col("t")), t=line) == want


def test_clean_text(spark):
    assert one(spark, clean.clean_text(F.col("t"), 50), t="  a\r\nb   c ") == "a b c"
    assert one(spark, clean.clean_text(F.col("t"), 11), t="hello big world") == "hello big..."
    assert one(spark, clean.clean_text(F.col("t"), 5), t="abcdefgh") == "abcde..."
    assert one(spark, clean.clean_document(F.col("t")), t="a\r\n\n\n\n\nb　c") == "a\n\n\nb c"


def test_buckets_and_lists(spark):
    assert one(spark, clean.rating_bucket(F.col("t")), t="R - 17+ (violence & profanity)") == "R17"
    assert one(spark, clean.rating_bucket(F.col("t")), t="Rx - Hentai") == "RX"
    assert one(spark, clean.rating_bucket(F.col("t")), t="?") == "UNKNOWN"
    assert one(spark, clean.distinct_list(F.col("t"), 2), t="Drama| drama;Action/War") == "Drama, Action"
    assert one(spark, clean.genre_set(F.col("t")), t="Sci-Fi|Children's, none|sci-fi") == ["children", "sci fi"]
    assert one(spark, clean.sort_key(F.col("t")), t="2020-3-04T5:06") == "20200304050600"
    assert one(spark, clean.title_id(F.col("t")), t="123") == "tt0000123"


def test_policies(spark):
    rows = spark.createDataFrame([(3, 1, 1, 1, 1, False, True), (3, 1, 1, 1, 1, False, False), (1, 1, 1, 1, 1, True, True), (1, 1, 1, 1, 1, True, False)], "sex int, violence int, profanity int, drug int, intense int, is_adult boolean, is_minor boolean")
    got = rows.select(policy.dim_flags(F.col("is_minor"), F.col("is_adult"))["unsafe_any"].alias("x")).collect()
    assert [r.x for r in got] == [1, 0, 1, 0]
    buckets = spark.createDataFrame([(b, m) for m in (True, False) for b in ("R17", "RPLUS", "RX", "PG13")], "b string, m boolean")
    got = buckets.select(policy.bucket_flags(F.col("m"), F.col("b"))["unsafe_any"].alias("x")).collect()
    assert [r.x for r in got] == [1, 1, 1, 0, 0, 1, 1, 0]
    assert [one(spark, policy.preference(F.col("r")), r=r) for r in (5, 4, 3, 2, 1)] == [1, 1, None, 0, 0]
    assert [one(spark, policy.preference(F.col("r"), 7, 0), r=r) for r in (7, 6, 0)] == [1, None, 0]


def test_percentile_and_quota(spark):
    for values, want in (([1, 2, 3, 4, 4, 1], 4), ([1], 1), ([1, 1, 1, 2], 2), ([1, 1, 2, 2, 3], 2)):
        assert spark.createDataFrame([(v,) for v in values], "v int").agg(F.ceil(F.percentile("v", F.lit(0.75)))).first()[0] == want
    for rho, n, want in ((0.2, 12, 2), (0.2, 13, 3), (0.5, 5, 2), (0.5, 7, 4), (0.2, 2, 1), (0.5, 1, 1)):
        assert one(spark, augment.quota(F.col("n"), rho), n=n) == want


def test_ndcg(spark):
    ranked = spark.createDataFrame([(1, i, r, True) for r, i in enumerate((9, 8, 7), 1)], "u long, i long, rank int, is_minor boolean")
    assert round(metrics.per_user(ranked, spark.createDataFrame([(1, 7)], "u long, i long"), [], [3]).first().ndcg, 6) == 0.5
    ranked = spark.createDataFrame([(1, i, r, True) for r, i in enumerate((1, 8, 7, 2, 6), 1)], "u long, i long, rank int, is_minor boolean")
    got = metrics.per_user(ranked, spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "u long, i long"), [], [5]).first()
    assert round(got.ndcg, 6) == 0.671386 and got.hit == 1


def test_split_and_ids(spark):
    rows = spark.createDataFrame([(1, i, i, 5) for i in range(5)] + [(2, i, i, 5) for i in range(2)], "u long, i long, ts long, rating long")
    got = {(r.u, r.split): r["count"] for r in history.leave_last_two(rows).groupBy("u", "split").count().collect()}
    assert got == {(1, "train"): 3, (1, "valid"): 1, (1, "test"): 1}
    keys = [-5, 70000, 3, 200000, 65536, 65535]
    ids = numbering.dense_ids(spark.createDataFrame([(k,) for k in keys * 2], "k long"), "k", "id").collect()
    assert {r.k: r.id for r in ids} == {k: j for j, k in enumerate(sorted(keys))}


def test_chunks(spark):
    got = retrieval.sliding_chunks(spark.createDataFrame([(1, "x" * 1400), (2, "y" * 650), (3, "")], "d long, text string"), "d").collect()
    assert sorted((r.d, r.start, len(r.chunk)) for r in got) == [(1, 0, 650), (1, 570, 650), (1, 1140, 260), (2, 0, 650)]
    pages = spark.createDataFrame([(1, 0, "a" * 300), (1, 1, "b" * 300), (1, 2, "c" * 300), (1, 3, "d" * 1400)], "page long, n long, text string")
    assert [len(r.chunk) for r in retrieval.packed_chunks(pages).orderBy("n").collect()] == [601, 300, 650, 650, 260]


def test_choice_parse_and_generated_ids(spark):
    assert [one(spark, calibrate.parse_choice(F.col("t")), t=t) for t in ("=A", " = none.", "maybe A", "=Apple")] == [0, 2, None, None]
    texts = spark.createDataFrame([(1, "i12, xi3 i7")], "u long, text string")
    items = spark.createDataFrame([(12,), (7,), (3,)], "i long")
    got = augment.generated_ids(texts, items, spark.createDataFrame([], "u long, i long"), 5).orderBy("place").collect()
    assert [r.i for r in got] == [12, 7]


def test_envelope_by_hand(spark):
    ranked = spark.createDataFrame([(1, r, s, x) for r, s, x in ((1, 0.2, 1), (2, 0.6, 0), (3, 1.0, 1))], "u long, rank int, safety double, unsafe int")
    got = {r.g: (r.raw, r.envelope) for r in calibrate.risk_curve(ranked, calibrate.thresholds(spark, 3)).collect()}
    assert got[0] == (0.1, 0.1) and got[1] == (0.05, 0.05) and got[2] == (0.05, 0.05) and got[3] == (0.0, 0.0)


def brute_mix(recall, lam=0.75):
    """The greedy rules item by item."""
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    order = sorted(range(len(recall)), key=lambda j: (-recall[j][1], recall[j][0]))
    rel, pop, gen = ([recall[j][c] for j in order] for c in (1, 2, 3))
    chosen = []
    pick = lambda f, n: [chosen.append(max((j for j in range(len(order)) if j not in chosen), key=lambda j: (f(j), -j))) for _ in range(min(n, len(order) - len(chosen)))]
    pick(lambda j: lam * rel[j] - (1 - lam) * max((jac(gen[j], gen[c]) for c in chosen), default=0.0), 4)
    pick(lambda j: pop[j], 3)
    pick(lambda j: len(gen[j] - set().union(*(gen[c] for c in chosen))) + 0.2 * rel[j] + 0.1 * pop[j], 3)
    pick(lambda j: 0, 2)
    return [recall[order[j]][0] for j in chosen]


def test_greedy_mix_against_brute_force(spark, monkeypatch):
    """Users of different lists, some with fewer candidates than there is room for, together and one by one."""
    r = np.random.default_rng(3)
    recalls = [[(i, float(r.integers(0, 9)) / 8, float(r.integers(0, 5)) / 4, sorted(set(r.choice(list("abcdef"), r.integers(0, 4)).tolist()))) for i in range(25 if u % 4 else 3 + u)] for u in range(24)]
    rows = spark.createDataFrame([(u, *x) for u, own in enumerate(recalls) for x in own], "u long, i long, rel double, pop double, genres array<string>")
    want = {u: brute_mix([(i, a, b, set(g)) for i, a, b, g in own]) for u, own in enumerate(recalls)}
    got = {}
    for x in sorted(candidates.select_mixed(rows, 4, 3, 3, 12).collect(), key=lambda x: (x.u, x.place)):
        got.setdefault(x.u, []).append(x.i)
    assert got == {u: x for u, x in want.items() if x}


def test_ranking_ties_blocks_and_short_lists(spark, monkeypatch):
    from wardline.operators import ranking

    users = spark.createDataFrame([(1, [3, 99]), (2, [])], "u long, block array<long>")
    items = spark.createDataFrame([(i,) for i in (5, 3, 1, 4, 2)], "i long")
    score = lambda u, x: (x["i"] % 2)[None, :].repeat(len(u["u"]), 0)
    want = {1: [1, 5, 2, 4], 2: [1, 3, 5, 2, 4]}
    for block in (1_000_000, 2):
        monkeypatch.setattr(ranking, "ITEM_BLOCK", block)
        got = rank_catalogue(users, items, score, 5).orderBy("u", "rank").collect()
        assert {u: [r.i for r in got if r.u == u] for u in want} == want


def test_leak_checks(spark):
    assert one(spark, records.leaks(F.col("t"), ["Forbidden", "none"]), t="a FORBIDDEN word") == ["Forbidden"]
    assert one(spark, records.title_leaks(F.col("t"), F.array(F.lit("Heat (1995)"), F.lit("It (2017)"))), t="likes heat and it") is True
    assert one(spark, records.clean_rules(F.col("t"), "bad"), t="1. One\n- two\n\nbad\n* two") == "- One\n- two"
    assert one(spark, records.last_json(F.col("t")), t='```json\n{"a": {"b": 1}}\n``` x') == '{"a": {"b": 1}}'
    assert one(spark, records.has_cjk(F.col("t")), t="x漢") is True


def test_append_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    step = lambda df: df.withColumn("y", F.col("x") * 2)
    for lo in (0, 5):
        spark.range(lo, lo + 5).select(F.col("id").alias("x")).write.mode("append").parquet(src)
        incremental.append_new(spark, src, "x long", out, mark, step)
    assert sorted(r.y for r in spark.read.parquet(out).collect()) == [2 * i for i in range(10)]
    done = spark.createDataFrame([(1,), (1,)], "x long")
    assert incremental.resume(spark.range(3).select(F.col("id").alias("x")), done, "x").count() == 2


def test_passages_that_begin_inside_words(spark):
    from wardline.plans.text import verbatim

    docs = {1: "xthe cat sat on mats", 2: "a cat sat", 3: "the  cat sat on ma", 4: "", 5: None, 6: "one two three four fivex one two three four five", 7: "a\ncat sat"}
    items = {"a": "the cat sat on ma", "b": "cat sa", "c": "t s", "d": "one two three four five", "e": None, "f": "he cat sat o", "g": "cat", "h": "a cat s"}
    want = {i: sorted(k for k, p in items.items() if p is not None and p in (t or "")) for i, t in docs.items()}
    got = verbatim(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id string, passage string")).collect()
    assert {r.doc_id: (r.n_items, r.first_item) for r in got} == {i: (len(x), x[0]) for i, x in want.items() if x}
