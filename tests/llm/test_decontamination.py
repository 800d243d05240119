import random

from tests.llm.helpers import frame
from wardline.llm import decontamination as dc


def bench(spark, texts):
    return spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "item_id string, text string, h string")


def world(seed=3):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(3000)]
    items = [" ".join(r.choice(words) for _ in range(r.randint(13, 40))) for _ in range(20)] + [None, "", "too short item"]
    texts, truth = [], set()
    for i in range(120):
        w = [r.choice(words) for _ in range(r.randint(0, 200))]
        if i % 3 == 0:
            j = r.randrange(20)
            part = items[j].split()
            for _ in range(len(part) // 12 if i % 2 else 0):
                part[r.randrange(len(part))] = "other"
            p = r.randint(0, len(w))
            w[p:p] = [x.upper() + "," if i % 4 == 0 else x for x in part]
            truth.add((i, str(j)))
        texts.append(" ".join(w))
    return texts + [None, "", "too short item"], items, truth


def brute(texts, items):
    """Every alignment of every text and item, without seeds."""
    import re

    split = lambda t: re.split(dc.SEPARATORS, t.lower()) if t is not None else []
    out = set()
    for j, item in enumerate(items):
        b = split(item)
        if len(b) < dc.SPAN:
            continue
        wide = min(13, len(b))
        for i, text in enumerate(texts):
            w = split(text)
            for start in range(-len(b) + wide, len(w) - wide + 1):
                eq = [0 <= start + q < len(w) and w[start + q] == x for q, x in enumerate(b)]
                if any(sum(eq[a : a + wide]) >= -(-wide * 8 // 10) for a in range(len(b) - wide + 1)):
                    out.add((i, str(j)))
                    break
    return out


def test_catches_substituted_passages_and_nothing_else(spark):
    texts, items, truth = world()
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(frame(spark, texts), bench(spark, items)).collect()}
    every = brute(texts, items)
    assert truth <= every | got and got <= every
    assert len(got) >= 0.97 * len(every) and {d for d, _ in truth} <= {d for d, _ in got}


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    texts, items, _ = world(4)
    docs, b = frame(spark, texts), bench(spark, items)
    want = sorted(dc.contaminated(docs, b).select("doc_id", "item_id", "matched", "first").collect())
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 3)
    assert sorted(dc.contaminated(docs, b).select("doc_id", "item_id", "matched", "first").collect()) == want


def test_filter_and_empty_tables(spark):
    texts, items, truth = world(5)
    docs = frame(spark, [*texts, texts[0]], [*range(len(texts)), None])
    kept = dc.drop_contaminated(docs, bench(spark, items))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in truth}
    assert dc.contaminated(frame(spark, []), bench(spark, items)).collect() == []
    assert dc.contaminated(docs, bench(spark, [])).collect() == []


def test_items_of_ten_to_twelve_tokens_survive_any_two_substitutions(spark):
    from itertools import combinations

    items = [" ".join(f"t{n}x{i}" for i in range(n)) for n in (10, 11, 12, 13)]
    texts, truth = [], set()
    for j, item in enumerate(items):
        for gone in combinations(range(10 + j), 2):
            truth.add((len(texts), str(j)))
            texts.append("before " + " ".join("other" if i in gone else w for i, w in enumerate(item.split())) + " after")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(frame(spark, texts), bench(spark, items)).collect()}
    assert got == truth == brute(texts, items)


def test_unspaced_scripts_are_found_by_characters(spark):
    r = random.Random(2)
    draw = lambda n, a, z: "".join(chr(r.randint(a, z)) for _ in range(n))
    items = [draw(20, 0x4E00, 0x9FFF), draw(25, 0x3041, 0x3090), draw(30, 0x4E00, 0x9FFF)]
    split = items[2][:12] + "、" + items[2][12:] + "。"
    texts = [draw(50, 0x4E00, 0x9FFF) + items[0] + draw(9, 0x4E00, 0x9FFF), "abc" + items[1] + "def", items[0][:9] + "x" + items[0][10:], split, draw(80, 0x4E00, 0x9FFF)]
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(frame(spark, texts), bench(spark, items)).collect()}
    assert got == {(0, "0"), (1, "1"), (2, "0"), (3, "2")}

def test_short_items_match_word_for_word(spark):
    """Items of 5 to 9 tokens, whatever marks stand around them; a substituted word makes another text of them, and fewer tokens are a phrase."""
    nine = [f"n{i}" for i in range(9)]
    items = [" ".join(nine), " ".join(nine) + ".", "\"a1 a2 a3 a4 a5\"", "b1 b2 b3 b4"]
    texts = ["x " + " ".join(nine) + " y", " ".join([*nine[:8], "other"]), "A1, a2 a3: a4 a5", "a1 a2 a3 a4 a6", "b1 b2 b3 b4 b5 b6", " ".join(nine[:8])]
    got = {(r.doc_id, r.item_id, r.matched) for r in dc.contaminated(frame(spark, texts), bench(spark, items)).collect()}
    assert got == {(0, "0", 9), (0, "1", 9), (2, "2", 5)}


def test_one_long_item_and_repeated_rows(spark):
    r = random.Random(9)
    long = [f"l{r.randrange(5000)}" for _ in range(10_000)]
    texts = [" ".join(long[4000:4030]), " ".join(f"m{i}" for i in range(50_000)), " ".join(long)]
    docs = frame(spark, [*texts, texts[0]], [0, 1, 2, 0])
    b = bench(spark, [" ".join(long)])
    got = [(x.doc_id, x.item_id) for x in dc.contaminated(docs, b.union(b)).collect()]
    assert sorted(got) == [(0, "0"), (2, "0")]


def test_rows_keep_columns_of_any_name(spark):
    texts, items, truth = world(6)
    docs = spark.createDataFrame([(i, t, 7, 8, 9, 10, 11) for i, t in enumerate(texts)], "doc_id long, text string, k long, _k0 long, _k long, _h long, `a.b` long")
    kept = dc.drop_contaminated(docs, bench(spark, items))
    assert kept.schema == docs.schema
    assert {tuple(r)[2:] for r in kept.collect()} == {(7, 8, 9, 10, 11)}


def test_equals_its_sql(spark):
    """The query's SQL over odd texts: short items, marks, unspaced scripts, repeated rows, null ids."""
    import duckdb
    import pandas as pd

    from wardline.llm.queries import ORACLE

    texts, items, _ = world(7)
    nine = [f"n{i}" for i in range(9)]
    items += [" ".join(nine) + ".", "春眠暁を覚えず処処啼鳥を聞く夜来風雨の声", " ".join(f"t{i}" for i in range(11)), "a b c d"]
    texts += ["x " + " ".join(nine) + " y", "。春眠暁を覚えず処処啼鳥を聞く、夜来風雨の声abc", " ".join("other" if i in (2, 7) else f"t{i}" for i in range(11)), "a b c d e", texts[0]]
    ids = [*range(len(texts) - 2), None, 0]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": texts}))
    con.register("benchmark", pd.DataFrame({"item_id": [str(i) for i in range(len(items))], "text": items}))
    got = dc.contaminated(frame(spark, texts, ids), bench(spark, items)).select("doc_id", "item_id", "matched", "first").collect()
    want = con.sql(ORACLE["op9_decontamination"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(got) > 40
