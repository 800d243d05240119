import hashlib
import random

import numpy as np

from tests.llm.helpers import frame
from wardline.llm.line_dedup import build, line_dedup, slots

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(SPACE).translate(low)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    got = line_dedup(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    lines = ["é" * 40, "ß" * 39, "A common Line that many documents hold, " * 2, "X" * 41, *["only here %d" % i * 5 for i in range(30)]]
    rows = [(i, "\n".join(r.choice(["", " ", "\t"]) + r.choice([str.upper, str.lower, str])(r.choice(lines)).replace("SS", "ß") + r.choice(["", "\r", "  "]) for _ in range(r.randint(0, 12)))) for i in range(60)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (61, None), (62, ""), (63, "\n\n")]
    assert made(spark, rows) == brute(rows)
    assert made(spark, []) == []


def test_four_documents_are_not_enough_and_repeats_are_one(spark):
    line = "0123456789" * 4
    assert made(spark, [(i % 4, line) for i in range(9)]) == brute([(i % 4, line) for i in range(9)])
    rows = [(i, line + "\n" + line) for i in range(5)]
    assert made(spark, rows) == brute(rows)
    assert sum(r[2] for r in brute(rows)) == 8


def test_perfect_hash_is_minimal():
    a, b = np.random.default_rng(1).integers(0, 2**64, (2, 5000), dtype=np.uint64)
    levels = build(a, b)
    assert sorted(slots(levels, a, b)) == list(range(5000))


def test_rows_keep_their_columns(spark):
    line = "0123456789" * 4
    docs = frame(spark, [None, "", *[f"{line}\nown {i}" for i in range(6)]])
    from wardline.llm.line_dedup import line_dedup_rows

    out = line_dedup_rows(docs)
    assert out.schema.names == docs.schema.names
    assert {r.doc_id: r.text for r in out.collect()} == {0: None, 1: "", **{i + 2: f"own {i}" for i in range(5)}, 7: f"{line}\nown 5"}


def test_a_hot_line_and_clashing_names(spark):
    """A line of every document spreads over copies of its shard; other columns, whatever their names, stay."""
    from wardline.llm.line_dedup import line_dedup_rows

    line = "0123456789" * 4
    docs = spark.range(3000).selectExpr("id as doc_id", f"concat('{line}\n', 'only of document ', repeat(cast(id as string), 20)) as text", "id as lost", "id as _lost", "id as k", "id as _k", "id as row", "id as kept")
    out = line_dedup_rows(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == 3000 and {(r["lost"], r["_lost"], r["k"], r["_k"], r["row"], r["kept"]) for r in rows} == {(i,) * 6 for i in range(3000)}
    assert {r.doc_id for r in rows if line in r.text} == {2999}


def test_counts_decide():
    import pyarrow as pa

    from wardline.llm.line_dedup import Shard, shard_arrays

    r = np.random.default_rng(2)
    a, b = r.integers(-(2**63), 2**63, (2, 1000))
    count, last = r.integers(1, 9, 1000), r.integers(0, 10**6, 1000)
    rows = pa.table({"shard": np.zeros(1000, np.int64), "h1": a, "h2": b, "n_docs": count, "last": last})
    shard = Shard(shard_arrays(rows, 5)["arrays"][0].as_py())
    u = lambda x: x.view(np.uint64)
    assert (shard.lost(u(a), u(b), last, 5) == False).all()  # noqa: E712
    assert (shard.lost(u(a), u(b), last - 1, 5) == (count >= 5)).all()


def test_very_long_text(spark):
    long = "\n".join(f"a line that stands only here, number {i:07}" for i in range(40_000))
    rows = [(0, long), (1, "x"), *[(i, "0123456789" * 4) for i in range(2, 8)]]
    assert made(spark, rows) == brute(rows)
