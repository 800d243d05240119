"""The pipeline's stages on the smallest documents against brute force."""

import corpus_pipeline
from tests.llm import test_decontamination, test_line_dedup, test_simhash
from wardline.llm.common import table
from wardline.llm.language_id import identify
from wardline.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def lines_kept(rows):
    """The texts after line dedup, line by line."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(test_line_dedup.SPACE).translate(low)
    held = {}
    for i, t in rows.items():
        for line in t.split("\n"):
            held.setdefault(key(line), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in rows.items()}


def test_run_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in identify(docs).where("rejected").collect():
        del texts[r.doc_id]
    texts = lines_kept(texts)
    groups = test_simhash.brute_groups({i: test_simhash.brute_print(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = [r.text for r in table(spark, SMALL, "benchmark").orderBy("item_id").collect()]
    hit = {j for j, _ in test_decontamination.brute(list(texts.values()), items)}
    texts = {i: t for j, (i, t) in enumerate(texts.items()) if j not in hit}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == set(texts)

    from tokenizers import Tokenizer
    from wardline.llm.queries import tokenizer_file

    whole = Tokenizer.from_file(tokenizer_file())
    want = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {r.doc_id: r.doc_tokens for r in pieces} == want
    assert sum(r.length for r in pieces) == sum(want.values())


def test_odd_rows_and_columns_go_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, shared and missing ids, extra columns."""
    from pyspark.sql import functions as F

    docs = table(spark, SMALL, "documents").withColumns({"k": F.lit(7), "_k0": F.lit(8), "row": F.lit(9), "kept": F.lit(10)})
    texts = {r.doc_id: r.text for r in docs.collect()}
    german = [t for i, t in sorted(texts.items()) if 80 < len(t.split()) < 300][:8]
    extra = [(900, None), (901, ""), (902, "1 2 3"), (None, german[0] + " " + german[1]), (None, german[2] + " " + german[3]), (903, german[4] + " " + german[5]), (903, german[6] + " " + german[0]), (904, " ".join([*german, *texts.values()]))]
    rows = spark.createDataFrame([(i, t) for i, t in extra], "doc_id long, text string")
    more = docs.unionByName(rows, allowMissingColumns=True).fillna({"k": 7, "_k0": 8, "row": 9, "kept": 10})
    more = more.unionByName(more.where("doc_id = 904 or doc_id < 20"))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SMALL, "benchmark").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert sorted(step.columns) == sorted(docs.columns), name
    kept = step.collect()
    ids = [r.doc_id for r in kept]
    assert not {900, 901, 902} & set(ids) and ids.count(904) == 1 and ids.count(None) == 2 and ids.count(903) == 2
    assert len(kept) == len({(r.doc_id, r.text) for r in kept}) and {(r.k, r["_k0"], r.row, r.kept) for r in kept} == {(7, 8, 9, 10)}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(i or -1 for i in ids) == sorted(r.doc_id or -1 for r in pieces if r.start == 0)


def test_a_run_is_taken_up_after_its_last_stage(spark, tmp_path, monkeypatch):
    base, ran = f"file://{tmp_path}/run", []

    def told(name, stage, fails):
        def f(spark, docs, sf_dir):
            ran.append(name)
            if fails:
                raise RuntimeError(name)
            return stage(spark, docs, sf_dir)

        return f

    stages = corpus_pipeline.STAGES
    for at in (2, None):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, told(n, f, i == at)) for i, (n, f) in enumerate(stages)])
        try:
            rows = corpus_pipeline.run(spark, SMALL, base)
        except RuntimeError:
            continue
    assert ran == [n for n, _ in stages[:3]] + [n for n, _ in stages[2:]]
    assert rows.count() > 0 and [p.name for p in (tmp_path / "run").iterdir()] == [stages[-1][0]]


def test_stages_keep_the_columns(spark):
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name


def test_every_query_has_its_contract_columns(spark):
    want = {
        "op1_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
        "op2_url_filters": {"page_id", "host", "path", "rule", "verdict"},
        "op3_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op4_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op5_secret_scans": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op6_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
        "op7_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op8_simhash": {"doc_id", "fingerprint", "component_id"},
        "op9_decontamination": {"doc_id", "item_id"},
        "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    }
    for name, columns in want.items():
        assert columns <= set(QUERIES[name](spark, SMALL).columns), name
