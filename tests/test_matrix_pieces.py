"""A score matrix is written in small pieces, and none of it moves."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wardline.operators import scoring
from wardline.sources import writers


def test_a_matrix_is_written_in_small_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "MATRIX_BYTES", 1 << 20, raising=False)
    vector = lambda name: F.array(F.rand(1), F.rand(2)).alias(name)
    users, items = spark.range(40).select((39 - F.col("id")).alias("u"), vector("p")), spark.range(20_000).select(F.col("id").alias("i"), vector("q"))
    rows = scoring.score_rows(users, items, scoring.dot_scorer(), ["p"])
    plan = rows._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert "Exchange" not in plan[0] and "Sort" in plan[1]
    writers.score_matrix(rows, at := f"file://{tmp_path}/m", ordered=True)
    files = [pq.ParquetFile(p) for p in (tmp_path / "m").glob("*.parquet")]
    assert max(f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)) < 10
    assert all((u := f.read(["u"])["u"].to_pylist()) == sorted(u) for f in files)
    got = spark.read.parquet(at)
    assert got.count() == 40 and got.where("size(scores) <> 20000").count() == 0
