"""Readers against odd files, and writers read back."""

from pyspark.sql import functions as F

from wardline.sources import readers, writers


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_ratings(spark, tmp_path):
    p = put(tmp_path / "r", "user item\n1::2::5::9\n3\t4\t2.5\n5,6\n-1 3\nx y\n7 8.0 1\n\n")
    got = sorted((r.u, r.i, r.rating, r.ts) for r in readers.ratings(spark, p).fillna(0).collect())
    assert got == [(1, 2, 5.0, 9), (3, 4, 2.5, 0), (5, 6, 0.0, 0), (7, 8, 1.0, 0)]
    d = readers.dimensions(readers.ratings(spark, p)).first()
    assert (d.num_users, d.num_items) == (8, 9)


def test_negative_pool_round_trip(spark, tmp_path):
    p = put(tmp_path / "n", "(1,2)\t3\t4\n5 6 7\nbad\n")
    rows = readers.negative_pool(spark, p)
    assert sorted((r.u, r.pos, r.place, r.i) for r in rows.collect()) == [(1, 2, 0, 2), (1, 2, 1, 3), (1, 2, 2, 4), (5, 6, 0, 6), (5, 6, 1, 7)]
    writers.negative_lines(rows, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["(1,2)\t3\t4", "(5,6)\t7"]


def test_dat_table_and_guide(spark, tmp_path):
    p = put(tmp_path / "m.dat", "1::Café (1999)::Drama\n", "latin-1")
    assert readers.dat(spark, p, ["mid", "title", "genres"]).first().title == "Café (1999)"
    c = put(tmp_path / "g.csv", '﻿TConst, isAdult ,sex_code,violence_code\n12,1,3,x\n,0,1,1\n')
    r = readers.guide(spark, c).collect()
    assert [(x.tconst, x.is_adult, x.sex, x.violence, x.drug) for x in r] == [("tt0000012", True, 3, 1, 1)]
    x = put(tmp_path / "l.csv", "movieId,imdbId\n1,114709\n2,\n")
    assert [(r.movie_id, r.tconst) for r in readers.links(spark, x).collect()] == [(1, "tt0114709")]


def test_predictions_and_profiles_last_line_wins(spark, tmp_path):
    p = put(tmp_path / "p.jsonl", '{"metadata": {"user_id": 1, "item_id": 2}, "psg_pred": 1, "p1": 0.7}\n\nnot json\n{"user_id": 1, "metadata": {"candidate_inner_item_id": 2}, "p1": "0.9", "margin": 0.8}\n')
    r = readers.predictions(spark, p).collect()
    assert [(x.u, x.i, x.psg_pred, x.p1, x.margin) for x in r] == [(1, 2, 0, 0.9, 0.8)]
    q = put(tmp_path / "q.jsonl", '{"user_id": 1, "profile": {"a": 1}}\n{"user_id": 1, "profile": {"a": 2}}\n{"user_id": 2, "profile": {}, "parse_error": true}\n')
    assert [(x.u, x.profile) for x in readers.profiles(spark, q).collect()] == [(1, '{"a":2}')]


def test_objects_overlay_sequences(spark, tmp_path):
    p = put(tmp_path / "o.json", '{"1": {"title": "A", "adult": true},\n "2": {"title": "B"}}')
    assert sorted((r.key, r.title, r.adult) for r in readers.keyed_objects(spark, p, "title string, adult boolean").fillna(False).collect()) == [("1", "A", True), ("2", "B", False)]
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k long, t string, n int")
    b = spark.createDataFrame([(2, None, "z"), (3, "w", "v")], "k long, t string, m string")
    assert sorted((r.k, r.t, r.n or 0, r.m or "") for r in readers.overlay(a, b, "k").collect()) == [(1, "x", 1, ""), (2, "y", 2, "z"), (3, "w", 0, "v")]
    s = put(tmp_path / "s", "1 1\n0 5\n2 3\n")
    assert sorted((r.u, r.i) for r in readers.sequences(spark, s).collect()) == [(0, 0), (1, 2)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "a,\"b\""), (2, 1 / 3, None)], "u long, x double, t string")
    writers.metric_table(rows, str(tmp_path / "m"), 3)
    assert sorted(r.x for r in readers.table(spark, str(tmp_path / "m")).collect()) == ["0.333", "0.500"]
    writers.csv_table(rows, str(tmp_path / "c"))
    assert {r.t for r in readers.table(spark, str(tmp_path / "c")).collect()} == {'a,"b"', None}
    writers.json_lines(rows.withColumn("metadata", F.lit("m")), str(tmp_path / "j"), metadata=False)
    writers.json_lines(rows, str(tmp_path / "j"), append=True)
    assert readers.json_lines(spark, str(tmp_path / "j")).columns == ["t", "u", "x"] and spark.read.json(str(tmp_path / "j")).count() == 4
    assert writers.fingerprint(rows).first() == writers.fingerprint(rows.repartition(3)).first()
    assert '"u": 1' in writers.summary_json(rows)
    writers.rating_lines(rows.withColumn("i", F.lit(3)), str(tmp_path / "r"), ["u", "i"])
    assert sorted((r.u, r.i) for r in readers.ratings(spark, str(tmp_path / "r")).collect()) == [(1, 3), (2, 3)]
    assert "gender" not in writers.private_columns_dropped(rows.withColumn("gender", F.lit("x"))).columns


def test_links_of_large_keys_equal_sql(spark, tmp_path):
    import duckdb

    from wardline.plans import catalog

    duckdb.sql(f"copy (select unnest([1, 2, 322580, 322581, 322583, 1199999])::bigint p_partkey) to '{tmp_path}/part.parquet' (format parquet)")
    with duckdb.connect() as con:
        con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
        want = con.sql(catalog.ORACLE["file_links"]).fetchall()
    got = catalog.QUERIES["file_links"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 5
