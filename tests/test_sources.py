"""Readers, exports, the revisioned store, scopes and streams."""

from __future__ import annotations

import sqlite3
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canvass.codebook import Codebook, CodebookError, Design, Variable
from canvass.operators import regression, survey, transform
from canvass.plans.context import exclusions, scope_hash, scope_rows, weight_column
from canvass.plans.primitives import running_sum, value_ranks
from canvass.sources import readers, writers
from canvass.streaming.summaries import windowed_counts


def test_formats_are_told_by_their_first_bytes():
    cases = {b"PAR1xx": "parquet", b"ARROW1\0": "arrow", b"SQLite format 3\0": "sqlite", b"% note\n@RELATION r": "arff", b"a\tb\n1\t2": "tsv", b"a,b\n1,2": "csv"}
    for start, want in cases.items():
        assert readers.detect_format("x.csv", start) == want
    for text, name in (("é", "utf-8"), ("日本", "cp932")):
        assert readers.detect_encoding(text.encode(name)) == name
    assert readers.detect_encoding("x".encode("utf-16")) == "utf-16"
    assert readers.unique_names(["a", "a", "", "b", "a"]) == ["a", "a_2", "column_3", "b", "a_3"]


def test_delimited_files_get_types_from_all_rows(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,code,x,x,note\n1,001,1.5,3,"a, ""b"""\n2,002,NA,4,\n\n3,003,2,5,é\n', encoding="utf-8")
    df = readers.read_any(spark, f"file://{path}")
    assert [(f.name, f.dataType.typeName()) for f in df.schema.fields] == [("id", "long"), ("code", "string"), ("x", "double"), ("x_2", "long"), ("note", "string")]
    rows = df.orderBy("id").collect()
    assert rows[0]["note"] == 'a, "b"' and rows[1]["x"] is None and rows[1]["note"] is None and len(rows) == 3
    path.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_delimited(spark, f"file://{path}", infer=False).collect()


def test_other_files(spark, tmp_path):
    arff = tmp_path / "x.arff"
    arff.write_text("% c\n@relation r\n@attribute 'a b' numeric\n@attribute k {x,y}\n@data\n1.5,x\n?,'y'\n{0 3, 1 y}\n")
    assert sorted(map(tuple, readers.read_any(spark, f"file://{arff}").collect()), key=str) == [(1.5, "x"), (3.0, "y"), (None, "y")]
    table = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert readers.read_any(spark, f"file://{tmp_path}/x.arrow").count() == 2
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (n INTEGER, s TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(1, "a"), (None, "b")])
    assert readers.sqlite_tables(str(tmp_path / "x.db")) == ["t"]
    assert sorted(map(tuple, readers.read_sqlite(spark, str(tmp_path / "x.db"), "t").collect()), key=str) == [(1.0, "a"), (None, "b")]


def test_the_encoding_is_that_of_all_lines(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b"id,name\n" + b"".join(b"%d,plain\n" % i for i in range(20_000)) + "20000,日本\n".encode("cp932"))
    assert readers.scan_lines(spark, f"file://{path}") == ("cp932", False)
    df = readers.read_delimited(spark, f"file://{path}")
    assert df.count() == 20_001 and df.where("id = 20000").first()["name"] == "日本"
    path.write_text('a,b\n1,"two\nlines"\n', encoding="utf-8")
    assert readers.scan_lines(spark, f"file://{path}") == ("utf-8", True)
    assert readers.read_delimited(spark, f"file://{path}").first()["b"] == "two\nlines"
    path.write_text("a,b\n1,é\n", encoding="utf-16")
    assert readers.read_delimited(spark, f"file://{path}").first()["b"] == "é"
    path.write_bytes(b"")
    with pytest.raises(CodebookError):
        readers.read_delimited(spark, f"file://{path}")


def test_a_header_may_be_long(spark, tmp_path):
    path = tmp_path / "x.arff"
    path.write_text("@relation r\n" + "% a comment line of the header\n" * 40_000 + "@attribute a numeric\n@data\n1\n2\n")
    assert sorted(r["a"] for r in readers.read_arff(spark, f"file://{path}").collect()) == [1.0, 2.0]


def test_tasks_read_parts_of_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.arrow")
    table = pa.table({"n": pa.array(range(10)), "c": pa.array(list("ababababab")).dictionary_encode(), "t": pa.array(range(10), pa.timestamp("ns"))})
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table, max_chunksize=3)
    df = readers.read_arrow(spark, path)
    assert df.rdd.getNumPartitions() == 4
    assert [(r["n"], r["c"]) for r in df.orderBy("n").collect()] == [(i, "ab"[i % 2]) for i in range(10)]
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema):
        pass
    assert readers.read_arrow(spark, f"file://{path}").count() == 0

    monkeypatch.setattr(readers, "RANGE_ROWS", 7)
    base = str(tmp_path / "x.db")
    with sqlite3.connect(base) as db:
        db.execute('CREATE TABLE "my ""t" (n, s, e)')
        db.executemany('INSERT INTO "my ""t" VALUES (?, ?, NULL)', [(i if i % 3 else float(i), "x" if i == 49 else i) for i in range(50)])
        db.execute("CREATE TABLE none (a INTEGER)")
        db.execute("CREATE TABLE keyed (a TEXT PRIMARY KEY, b REAL) WITHOUT ROWID")
        db.executemany("INSERT INTO keyed VALUES (?, ?)", [("p", 1.5), ("q", None)])
    df = readers.read_sqlite(spark, base, 'my "t')
    assert df.rdd.getNumPartitions() > 5
    assert [(r["n"], r["s"]) for r in df.orderBy("n").collect()] == [(float(i), "x" if i == 49 else str(i)) for i in range(50)]
    assert readers.read_sqlite(spark, base, "none").count() == 0
    assert sorted(map(tuple, readers.read_sqlite(spark, base, "keyed").collect())) == [("p", 1.5), ("q", None)]


def test_row_ids_are_unique_and_stable(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k long, v string")
    assert [tuple(r)[:2] for r in readers.with_row_ids(df, order="k").orderBy("k").collect()] == [("ROW-000001", 1), ("ROW-000002", 2), ("ROW-000003", 3)]
    with pytest.raises(CodebookError):
        readers.with_row_ids(df.union(df), column="k")


def test_exports_and_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1"), (2, "-5"), (3, "ok"), (4, None)], "n long, t string")
    assert [r["t"] for r in writers.for_export(df).collect()] == ["'=1+1", "-5", "ok", None]
    book = Codebook((Variable("n", value_labels={"1": "one"}),))
    assert writers.for_export(df, book, ["n"]).first()["n"] == "one"
    writers.write_xlsx(df, str(tmp_path / "x.xlsx"))
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row>") == 5 and "'=1+1" in sheet
    a, b = writers.fingerprint(df).first(), writers.fingerprint(df.orderBy(F.desc("n")).repartition(3)).first()
    assert a == b and writers.fingerprint(df.where("n < 4")).first() != a


def test_store_undoes_and_redoes(spark, tmp_path):
    store = writers.Store(spark, f"file://{tmp_path}/d")
    first = spark.createDataFrame([(1, None), (2, 5.0)], "k long, x double")
    store.commit(first, "import")
    store.commit(transform.fill(first, ["x"], "mean"), "impute", expected=0, strategy="mean")
    assert store.load().where("x IS NULL").count() == 0
    assert store.undo() == 0 and store.load().where("x IS NULL").count() == 1
    assert store.redo() == 1 and [o["kind"] for o in store.history()] == ["import", "impute"]
    with pytest.raises(CodebookError):
        store.commit(first, "late", expected=0)
    with pytest.raises(CodebookError):
        store.redo()


def test_of_two_writers_of_a_store_one_fails(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    a, b = writers.Store(spark, folder), writers.Store(spark, folder)
    a.commit(spark.range(3), "load")
    seen = b._read()
    a.commit(spark.range(5), "grow", expected=0)
    with pytest.raises(CodebookError):
        b._write(seen | {"cursor": 0})
    with pytest.raises(CodebookError):
        b.commit(spark.range(9), "other", expected=0)
    assert b.load().count() == 5 and b.load(0).count() == 3 and [o["kind"] for o in b.history()] == ["load", "grow"]


def test_workbooks_leave_cells_empty_that_are_not_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "x double")
    writers.write_xlsx(df.coalesce(1), f"{tmp_path}/x.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/x.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<c/>") == 3 and "<v>1.5</v>" in sheet and "nan" not in sheet and "inf" not in sheet


def test_a_scope_table_with_unknown_ids_is_refused(spark):
    df = spark.range(5).withColumnRenamed("id", "__rowId__")
    assert scope_rows(df, df.limit(2)).count() == 2
    with pytest.raises(CodebookError):
        scope_rows(df, df.select((F.col("__rowId__") + 3).alias("__rowId__")))


def test_rows_out_of_the_fit_stay_in_the_survey_frame(spark):
    rows = [(i, float(i % 7), float(i % 7) * 2 + (i % 3), 1.0 + i % 2, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, w double, psu int")
    part = df.where("psu < 3")
    book = Codebook(design=Design("w", psu="psu"))
    fit = regression.linear_regression(part, "y", {"x": F.col("x")}, "w", "survey", covariance="classical", keep=["id", "w", "psu"])
    whole, dof = regression.taylor_fit(fit, book, "id", df)
    _, fewer = regression.taylor_fit(fit, book, "id", part)
    assert dof == fewer + 2
    w, x, e = (np.array([r[k] for r in part.orderBy("id").collect()]) for k in ("w", "x", "y"))
    psu = np.array([r["psu"] for r in part.orderBy("id").collect()])
    design = np.column_stack([np.ones(len(x)), x])
    bread = np.linalg.inv(design.T @ (design * w[:, None]))
    scores = design * (w * (e - design @ (bread @ design.T @ (w * e))))[:, None]
    totals = np.array([scores[psu == p].sum(axis=0) for p in range(5)])
    centred = totals - totals.mean(axis=0)
    assert np.allclose(whole, bread @ (centred.T @ centred * 5 / 4) @ bread)


def test_scopes_weights_and_exclusions(spark):
    df = spark.createDataFrame([(str(i), float(i % 3)) for i in range(9)], "__rowId__ string, w double")
    assert scope_rows(df, None).count() == 9 and scope_rows(df, []).count() == 0 and scope_rows(df, ["1", "1", "4"]).count() == 2
    with pytest.raises(CodebookError):
        scope_rows(df, ["x"])
    assert df.agg(scope_hash(df)).first() == df.orderBy(F.desc("w")).agg(scope_hash(df)).first()
    assert {tuple(r) for r in exclusions(df, {"zero": F.col("w") == 0, "late": F.col("__rowId__") == "8"}).collect()} == {("zero", 3), ("late", 1), ("included", 5)}
    assert weight_column(df, Design("w", "frequency")) is not None
    for bad in (-1.0, 0.5):
        with pytest.raises(CodebookError):
            weight_column(df.withColumn("w", F.lit(bad)), Design("w", "frequency"))


def test_running_sums_and_ranks_need_no_table_wide_window(spark):
    df = spark.createDataFrame([(float(i * 7 % 50), i % 2, 1) for i in range(500)], "v double, g int, one int")
    ranks = {r["v"]: r["avg_rank"] for r in value_ranks(df, "v").collect()}
    values = sorted(float(i * 7 % 50) for i in range(500))
    assert ranks == {v: values.index(v) + (values.count(v) + 1) / 2 for v in set(values)}
    sums = running_sum(df.groupBy("v", "g").agg(F.sum("one").alias("n")), "v", "n", ["g"])
    got = {(r["v"], r["g"]): r["before"] for r in sums.collect()}
    rows = [(float(i * 7 % 50), i % 2) for i in range(500)]
    assert got == {(v, g): sum(1 for w, h in rows if h == g and w < v) for v, g in set(rows)}


def test_taylor_fit_of_one_row_a_psu_is_the_sandwich(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x, w = rng.normal(size=80), rng.integers(1, 4, 80).astype(float)
    y = 1 + 2 * x + rng.normal(size=80)
    df = spark.createDataFrame([(i, float(x[i]), float(y[i]), float(w[i])) for i in range(80)], "id long, x double, y double, w double")
    fit = regression.linear_regression(df, "y", {"x": F.col("x")}, "w", "survey", covariance="classical", keep=["id", "w"])
    v, dof = regression.taylor_fit(fit, Codebook(design=Design("w")), "id", df)
    m = np.column_stack([np.ones(80), x])
    b = np.linalg.inv(m.T * w @ m)
    s = m * (w * (y - m @ (b @ (m.T * w @ y))))[:, None]
    assert v == pytest.approx(b @ (s.T @ s) @ b * 80 / 79, rel=1e-8) and dof == 78
    assert survey.weight_diagnostics(df, "w").first()["n_eff"] == pytest.approx(w.sum() ** 2 / (w**2).sum())


def test_stream_counts_match_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "ab"[m % 2], float(m)) for m in range(50)]
    batch = spark.createDataFrame(rows, "ts string, code string, value double").withColumn("ts", F.to_timestamp("ts"))
    batch.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = windowed_counts(stream, "code", "ts", "10 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(batch, "code", "ts", "10 minutes").collect()))
