import pandas as pd
from series import frame, season

from tideline.operators import chunks, schema
from tideline.sources import files


def test_chunks_never_exceed_the_limit(spark):
    seen = chunks.map_chunks(
        spark.range(0, 2500, 1, 3), lambda c: pd.DataFrame({"n": [len(c)], "total": [c["id"].sum()]}), "n long, total long", 400
    ).toPandas()
    assert seen["n"].max() <= 400 and seen["n"].sum() == 2500 and seen["total"].sum() == 2499 * 1250


def test_table_without_time_still_gets_basics(spark):
    df = spark.createDataFrame([(0.5, "x"), (1.5, "x"), (1.5, "x")], "level double, note string")
    row = schema.analyze_dataset(df).first()
    assert (row["rows"], row["duplicate_rows"], row["date_column"], row["target_column"]) == (3, 1, None, "level")


def test_dataset_report_names_what_it_found(spark):
    df = spark.createDataFrame(frame({"a": season(60, 7)})).selectExpr("ts AS order_date", "value AS sales")
    row = schema.analyze_dataset(df).first()
    assert (row["date_column"], row["target_column"], row["dataset_type"]) == ("order_date", "sales", "Sales Dataset")
    assert row["seasonality"] == "Strong" and row["frequency"] == "Daily" and row["total_days"] == 59


def test_forced_types_report_overflow(spark):
    df = spark.createDataFrame([(1, 0.5), (1 << 40, 1.5)], "big long, x double")
    found = {r["big"]: r["overflowed"] for r in schema.force_narrow(df).collect()}
    assert found == {1: 0, None: 1}


def test_header_is_the_fullest_row(spark):
    rows = [(0, None, None, None), (1, "a", None, None), (2, "first name", "b-c", None), (3, "x", None, None)]
    fixed = schema.repair_structure(spark.createDataFrame(rows, "i int, p string, q string, r string"), "i")
    assert fixed.columns == ["i", "first_name", "b_c"]
    assert [tuple(r) for r in fixed.orderBy("i").collect()] == [(1, "a", "MISSING_VALUE"), (3, "x", "MISSING_VALUE")]


def test_chunks_span_batches(spark):
    df = spark.range(0, 120_000, 1, 1)
    sizes = chunks.map_chunks(df, lambda c: pd.DataFrame({"n": [len(c)], "low": [c["id"].min()]}), "n long, low long", 50_000).toPandas()
    assert sizes["n"].tolist() == [50_000, 50_000, 20_000] and sizes["low"].tolist() == [0, 50_000, 100_000]
    named = chunks.chunk_results(spark.range(0, 10, 1, 2), lambda c: f"{c['id'].min()}..{c['id'].max()}", "string", 3).toPandas()
    assert sorted(zip(named["partition"], named["chunk"], named["rows"], named["result"])) == [
        (0, 0, 3, "0..2"), (0, 1, 2, "3..4"), (1, 0, 3, "5..7"), (1, 1, 2, "8..9"),
    ]


def test_bad_bytes_go_and_genuine_replacements_stay(spark, tmp_path):
    place = tmp_path / "text.txt"
    raw = "é�x\U0010fffe1\U0010fffe0 y".encode() + b"\xff\xe2\x82 z\xc3\n" + "second �\n".encode() + b"\xef\xbf"
    place.write_bytes(raw)
    want = raw.decode("utf-8", "ignore")
    assert files.read_text(spark, str(place)).first()["value"] == want
    assert [r["value"] for r in files.read_lines(spark, str(place)).collect()] == want.split("\n")
    assert files.preview_file(spark, str(place), 4) == want[:4]
    big = tmp_path / "big.txt"
    big.write_text("ab漢😀" * 500_000)
    assert files.preview_file(spark, str(big), 1_000) == ("ab漢😀" * 250)


def test_header_of_rows_in_date_order(spark):
    import datetime as dt

    days = [dt.date(2024, 1, d) for d in (3, 1, 2)]
    df = spark.createDataFrame([(days[0], "x", "1"), (days[1], "name", "size"), (days[2], "y", None)], "day date, p string, q string")
    fixed = schema.repair_structure(df, "day")
    assert fixed.columns == ["day", "name", "size"] and fixed.count() == 2
