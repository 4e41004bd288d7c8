import pytest

from panel_rows import rows
from panelyard.plans.queries_sources import stored_means
from panelyard.sources import (
    literal_table, numbered_lines, read_csv_checked, read_csv_skip, read_dim, read_table, store_panel, write_table,
)


def test_read_dim_drops_a_repeated_header(spark, tmp_path):
    f = tmp_path / "regions.csv"
    f.write_text("countrycode,region\nALB,Central Asia\nCode,Region\nAFG,South Asia\n")
    df = read_dim(spark, str(f), "countrycode string, region string")
    assert rows(df) == [("AFG", "South Asia"), ("ALB", "Central Asia")]


def test_read_csv_skip_handles_every_file_of_a_folder(spark, tmp_path):
    for name in "AB":
        (tmp_path / f"{name}.csv").write_text(
            '"Data Source","x"\n\n"Last Updated","y"\n\n"Name","Code","x1960"\n'
            f'"One, {name}","{name}AA",1.5\n"Two","{name}BB",\n'
        )
    df = read_csv_skip(spark, str(tmp_path), 4, "name string, code string, x1960 double")
    assert rows(df) == [
        ("One, A", "AAA", 1.5), ("One, B", "BAA", 1.5), ("Two", "ABB", None), ("Two", "BBB", None),
    ]


def test_write_and_read_back(spark, tmp_path):
    df = literal_table(spark, [("A", 1990, 1.25), ("B", 1991, None)], "code string, year int, value double")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        write_table(df, path, fmt)
        assert rows(read_table(spark, path, df.schema, fmt)) == rows(df)
    write_table(df, str(tmp_path / "by_year"), partition_by=["year"])
    assert rows(spark.read.parquet(str(tmp_path / "by_year")).select("code", "year", "value")) == rows(df)


def test_format_follows_the_path(spark, tmp_path):
    df = literal_table(spark, [("A", 1.0)], "code string, value double")
    path = str(tmp_path / "t.parquet")
    write_table(df, path)
    assert rows(read_table(spark, path, df.schema)) == [("A", 1.0)]


def test_a_header_in_another_order_is_an_error(spark, tmp_path):
    f = tmp_path / "regions.csv"
    f.write_text("region,countrycode\nEurope,ALB\n")
    for read in (read_dim, lambda s, p, schema: read_table(s, p, schema, "csv")):
        with pytest.raises(Exception, match="(?i)header"):
            read(spark, str(f), "countrycode string, region string").collect()


def test_a_preamble_longer_than_the_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("one\ntwo\n")
    with pytest.raises(ValueError, match="preamble"):
        read_csv_skip(spark, str(tmp_path), 4, "a string")


def test_broken_records_are_found(spark, tmp_path):
    """Wrong types and numbers of fields are quarantined with file and line; several lines are one record."""
    (tmp_path / "a.csv").write_text('Source\n\nk,v,t\n1,2.5,x\n2,abc,y\n3,,"two\nlines, one record"\n4,1.0\n\n5,7.0,"say ""hi""",more\n6,1e3,z\n')
    (tmp_path / "b.csv").write_text("Source\n\nk,v,t\n7,8.0,w\n")
    good, broken = read_csv_checked(spark, str(tmp_path), "k int, v double, t string", skip=2, several_lines=True)
    assert rows(good) == [(1, 2.5, "x"), (3, None, "two\nlines, one record"), (6, 1000.0, "z"), (7, 8.0, "w")]
    found = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["record"]) for r in broken.collect())
    assert found == [("a.csv", 5, "2,abc,y"), ("a.csv", 8, "4,1.0"), ("a.csv", 10, '5,7.0,"say ""hi""",more')]
    with pytest.raises(ValueError, match="preamble"):
        read_csv_checked(spark, str(tmp_path), "k int", skip=20)


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Splits of a few bytes: numbers run on over them, and records over their ends."""
    text = "top\nk,t\n" + "".join(f'{i},"a\nb"\n' if i % 5 == 0 else f"{i},c\n" for i in range(4000))
    (tmp_path / "a.csv").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = numbered_lines(spark, str(tmp_path)).collect()
        assert len({r["_start"] for r in lines}) > 4
        assert [r["value"] for r in sorted(lines, key=lambda r: r["line"])] == text.split("\n")[:-1]
        good, broken = read_csv_checked(spark, str(tmp_path), "k int, t string", skip=1, several_lines=True)
        assert rows(good) == sorted(((i, "a\nb" if i % 5 == 0 else "c") for i in range(4000)), key=repr) and broken.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stored_panels_need_no_exchange(spark):
    a = spark.range(500).selectExpr("id % 50 as entity", "id div 50 as period", "id * 1.5 as num")
    b = spark.range(500).selectExpr("id % 50 as entity", "id div 50 as period", "id + 1 as orders")
    made = stored_means(store_panel(a, ["entity"], 4), store_panel(b, ["entity"], 4))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert rows(made) == rows(stored_means(a, b))
