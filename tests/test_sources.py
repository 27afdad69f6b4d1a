import datetime
import os

import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarates.functions.dates import in_years

from stratarates.sources.headers import (
    clean_names,
    drop_containing,
    rename_by_patterns,
    select_containing,
    snake_name,
    sql_literal,
)
from stratarates.sources.schemas import AAPC, INCIDENCE_COUNTS, MORTALITY_COUNTS, trend_schema
from stratarates.sources.sheets import (
    METADATA_ROWS,
    cast_all_strings,
    drop_metadata_rows,
    read_sheet,
)
from stratarates.sources.layout import read_by_date, read_years, write_by_date
from stratarates.sources.sinks import number_text, with_row_index, write_indexed_csv


@pytest.mark.parametrize(
    "header, want",
    [
        ("Age group (years)", "age_group_years"),
        ("Cancer group/site", "cancer_group_site"),
        ("I.D", "i_d"),
        ("Data type", "data_type"),
        ("ageGroup", "age_group"),
        ("% of total", "percent_of_total"),
        ("2001", "x2001"),
        ("...1", "x1"),
    ],
)
def test_snake_names(header, want):
    assert snake_name(header) == want


def test_repeated_clean_names_are_numbered(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["A b", "a.b", "c"])
    assert clean_names(df).columns == ["a_b", "a_b_2", "c"]


def test_headers_by_fragment_ignore_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Year", "x FEMALE 1", "x Male. 1"])
    assert select_containing(df, ["female"], ["Year"]).columns == ["Year", "x FEMALE 1"]
    assert drop_containing(df, ["male"], ["Year"]).columns == ["Year"]
    assert drop_containing(df, ["."]).columns == ["Year", "x FEMALE 1"]


def test_header_patterns(spark):
    name = "Estimated Resident Population ;  Female ;  100 and over ;"
    df = spark.createDataFrame([(1,)], [name])
    patterns = [
        (r"Estimated Resident Population ;  Female  *", "Age"),
        (r" ;", ""),
        (r"; *", ""),
    ]
    assert rename_by_patterns(df, patterns).columns == ["Age100 and over"]


def test_sql_literals(spark):
    for text in ("plain", "it's", "back\\slash", "25–34"):
        assert spark.sql(f"SELECT {sql_literal(text)}").first()[0] == text
    assert spark.sql(f"SELECT {sql_literal(0.3)} v").schema["v"].dataType == T.DoubleType()


@pytest.mark.parametrize("shuffled", [False, True])
def test_metadata_rows_go_wherever_they_stand(spark, shuffled):
    top = [(label, "x") for label in METADATA_ROWS]
    body = [("37043", "5"), ("37408", "6")]
    df = spark.createDataFrame([body[0], *top, body[1]] if shuffled else top + body, "Year string, a string")
    assert rows(drop_metadata_rows(df, "Year")) == body


def test_cast_all_strings_leaves_other_types(spark):
    df = spark.createDataFrame([("1", "x", 2)], "a string, `b.c` string, n int")
    out = cast_all_strings(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["double", "double", "int"]
    assert rows(out) == [(1.0, None, 2)]


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


HEADER = (
    "cancer_group_site,sex,data_type,year,age_group_years,count\n"
)


def test_plain_sheet(spark, tmp_path):
    write(tmp_path / "s", "a.csv", HEADER + '"Site, x",Females,Actual,2001,25-29,3\nB,Males,Actual,NA,30-34,\n')
    df = read_sheet(spark, str(tmp_path / "s"), MORTALITY_COUNTS)
    assert df.schema == MORTALITY_COUNTS
    assert rows(df) == [
        ("B", "Males", "Actual", None, "30-34", None),
        ("Site, x", "Females", "Actual", 2001, "25-29", 3),
    ]


def test_plain_sheet_with_wrong_header_fails(spark, tmp_path):
    write(tmp_path / "s", "a.csv", "a,b,c,d,e,f\n1,2,3,4,5,6\n")
    with pytest.raises(Exception, match="CSV header"):
        read_sheet(spark, str(tmp_path / "s"), MORTALITY_COUNTS).collect()


def test_sheets_with_a_preamble(spark, tmp_path):
    preamble = "Title\n\nNotes, with comma\nmore\nlast\n"
    for n in range(3):
        write(tmp_path / "s", f"{n}.csv", preamble + HEADER + f"Site,Females,Actual,{2001 + n},25-29,{n}\n\n")
    df = read_sheet(spark, str(tmp_path / "s"), MORTALITY_COUNTS, skip=5)
    assert rows(df.select("year", "count")) == [(2001, 0), (2002, 1), (2003, 2)]


def test_preamble_of_another_length_fails(spark, tmp_path):
    write(tmp_path / "s", "a.csv", "Title\n" + HEADER + "Site,Females,Actual,2001,25-29,3\n")
    with pytest.raises(Exception, match="unexpected header"):
        read_sheet(spark, str(tmp_path / "s"), MORTALITY_COUNTS, skip=2).collect()


def test_file_shorter_than_its_preamble(spark, tmp_path):
    write(tmp_path / "s", "a.csv", "Title\n")
    with pytest.raises(Exception, match="ends before"):
        read_sheet(spark, str(tmp_path / "s"), MORTALITY_COUNTS, skip=4).collect()


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 100 bytes, also within the preamble."""
    keys = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("skip", [1, 4, 5, 40])
def test_one_sheet_of_many_blocks_is_read_by_many_tasks(spark, tmp_path, small_blocks, skip):
    for n in range(2):
        # the preamble repeats the header and a row of the table
        preamble = "".join([HEADER, "Site,Females,Actual,1999,25-29,7\n", "\n", "note\n"][i % 4] for i in range(skip))
        body = "".join(f"Site,Females,Actual,{2000 + i % 20},25-29,{1000 * n + i}\r\n" for i in range(300))
        write(tmp_path / "s", f"{n}.csv", preamble + HEADER + body)
    df = read_sheet(spark, str(tmp_path / "s"), MORTALITY_COUNTS, skip=skip)
    assert df.rdd.getNumPartitions() > 20
    assert rows(df.select("count")) == sorted(((1000 * n + i,) for n in range(2) for i in range(300)), key=repr)


def test_filters_do_not_reach_the_preamble(spark, tmp_path):
    """A filter on a parsed column must not be evaluated on lines that are no rows."""
    write(tmp_path / "s", "a.csv", "Book 1\nCounts\n" + HEADER + "Site,Females,Actual,2001,25-29,3\n")
    df = read_sheet(spark, str(tmp_path / "s"), MORTALITY_COUNTS, skip=2)
    assert rows(df.where("sex = 'Females' AND count > 2").select("count")) == [(3,)]
    assert df.where("year = 2001").count() == 1


def test_a_wrong_header_in_a_later_block_fails(spark, tmp_path, small_blocks):
    text = "a line of the preamble\n" * 9 + "no header\n" + "Site,Females,Actual,2001,25-29,3\n" * 9
    write(tmp_path / "s", "a.csv", text)
    with pytest.raises(Exception, match="unexpected header: no header"):
        read_sheet(spark, str(tmp_path / "s"), MORTALITY_COUNTS, skip=9).collect()


def test_a_preamble_is_read_without_a_shuffle_of_the_lines(spark, tmp_path):
    write(tmp_path / "s", "a.csv", "T\n" + HEADER + "Site,Females,Actual,2001,25-29,3\n")
    plan = plan_of(read_sheet(spark, str(tmp_path / "s"), MORTALITY_COUNTS, skip=1))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "wholetext" not in plan.lower()


def test_blank_and_repeated_headers(spark, tmp_path):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("...1", "x...2", "y", "x...4")])
    for n in range(2):
        write(tmp_path / "s", f"{n}.csv", f',x,y,"x"\n{n},a,NA,b\n')
    df = read_sheet(spark, str(tmp_path / "s"), schema)
    assert rows(df) == [("0", "a", None, "b"), ("1", "a", None, "b")]
    write(tmp_path / "s", "2.csv", "k,x,y,x\n3,a,b,c\n")
    with pytest.raises(ValueError, match="unexpected header"):
        read_sheet(spark, str(tmp_path / "s"), schema)


def test_clean_names_are_distinct(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, `a-b` int, `a_b_2` int")
    assert clean_names(df).columns == ["a_b", "a_b_3", "a_b_2"]


def test_staged_folders_are_removed(spark):
    from stratarates.sources import staging

    staging.stage(spark.range(3).toDF("n"), "gone")
    paths = list(staging._made)
    assert paths and all(os.path.isdir(p.removeprefix("file:")) for p in paths[-1:])
    staging.release()
    assert not any(os.path.isdir(p.removeprefix("file:")) for p in paths) and not staging._made


def test_notes_below_a_table(spark, tmp_path):
    text = "T\n" + HEADER + "Site,Females,Actual,2001,25-29,3\nSource: somewhere\n"
    write(tmp_path / "s", "a.csv", text)
    path = str(tmp_path / "s")
    with pytest.raises(Exception, match="MALFORMED"):
        read_sheet(spark, path, MORTALITY_COUNTS, skip=1).collect()
    lenient = read_sheet(spark, path, MORTALITY_COUNTS, skip=1, mode="PERMISSIVE")
    assert lenient.count() == 2
    assert rows(lenient.where("sex = 'Females'").select("count")) == [(3,)]


def test_schemas_name_the_columns_in_use():
    assert INCIDENCE_COUNTS.names[0] == "i_d" and AAPC.names == ["Cohort", "AAPC"]
    assert trend_schema("Modeled rate").names[-1] == "Modeled rate"


def test_row_index_counts_through_all_groups(spark):
    df = spark.createDataFrame(
        [(g, n) for g in ("b", "a", None) for n in (3, 1, 2)], "g string, n int"
    )
    got = rows(with_row_index(df, ["g", "n"]), "row")
    assert [r[0] for r in got] == list(range(1, 10))
    assert [r[1:] for r in got] == [(g, n) for g in (None, "a", "b") for n in (1, 2, 3)]


def test_row_index_runs_on_over_files(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        df = spark.range(1000).selectExpr("id % 2 AS g", "1000 - id AS n").repartition(7)
        numbered = with_row_index(df, ["g", "n"])
        assert len(numbered.inputFiles()) > 1
        got = rows(numbered, "row")
    finally:
        spark.conf.unset(key)
    want = sorted((i % 2, 1000 - i) for i in range(1000))
    assert got == [(at + 1, *row) for at, row in enumerate(want)]


def part_lines(folder):
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-") and p.endswith(".csv"))
    return [open(os.path.join(folder, p), encoding="utf-8").read().splitlines() for p in parts]


def test_indexed_csv(spark, tmp_path):
    df = spark.createDataFrame(
        [("x, y", 2.5, True, 7), ('q"q', None, None, None), ("a", 1.0, False, 0), ("", 1e5, True, 1), (None, 0.1, True, 2),
         ("NA", float("nan"), True, 3)],
        "s string, v double, b boolean, n int",
    )
    out = str(tmp_path / "out")
    write_indexed_csv(df, out, ["s"])
    parts = part_lines(out)
    assert all(part[0] == '"","s","v","b","n"' for part in parts)
    assert [line for part in parts for line in part[1:]] == [
        '"1",NA,0.1,TRUE,2', '"2","",1e+05,TRUE,1', '"3","NA",NaN,TRUE,3', '"4","a",1,FALSE,0', '"5","q""q",NA,NA,NA',
        '"6","x, y",2.5,TRUE,7',
    ]
    write_indexed_csv(df.where("false"), out, ["s"])
    assert part_lines(out) == [['"","s","v","b","n"']]


def test_indexed_csv_of_several_parts(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    out = str(tmp_path / "out")
    try:
        df = spark.range(1000).selectExpr("IF(id % 3 = 0, 'hot', 'k' || id % 5) AS g", "1000 - id AS n").repartition(5)
        write_indexed_csv(df, out, ["g", "n"])
        text = spark.read.option("header", True).option("nullValue", "NA").csv(out)
        assert text.count() == 1000
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    parts = part_lines(out)
    assert len(parts) == 7 and all(len(p) > 1 for p in parts)
    want = sorted(("hot" if i % 3 == 0 else f"k{i % 5}", 1000 - i) for i in range(1000))
    assert [line for part in parts for line in part[1:]] == [f'"{n}","{g}",{v}' for n, (g, v) in enumerate(want, 1)]


@pytest.mark.parametrize(
    "x, want",
    [(0.0, "0"), (-2.5, "-2.5"), (100000.0, "1e+05"), (123456.0, "123456"), (1e15, "1e+15"), (0.0001, "1e-04"),
     (0.00012, "0.00012"), (1 / 3, "0.333333333333333"), (2 / 3 * 1e-7, "6.66666666666667e-08"), (1e-300, "1e-300"),
     (1234567890123456.0, "1234567890123456"), (1.5e19, "1.5e+19"), (float("-inf"), "-Inf"), (99.99, "99.99"), (10.0, "10"), (1e300, "1e+300")],
)
def test_number_texts_of_exports(spark, x, want):
    assert spark.range(1).select(number_text(F.lit(x)).alias("v")).first()["v"] == want


def scanned(df):
    """Rows that the scans of a plan without exchanges gave to the next operator."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def laid_out(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "lines")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    nameless = lines.limit(5).withColumn("l_shipdate", F.lit(None).cast("timestamp_ntz"))
    write_by_date(lines.unionByName(nameless), path, "l_shipdate", ["l_orderkey"], files=40)
    return path, lines


def test_a_year_cut_reads_that_year(spark, laid_out):
    path, lines = laid_out
    assert sorted(read_by_date(spark, path).columns) == sorted(lines.columns)
    assert read_by_date(spark, path).count() == lines.count() + 5
    for first, last in ((1997, 1997), (1996, 1998)):
        cut = read_years(spark, path, first, last)
        want = lines.where(F.year("l_shipdate").between(first, last))
        assert cut.exceptAll(want.select(cut.columns)).count() == 0 and cut.count() == want.count()
        assert scanned(cut) == cut.count()  # nothing of another year
    assert scanned(read_years(spark, path, 1997, 1997)) < lines.count() / 5
    assert scanned(lines.where(in_years("l_shipdate", 1997, 1997))) == lines.count()


def test_a_month_cut_skips_files_of_the_year(spark, laid_out):
    path, lines = laid_out
    cut = read_by_date(spark, path, datetime.date(1997, 3, 1), datetime.date(1997, 4, 1))
    assert cut.count() == lines.where("date_trunc('month', l_shipdate) = '1997-03-01'").count() > 0
    assert scanned(cut) < scanned(read_years(spark, path, 1997, 1997)) / 2
    assert read_by_date(spark, path, None, datetime.date(1990, 1, 1)).count() == 0


def test_a_day_with_a_third_of_all_rows_fills_several_files(spark, tmp_path):
    day = "IF(id % 3 = 0, DATE'2001-05-05', DATE'2001-01-01' + CAST(id % 300 AS INT))"
    rows = spark.range(9000).selectExpr("id", f"{day} AS d")
    path = str(tmp_path / "hot")
    write_by_date(rows, path, "d", files=9)
    hot = spark.read.parquet(path).where("d = '2001-05-05'").select(F.input_file_name()).distinct().count()
    assert hot >= 3 and rows.exceptAll(read_by_date(spark, path)).count() == 0
