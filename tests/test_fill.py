import random

import pandas as pd
import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from stratarates.operators.fill import fill_forward


def brute_force(data):
    df = pd.DataFrame(data, columns=["g", "o", "v"]).sort_values("o")
    df["v"] = df.groupby("g", dropna=False)["v"].ffill()
    return sorted(
        ((None if g is None else g, o, None if v != v else v) for g, o, v in df.itertuples(index=False)),
        key=repr,
    )


@pytest.mark.parametrize("blocks", [1, 2, 7, 64])
def test_fill_forward_with_a_hot_group(spark, blocks):
    """One group holds a third of all rows; others are small or all NULL."""
    rng = random.Random(blocks)
    orders = rng.sample(range(100_000), 900)
    data = []
    for at, o in enumerate(orders):
        g = "hot" if at % 3 == 0 else ("empty" if at % 3 == 1 else f"g{at % 41}")
        if at % 97 == 0:
            g = None
        v = None if g == "empty" or rng.random() < 0.7 else float(o)
        data.append((g, o, v))
    df = spark.createDataFrame(data, "g string, o long, v double").repartition(5)
    assert rows(fill_forward(df, ["g"], "o", "v", blocks=blocks)) == brute_force(data)


def test_a_long_gap_spans_blocks(spark):
    data = [("a", o, 1.0 if o == 3 else None) for o in range(500)]
    df = spark.createDataFrame(data, "g string, o long, v double")
    assert rows(fill_forward(df, ["g"], "o", "v", blocks=20)) == brute_force(data)


def test_keys_beyond_double_precision_keep_their_order(spark):
    base = 2**60
    data = [("a", base + o, 1.0 * o if o % 3 == 0 else None) for o in range(300)]
    df = spark.createDataFrame(data, "g string, o long, v double").repartition(3)
    assert rows(fill_forward(df, ["g"], "o", "v", blocks=8)) == brute_force(data)


def test_columns_keep_their_order_and_others_are_untouched(spark):
    df = spark.createDataFrame([(1, "x", None, 5), (2, None, 7, 5)], "o int, other string, v int, g int")
    got = fill_forward(df, ["g"], "o", "v", blocks=2)
    assert got.columns == df.columns
    assert rows(got, "o") == [(1, "x", None, 5), (2, None, 7, 5)]


def test_texts_and_dates_can_be_the_order(spark):
    data = [("a", f"{o:04d}", o if o % 4 == 0 else None) for o in range(200)]
    df = spark.createDataFrame(data, "g string, `o.o` string, v int").repartition(4)
    assert rows(fill_forward(df, ["g"], "o.o", "v", blocks=6), "`o.o`") == [(g, o, int(o) // 4 * 4) for g, o, _ in data]


def test_rows_are_sorted_once_and_read_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    hot = "IF(id % 3 = 0, 'hot', 'k' || id % 50) AS g"
    spark.range(6000).selectExpr("id AS o", hot, "IF(id % 7 = 0, id, NULL) AS v").repartition(3).write.parquet(path)
    filled = fill_forward(spark.read.parquet(path), ["g"], "o", "v", blocks=12)
    plan = plan_of(filled)
    # the input is not read again, nothing is sorted by ranges again
    assert path not in plan and plan.count("FileScan parquet") == 2 and "rangepartitioning" not in plan
    placed = filled.select("g", "o").where("g = 'hot'")
    assert placed.count() == 2000
    files = {r["f"]: r["count"] for r in spark.read.parquet(*sorted({f.rsplit("/", 1)[0] for f in filled.inputFiles()}))
             .where("g = 'hot'").groupBy(F.input_file_name().alias("f")).count().collect()}
    assert len(files) >= 3 and max(files.values()) < 1200  # a third of all rows lies in several files
