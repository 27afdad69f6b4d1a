"""How the star-schema tables stand in for counts, populations and trend sheets.

A line item is a person-year: its quantity is the single age (1..50), its ship
year the year, its part type the code; a returned line is an event.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarates.functions.dates import date_to_serial
from stratarates.functions.text import BROKEN_EN_DASH, EN_DASH
from stratarates.operators.bands import band_of, unit_members
from stratarates.operators.counts import with_totals
from stratarates.operators.rates import INCIDENCE_VARIANTS, MORTALITY_VARIANTS
from stratarates.operators.reshape import widen
from stratarates.operators.trends import CHANGE_POINT, AnchorRules
from stratarates.plans.populations import exposed_bands, population_bands_long
from stratarates.plans.settings import RateSettings, pair_bands
from stratarates.sources.staging import stage, stage_folder
from stratarates.sources.literals import literal_table
from stratarates.sources.sheets import METADATA_ROWS

UNITS = tuple(range(1, 51))
NARROW = unit_members(range(1, 51, 5), last_unit=50, open_end=False, digits=2)
WIDE = pair_bands(NARROW)
# wide band -> single ages
WIDE_UNITS = {w: tuple(u for n in narrow for u in NARROW[n]) for w, narrow in WIDE.items()}
FIRST_YEAR, LAST_YEAR = 1995, 2001
LINE_SHEET = T.StructType([
    T.StructField("order", T.LongType()), T.StructField("line", T.IntegerType()),
    T.StructField("age", T.IntegerType()), T.StructField("flag", T.StringType()),
])
PERIODS = {
    "Applied to the period 1995-1996": (1995, 1996),
    "Applied to the period 1997-1998": (1997, 1998),
    "Applied to the period 1999-2000": (1999, 2000),
    "Applied to the period 2001": (2001, 2001),
}
OPEN_FRACTION, OPEN_BAND = "46+", f"46{EN_DASH}50"
# fraction still exposed: falls with age, rises a little with the period
FRACTIONS = [
    (OPEN_FRACTION if band == OPEN_BAND else band,)
    + tuple((98 - 3 * row + column) / 100 for column in range(len(PERIODS)))
    for row, band in enumerate(NARROW)
]

STRATA = {
    "A": ("ECONOMY",),
    "B": ("LARGE",),
    "C": ("MEDIUM",),
    "D": ("SMALL",),
    "Other": ("PROMO",),
}
UNSPECIFIED = "STANDARD"
ALL_TYPES = "All types"

_common = dict(
    units=NARROW,
    bands=WIDE,
    excluded_bands=(f"01{EN_DASH}10",),
    periods=PERIODS,
    fraction_recode={OPEN_FRACTION: OPEN_BAND},
    years=(FIRST_YEAR, LAST_YEAR),
    ref_year=FIRST_YEAR,
    extract_years=(1995, 1998, 2001),
)
SETTINGS = RateSettings(
    **_common,
    variants=INCIDENCE_VARIANTS,
    strata=STRATA,
    targets=("A", "B", "C"),
    unspecified=UNSPECIFIED,
    pooled=("B", "D"),
    late_after=1997,
    early_bands=(f"11{EN_DASH}20", f"21{EN_DASH}30"),
    early_label="<31",
    late_label="31+",
)
NO_STRATA = RateSettings(**_common, variants=MORTALITY_VARIANTS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line level: keys, Year, unit_age, is_event."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_linestatus",
        "l_shipdate",
        F.year("l_shipdate").alias("Year"),
        F.col("l_quantity").cast("int").alias("unit_age"),
        (F.col("l_returnflag") == "R").alias("is_event"),
    )


def typed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their part type.

    ``part`` grows with the data, so there is no broadcast hint: it is broadcast
    only while its scanned size is below the session's threshold.  Beyond it the
    join shuffles both sides on the part key, and AQE splits a part key that
    holds a large share of the lines (both sides of an inner join qualify; the
    aggregate that follows needs no particular partitioning of its input).
    """
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.coalesce("p_type", F.lit("UNKNOWN")).alias("p_type"),
    )
    return lines(spark, sf).join(part, "l_partkey")


def events(is_event: str = "is_event") -> Column:
    return F.count_if(is_event).alias("events")


def type_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(p_type, Year, unit_age, lines, events): the one pass over the lines."""
    return (
        typed_lines(spark, sf)
        .groupBy("p_type", "Year", "unit_age")
        .agg(F.count(F.lit(1)).alias("lines"), events())
    )


def unit_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(Year, unit_age, lines, events), without the part join."""
    return (
        lines(spark, sf)
        .groupBy("Year", "unit_age")
        .agg(F.count(F.lit(1)).alias("lines"), events())
    )


def staged_type_cells(spark: SparkSession, sf: str) -> DataFrame:
    return stage(type_cells(spark, sf), "type-cells")


def staged_unit_cells(spark: SparkSession, sf: str) -> DataFrame:
    return stage(unit_cells(spark, sf), "unit-cells")


def fact(cells: DataFrame) -> DataFrame:
    """Counts by code, year and wide band, with NULL-code total rows and the
    all-cases total of the cell on every row."""
    banded = cells.withColumn("Age", band_of("unit_age", WIDE_UNITS))
    both = with_totals(banded, "p_type", ["Year", "Age"], "events", "Count", "ALLUterineCancers")
    return both.select(
        F.coalesce("p_type", F.lit(ALL_TYPES)).alias("cancer_type"),
        "Year",
        "Age",
        "Count",
        "ALLUterineCancers",
        F.col("p_type").alias("i_d"),
    )


def population(cells: DataFrame) -> DataFrame:
    """(Year, unit_age, pop)."""
    if "p_type" not in cells.columns:
        return cells.select("Year", "unit_age", F.col("lines").alias("pop"))
    return cells.groupBy("Year", "unit_age").agg(F.sum("lines").alias("pop"))


def narrow_population(cells: DataFrame) -> DataFrame:
    return population_bands_long(population(cells), SETTINGS)


def fractions(spark: SparkSession) -> DataFrame:
    fields = [("Age", pa.string())] + [(p, pa.float64()) for p in PERIODS]
    return literal_table(spark, fields, FRACTIONS)


def exposed(cells: DataFrame) -> DataFrame:
    """(Year, Age, pop, withouthyst) in wide bands."""
    return exposed_bands(narrow_population(cells), fractions(cells.sparkSession), SETTINGS)


def event_cells(cells: DataFrame) -> DataFrame:
    """(Year, Age, Count) without strata or the youngest band."""
    return (
        cells.withColumn("Age", band_of("unit_age", WIDE_UNITS))
        .where(~F.col("Age").isin(list(SETTINGS.excluded_bands)))
        .groupBy("Year", "Age")
        .agg(F.sum("events").alias("Count"))
    )


# wide sheets ---------------------------------------------------------------


def age_header(sex: str, unit: int) -> str:
    return f"Estimated Resident Population ;  {sex} ;  {unit} ;"


def population_sheet(cells: DataFrame) -> DataFrame:
    """A wide text sheet as published: date serials and metadata rows in a column
    with a repaired blank header, one column per sex and single age (all lines
    as Female, lines without an event as Male)."""
    by_unit = cells.groupBy("Year", "unit_age").agg(
        F.sum("lines").cast("string").alias("Female"),
        (F.sum("lines") - F.sum("events")).cast("string").alias("Male"),
    )
    wide = widen(by_unit, ["Year"], "unit_age", UNITS, ["Female", "Male"])
    serial = date_to_serial(F.make_date("Year", F.lit(6), F.lit(1))).cast("string")
    body = wide.select(
        serial.alias("...1"),
        *[
            F.col(f"{sex}_{u}").alias(age_header(sex, u))
            for sex in ("Male", "Female")
            for u in UNITS
        ],
    )
    top = literal_table(
        cells.sparkSession, [("...1", pa.string())], [(label,) for label in METADATA_ROWS]
    )
    return top.unionByName(body, allowMissingColumns=True)


PREAMBLE = ("Lines of one year", "", "Source: the order lines, see notes", "year,unit_age,lines", "Table 1")


def line_sheets(spark: SparkSession, sf: str) -> str:
    """One exported sheet per year with all its lines below a preamble; the folder they are in."""
    rows = lines(spark, sf).select(
        "Year", "l_orderkey", "l_linenumber",
        F.concat_ws(",", "l_orderkey", "l_linenumber", "unit_age",
                    F.when(F.col("is_event"), F.lit('"R, returned"')).otherwise("NA")).alias("value"))
    years = rows.select("Year").distinct()
    header = ",".join(f'"{name}"' for name in LINE_SHEET.names)
    top = years.select("Year", F.posexplode(F.array(*map(F.lit, (*PREAMBLE, header)))).alias("at", "value"))
    both = top.unionByName(rows.withColumn("at", F.lit(len(PREAMBLE) + 1)), allowMissingColumns=True)
    path = stage_folder(spark, "line-sheets")
    both.repartition("Year").sortWithinPartitions("Year", "at", "l_orderkey", "l_linenumber").select(
        "Year", "value").write.partitionBy("Year").text(path)
    return path


# trend sheets ----------------------------------------------------------------

TWO_WORDS = {"PROMO": "PROMO parts"}
MODELED = "Modeled ageadjustedrate"
MODELED_AGE = "Modeled agespecificrate"
MODELED_DEATHS = "Modeled rate"
ENDPOINTS = (FIRST_YEAR, LAST_YEAR)
ANCHORS = AnchorRules(
    corrected_shift=((("LARGE",), 3.0), (("ECONOMY",), 1.0), (None, 0.3)),
    uncorrected_shift=((("ECONOMY", "LARGE"), -1.0), (None, -0.3)),
    anchor_shift=(
        (("LARGE", "ECONOMY"), 0.0),
        (("MEDIUM",), -0.3),
        (("SMALL", "PROMO parts"), 0.0),
    ),
    uncorrected_gap=((("ECONOMY", "LARGE"), 8.0), (None, 0.6)),
)


def _with_change_point(rates: DataFrame, modeled: str) -> DataFrame:
    """Flag the year of each cohort's highest rate as its change point."""
    highest = F.row_number().over(
        Window.partitionBy("Cohort").orderBy(F.col(f"`{modeled}`").desc(), "Year")
    )
    return rates.withColumn(
        CHANGE_POINT, F.when(highest == 1, F.col("Year").cast("double"))
    ).select("Cohort", "Year", CHANGE_POINT, modeled)


def per_100k(count: Column, base: Column) -> Column:
    return count.cast("double") * 1e5 / base.cast("double")


def trend_by_type(cells: DataFrame) -> DataFrame:
    """Two cohorts per part type: its events per own lines, and per all lines."""
    by_type = cells.groupBy("p_type", "Year").agg(
        F.sum("events").alias("events"), F.sum("lines").alias("lines")
    )
    everyone = F.sum("lines").over(Window.partitionBy("Year"))
    name = F.col("p_type")
    for word, full in TWO_WORDS.items():
        name = F.when(F.col("p_type") == word, full).otherwise(name)
    both = by_type.withColumn("everyone", everyone).select(
        "Year",
        F.inline(
            F.array(
                F.struct(
                    F.concat(name, F.lit(" / corrected rate")).alias("Cohort"),
                    per_100k(F.col("events"), F.col("lines")).alias(MODELED),
                ),
                F.struct(
                    F.concat(name, F.lit(" / not corrected rate")).alias("Cohort"),
                    per_100k(F.col("events"), F.col("everyone")).alias(MODELED),
                ),
            )
        ),
    )
    return _with_change_point(both, MODELED)


def trend_by_age(cells: DataFrame, separator: str, modeled: str) -> DataFrame:
    """One cohort per wide band, its en dash broken as in a badly decoded file."""
    by_age = (
        cells.withColumn("Age", band_of("unit_age", WIDE_UNITS))
        .groupBy("Age", "Year")
        .agg(F.sum("events").alias("events"), F.sum("lines").alias("lines"))
    )
    broken = F.replace(F.col("Age"), F.lit(EN_DASH), F.lit(BROKEN_EN_DASH))
    rates = by_age.select(
        F.concat(broken, F.lit(f"{separator} Total")).alias("Cohort"),
        "Year",
        per_100k(F.col("events"), F.col("lines")).alias(modeled),
    )
    return _with_change_point(rates, modeled)


def thousandths_text(n: Column) -> Column:
    """An integer count of thousandths as decimal text, built from integers."""
    size = F.abs(n)
    whole = F.floor(size / 1000).cast("long").cast("string")
    digits = F.lpad((size % 1000).cast("string"), 3, "0")
    return F.concat(F.when(n < 0, "-").otherwise(""), whole, F.lit("."), digits)


def part_aapc(spark: SparkSession, sf: str) -> DataFrame:
    """One AAPC text per part: thousandths from its key, a star for large parts,
    and no number at all for the largest size."""
    text = F.concat(
        thousandths_text(F.col("p_partkey") % 7000 - 3500),
        F.when(F.col("p_size") > 25, "*").otherwise(""),
    )
    aapc = F.when(F.col("p_size") == 50, "n/a").otherwise(text)
    return table(spark, sf, "part").select("p_partkey", aapc.alias("AAPC"))


def type_aapc(spark: SparkSession, sf: str) -> DataFrame:
    """(Cohort, AAPC text) for the cohorts of :func:`trend_by_type`."""
    sums = table(spark, sf, "part").groupBy("p_type").agg(
        F.sum("p_size").alias("size"), F.count(F.lit(1)).alias("parts")
    )
    name = F.col("p_type")
    for word, full in TWO_WORDS.items():
        name = F.when(F.col("p_type") == word, full).otherwise(name)
    star = F.when(F.col("parts") % 2 == 0, "*").otherwise("")
    return sums.select(
        F.inline(
            F.array(
                F.struct(
                    F.concat(name, F.lit(" / corrected rate")).alias("Cohort"),
                    F.concat(thousandths_text(F.col("size") % 7000 - 3500), star).alias("AAPC"),
                ),
                F.struct(
                    F.concat(name, F.lit(" / not corrected rate")).alias("Cohort"),
                    F.concat(
                        thousandths_text(F.col("size") * 7 % 7000 - 3500), star
                    ).alias("AAPC"),
                ),
            )
        )
    )


def age_aapc(cells: DataFrame, separator: str) -> DataFrame:
    """(Cohort, AAPC text) for the cohorts of :func:`trend_by_age`, thousandths
    from the lines of a band and a star for an even number of events."""
    by_age = (
        cells.withColumn("Age", band_of("unit_age", WIDE_UNITS))
        .groupBy("Age")
        .agg(F.sum("events").alias("events"), F.sum("lines").alias("lines"))
    )
    broken = F.replace(F.col("Age"), F.lit(EN_DASH), F.lit(BROKEN_EN_DASH))
    star = F.when(F.col("events") % 2 == 0, "*").otherwise("")
    return by_age.select(
        F.concat(broken, F.lit(f"{separator} Total")).alias("Cohort"),
        F.concat(thousandths_text(F.col("lines") % 7000 - 3500), star).alias("AAPC"),
    )
