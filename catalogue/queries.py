"""One query per operator over the star-schema tables.

Each takes (spark, sf_dir) and reads whole tables.  Doubles are rounded to six
decimals at the very end, because engines add in different orders.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import star
from catalogue.star import NARROW, NO_STRATA, SETTINGS, WIDE, WIDE_UNITS, table
from stratarates.functions.dates import date_to_serial, in_years, serial_to_year
from stratarates.functions.nulls import not_in
from stratarates.functions.text import (
    BROKEN_EN_DASH,
    before,
    hyphen_to_en_dash,
    mend_en_dash,
    round_half_even,
)
from stratarates.operators import trends
from stratarates.operators.bands import (
    band_of,
    cross_years,
    period_fractions,
    rollup_long,
)
from stratarates.operators.cells import cell_values, store_batch, stored_cells
from stratarates.operators.classify import classify, label_rank, recode
from stratarates.operators.counts import cell_counts, counts, with_totals
from stratarates.operators.extracts import append_standardised_long
from stratarates.operators.fill import fill_forward
from stratarates.operators.rates import (
    age_specific_rates,
    exposed_population,
    rate_rows,
    reference_totals,
    standard,
    standardised_rates,
)
from stratarates.operators.reallocate import (
    reallocate,
    reallocate_many,
    shares_of_all,
    stratum_shares,
)
from stratarates.operators.reshape import (
    lengthen,
    lengthen_by_pattern,
    widen,
)
from stratarates.plans.incidence import IncidenceRates
from stratarates.plans.mortality import MortalityRates, reband_counts
from stratarates.plans.overlays import (
    StratumOverlay,
    age_rate_series,
    observed_by_age,
    share_series,
)
from stratarates.plans.populations import exposed_bands, population_bands, population_wide
from stratarates.sources.headers import (
    clean_names,
    drop_containing,
    select_containing,
)
from stratarates.sources.sheets import cast_all_strings, drop_metadata_rows, read_sheet
from stratarates.sources.layout import read_by_date, write_by_date
from stratarates.sources.sinks import csv_line, with_row_index
from stratarates.sources.staging import stage, stage_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), 6).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(run: Query) -> Query:
    """Register under the function's name; a trailing underscore only keeps the
    function apart from the operator it calls."""

    def rounded_run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(run(spark, sf))

    QUERIES[run.__name__.rstrip("_")] = rounded_run
    return rounded_run


def _fact(spark, sf) -> DataFrame:
    """One branch over the lines: for queries that use the fact once."""
    return star.fact(star.type_cells(spark, sf))


def _classified(spark, sf) -> DataFrame:
    return classify(_fact(spark, sf), "i_d", SETTINGS.strata)


def _incidence(spark, sf) -> IncidenceRates:
    cells = star.staged_type_cells(spark, sf)
    return IncidenceRates(
        star.fact(cells), star.exposed(cells), SETTINGS, inputs_staged=True
    )


def _mortality(spark, sf) -> MortalityRates:
    cells = star.staged_unit_cells(spark, sf)
    narrow = cells.groupBy("Year", band_of("unit_age", NARROW).alias("Age")).agg(
        F.sum("events").alias("Count")
    )
    wide = {b: m for b, m in WIDE.items() if b not in SETTINGS.excluded_bands}
    return MortalityRates(
        reband_counts(narrow, wide), star.exposed(cells), NO_STRATA, inputs_staged=True
    )


# scan and shape ----------------------------------------------------------------


@query
def scan_filtered(spark, sf):
    kept = F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM") & F.col("is_event")
    rows = star.typed_lines(spark, sf).where(kept & in_years("l_shipdate", 1996, 2001))
    return rows.where(F.col("l_linestatus") == "F").select(
        "l_orderkey", "l_linenumber", "p_type", "Year", "unit_age"
    )


def _sheet(spark, sf) -> DataFrame:
    return star.population_sheet(star.unit_cells(spark, sf))


@query
def sheet_with_preamble(spark, sf):
    """All lines, exported below preambles and read back."""
    path = star.line_sheets(spark, sf)
    rows = read_sheet(spark, path, star.LINE_SHEET, skip=len(star.PREAMBLE))
    return rows.groupBy("age", "flag").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("order").alias("orders"), F.sum("line").alias("numbers"))


@query
def drop_meta_rows(spark, sf):
    return drop_metadata_rows(_sheet(spark, sf), "...1").withColumnRenamed("...1", "Serial")


@query
def select_contains(spark, sf):
    body = drop_metadata_rows(_sheet(spark, sf), "...1")
    kept = select_containing(body, ["female"], ["...1"])
    return drop_containing(kept, [";  4", ";  5"]).withColumnRenamed("...1", "Serial")


@query
def regex_rename(spark, sf):
    return population_wide(_sheet(spark, sf))


@query
def clean_names_(spark, sf):
    by_type = star.type_cells(spark, sf).groupBy("p_type", "Year", "unit_age").agg(
        F.sum("events").alias("events")
    )
    messy = by_type.toDF("I.D", "Year", "Age group (years)", "Count for cancer type")
    return clean_names(messy).withColumnsRenamed(
        {"count_for_cancer_type": "Count", "age_group_years": "Age", "year": "Year"}
    )


@query
def cast_all_strings_(spark, sf):
    text = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("customer"),
        F.concat("o_orderstatus", F.lit("-"), F.col("o_custkey").cast("string")).alias("status"),
        F.concat(
            F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(""),
            (F.col("o_orderkey") % 1000).cast("string"),
            F.element_at(F.array(*map(F.lit, ("", "d", "f", "e3", " ", "D", ".5", "%"))),
                         (F.col("o_custkey") % 8 + 1).cast("int")),
        ).alias("mixed"),
        F.year("o_orderdate").alias("Year"),
    )
    return cast_all_strings(text)


@query
def serial_to_year_(spark, sf):
    serials = table(spark, sf, "orders").select(
        "o_orderkey", date_to_serial("o_orderdate").alias("serial")
    )
    return serials.withColumn("Year", serial_to_year("serial"))


@query
def year_range(spark, sf):
    rows = star.lines(spark, sf).where(in_years("l_shipdate", 1996, 2000))
    return rows.groupBy("Year").agg(F.count(F.lit(1)).alias("lines"), star.events())


@query
def year_range_laid_out(spark, sf):
    """The same from a table laid out by date, of which other years and months are not read."""
    path = stage_folder(spark, "lines-by-date")
    write_by_date(table(spark, sf, "lineitem"), path, "l_shipdate", ["l_orderkey", "l_linenumber"])
    rows = read_by_date(spark, path, datetime.date(1998, 11, 15), datetime.date(1999, 2, 15))
    return rows.groupBy(F.year("l_shipdate").alias("Year"), F.month("l_shipdate").alias("Month")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_orderkey").alias("orders"))


@query
def exclude_bands(spark, sf):
    """Lines of the last five ages have no band here; they must survive."""
    banded = {b: units for b, units in WIDE_UNITS.items() if b != "41–50"}
    rows = star.lines(spark, sf).withColumn("Age", band_of("unit_age", banded))
    kept = rows.where(not_in("Age", SETTINGS.excluded_bands))
    return kept.groupBy("Age").agg(F.count(F.lit(1)).alias("lines"))


# recode --------------------------------------------------------------------------


@query
def classify_codes(spark, sf):
    return _classified(spark, sf).groupBy("Subtype").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("Count").alias("Count")
    )


@query
def recode_label(spark, sf):
    """Open narrow label recoded, others kept; then a 1:1 map without default."""
    unit_cells = star.unit_cells(spark, sf)
    narrow = unit_cells.withColumn(
        "code", F.concat(F.lit("age"), F.floor((F.col("unit_age") - 1) / 10).cast("string"))
    ).groupBy("code").agg(F.sum("lines").alias("lines"))
    unmapped = "41–50"  # a label without an entry becomes NULL
    labels = {f"age{at}": band for at, band in enumerate(WIDE) if band != unmapped}
    mapped = recode("code", labels, keep_others=False)
    return narrow.select(
        recode("code", {"age4": "age4+"}).alias("code"), mapped.alias("Age"), "lines"
    )


@query
def label_clean(spark, sf):
    """A hyphenated and a badly decoded label, both back to the en dash."""
    cells = star.unit_cells(spark, sf).withColumn("Age", band_of("unit_age", WIDE_UNITS))
    dirty = cells.groupBy("Age").agg(F.sum("lines").alias("lines")).select(
        F.replace("Age", F.lit("–"), F.lit("-")).alias("hyphen"),
        F.replace("Age", F.lit("–"), F.lit(BROKEN_EN_DASH)).alias("broken"),
        "lines",
    )
    return dirty.select(
        hyphen_to_en_dash("hyphen").alias("from_hyphen"),
        mend_en_dash("broken").alias("from_broken"),
        "lines",
    )


@query
def custom_order(spark, sf):
    levels = ["Total", "C", "B", "A", "D", "Other"]
    out = counts(_classified(spark, sf), ["Subtype"])
    return out.select(label_rank("Subtype", levels).alias("rank"), "Subtype", "Count").orderBy(
        "rank"
    )


# joins -----------------------------------------------------------------------------


@query
def join_two_key(spark, sf):
    cells = star.staged_unit_cells(spark, sf)
    wide_pop = rollup_long(star.population(cells), ["Year"], "unit_age", WIDE_UNITS, ["pop"])
    return star.event_cells(cells).join(wide_pop, ["Year", "Age"])


@query
def left_join_pop(spark, sf):
    """The oldest band has no population: its counts stay, with NULL."""
    cells = star.staged_unit_cells(spark, sf)
    known = {b: units for b, units in WIDE_UNITS.items() if b != "41–50"}
    wide_pop = rollup_long(star.population(cells), ["Year"], "unit_age", known, ["pop"])
    return star.event_cells(cells).join(wide_pop, ["Year", "Age"], "left")


@query
def cross_years_(spark, sf):
    bands = star.unit_cells(spark, sf).withColumn("Age", band_of("unit_age", WIDE_UNITS))
    overall = bands.groupBy("Age").agg(F.sum("lines").alias("lines"))
    return cross_years(overall, *SETTINGS.years)


def _yearly_fractions(spark, recoded: bool = True) -> DataFrame:
    recodes = SETTINGS.fraction_recode if recoded else {}
    return period_fractions(star.fractions(spark), SETTINGS.periods, SETTINGS.years, recodes)


@query
def period_fraction(spark, sf):
    pop = star.narrow_population(star.unit_cells(spark, sf))
    return pop.join(_yearly_fractions(spark), ["Year", "Age"])


@query
def orphan_keys(spark, sf):
    """Population bands that have no fraction as long as the open band is not
    recoded."""
    pop = star.narrow_population(star.unit_cells(spark, sf))
    return pop.join(_yearly_fractions(spark, recoded=False), ["Year", "Age"], "left_anti")


@query
def ref_year_standard(spark, sf):
    return standard(star.exposed(star.unit_cells(spark, sf)), SETTINGS.ref_year)


# reshape -----------------------------------------------------------------------------


@query
def pivot_single(spark, sf):
    cells = star.unit_cells(spark, sf).withColumn("Age", band_of("unit_age", WIDE_UNITS))
    long = cells.groupBy("Year", "Age").agg(F.sum("events").alias("Count"))
    return widen(long, ["Year"], "Age", list(WIDE), "Count", prefix="Age")


@query
def pivot_two_measures(spark, sf):
    exposed = star.exposed(star.unit_cells(spark, sf))
    return widen(exposed, ["Year"], "Age", list(WIDE), ["pop", "withouthyst"])


@query
def unpivot_single(spark, sf):
    wide = population_wide(_sheet(spark, sf))
    ages = [c for c in wide.columns if c != "Year"]
    return lengthen(wide, ["Year"], ages, "Age", "pop")


@query
def unpivot_multi(spark, sf):
    exposed = star.exposed(star.unit_cells(spark, sf))
    wide = widen(exposed, ["Year"], "Age", list(WIDE), ["pop", "withouthyst"])
    columns = [c for c in wide.columns if c != "Year"]
    return lengthen_by_pattern(wide, ["Year"], columns, "(.*)_(.*)", "Age")


@query
def variants_long(spark, sf):
    rates = _mortality(spark, sf).rates
    return rate_rows(rates, ["Year", "Age"], NO_STRATA.variants)


@query
def band_rollup(spark, sf):
    return star.narrow_population(star.unit_cells(spark, sf))


@query
def reband_counts_(spark, sf):
    """Narrow-band counts with hyphenated labels to wide bands."""
    narrow = star.unit_cells(spark, sf).withColumn("Age", band_of("unit_age", star.NARROW))
    sheet = narrow.groupBy("Year", "Age").agg(F.sum("events").alias("Count")).withColumn(
        "Age", F.replace("Age", F.lit("–"), F.lit("-"))
    )
    bands = {b: m for b, m in WIDE.items() if b not in SETTINGS.excluded_bands}
    return reband_counts(sheet.withColumn("Age", hyphen_to_en_dash("Age")), bands)


@query
def reband_exposure(spark, sf):
    return star.exposed(star.unit_cells(spark, sf))


@query
def population_bands_(spark, sf):
    """From the wide text sheet."""
    return population_bands(_sheet(spark, sf), SETTINGS)


# reallocation --------------------------------------------------------------------------


@query
def share_of_year(spark, sf):
    return stratum_shares(_classified(spark, sf), SETTINGS.targets)


@query
def reallocate_lr(spark, sf):
    fact = star.fact(star.staged_type_cells(spark, sf))
    classified = classify(fact, "i_d", SETTINGS.strata)
    shares = stratum_shares(classified, SETTINGS.targets)
    unspecified = classified.where(F.col("cancer_type") == SETTINGS.unspecified)
    return reallocate(unspecified, shares, keep_parts=True)


@query
def append_reallocated(spark, sf):
    return _incidence(spark, sf).counts


@query
def fill_forward_(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("Year"),
        "o_orderstatus",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"),
    )
    return fill_forward(orders, ["Year", "o_orderstatus"], "o_orderkey", "price")


@query
def unspecified_share(spark, sf):
    return _incidence(spark, sf).unspecified_share()


# rates -------------------------------------------------------------------------------


@query
def exposed_population_(spark, sf):
    pop = star.narrow_population(star.unit_cells(spark, sf))
    return exposed_population(pop, _yearly_fractions(spark))


@query
def ref_totals(spark, sf):
    return _incidence(spark, sf).totals


@query
def age_specific_rates_(spark, sf):
    return _incidence(spark, sf).rates


@query
def asr_no_stratum(spark, sf):
    return _mortality(spark, sf).standardised


@query
def asr_by_stratum(spark, sf):
    """Rates of the classified codes as they are, nothing reallocated."""
    cells = star.staged_type_cells(spark, sf)
    fact = classify(star.fact(cells), "i_d", SETTINGS.strata)
    kept = fact.where(F.col("Subtype") != SETTINGS.blank)
    exposed = star.exposed(cells)
    cells = cell_counts(kept, ["Subtype", "Year", "Age"], SETTINGS.excluded_bands)
    std = standard(exposed, SETTINGS.ref_year)
    rates = stage(age_specific_rates(cells, exposed, std), "rates")
    totals = reference_totals(rates, SETTINGS.ref_year, SETTINGS.total)
    return standardised_rates(rates, totals, ["Subtype", "Year"], SETTINGS.variants)


@query
def pooled_asr(spark, sf):
    return _incidence(spark, sf).pooled_standardised()


@query
def two_group_asr(spark, sf):
    return _incidence(spark, sf).grouped_standardised()


@query
def sensitivity_after(spark, sf):
    return _incidence(spark, sf).later_series()


@query
def append_standardised(spark, sf):
    return _incidence(spark, sf).age_series()


@query
def append_standardised_variants(spark, sf):
    m = _mortality(spark, sf)
    return append_standardised_long(
        m.rates, m.standardised, NO_STRATA.standardised_label, NO_STRATA.variants
    )


@query
def extract_years(spark, sf):
    return _incidence(spark, sf).fraction_inputs()


@query
def extract_years_asr(spark, sf):
    return _incidence(spark, sf).attributable_inputs()


@query
def rate_slice(spark, sf):
    return _mortality(spark, sf).rate_slice(SETTINGS.ref_year)


@query
def incidence_rates(spark, sf):
    return _incidence(spark, sf).standardised


@query
def incidence_from_sheet(spark, sf):
    """The same analysis with its population read off the wide sheet."""
    cells = star.staged_type_cells(spark, sf)
    pop = population_bands(star.population_sheet(cells), SETTINGS)
    exposed = stage(exposed_bands(pop, star.fractions(spark), SETTINGS), "exposed")
    rates = IncidenceRates(star.fact(cells), exposed, SETTINGS, inputs_staged=True)
    return rates.standardised.select("Subtype", "Year", "corrected", "ageadjustedrate")


@query
def mortality_rates(spark, sf):
    return _mortality(spark, sf).age_series()


# descriptives ---------------------------------------------------------------------------


@query
def counts_by_keys(spark, sf):
    return _incidence(spark, sf).cases_by_type()


@query
def counts_total(spark, sf):
    return counts(star.event_cells(star.unit_cells(spark, sf)))


@query
def counts_after_year(spark, sf):
    return _incidence(spark, sf).cases_by_stratum(F.col("Year") > SETTINGS.late_after)


@query
def counts_by_band(spark, sf):
    return _incidence(spark, sf).cases_by_band()


@query
def counts_single_year(spark, sf):
    return _incidence(spark, sf).cases_by_stratum(F.col("Year") == 2001)


@query
def young_cases(spark, sf):
    return _incidence(spark, sf).young_cases("11–20")


def _weighted(spark, sf) -> DataFrame:
    """Events with a fractional weight, with total rows, classified."""
    events = star.typed_lines(spark, sf).where("is_event").select(
        "p_type", "Year", band_of("unit_age", WIDE_UNITS).alias("Age"),
        (F.col("l_linenumber") * 0.25).alias("weight"),
    )
    return classify(with_totals(events, "p_type", ["Year", "Age"], "weight"), "p_type", SETTINGS.strata)


@query
def counts_weighted(spark, sf):
    rows = _weighted(spark, sf).where(F.col("Subtype") != SETTINGS.blank)
    return cell_counts(rows, ["Subtype", "Year", "Age"])


@query
def reallocate_weighted(spark, sf):
    classified = stage(_weighted(spark, sf), "weighted")
    shares = stratum_shares(classified, SETTINGS.targets)
    unspecified = classified.where(F.col("p_type") == SETTINGS.unspecified)
    return reallocate(unspecified, shares, keep_parts=True)


@query
def reallocate_parts(spark, sf):
    """Lines of unspecified type at single ages, dealt out to all parts of the year."""
    unspecified = star.type_cells(spark, sf).where((F.col("p_type") == SETTINGS.unspecified) & (F.col("unit_age") <= 10))
    by_part = stage(star.lines(spark, sf).groupBy("Year", "l_partkey").agg(F.count(F.lit(1)).alias("Count")), "by-part")
    shares = shares_of_all(by_part, stratum="l_partkey")
    named = unspecified.withColumnRenamed("lines", "Count")
    return reallocate_many(named, shares, ["Year", "unit_age"], stratum="l_partkey")


@query
def rollup_sparse(spark, sf):
    """Suppliers have no lines at many ages: a band that lacks one is NULL."""
    cells = table(spark, sf, "lineitem").groupBy(
        "l_suppkey", F.year("l_shipdate").alias("Year"), F.col("l_quantity").cast("int").alias("unit_age")
    ).agg(F.count(F.lit(1)).alias("pop"))
    return rollup_long(cells, ["l_suppkey", "Year"], "unit_age", NARROW, ["pop"])


@query
def rollup_lost_doubled(spark, sf):
    """Some ages of a year are lost and others come twice, often in one band."""
    place = (F.col("unit_age") + F.col("Year")) % 11
    cells = star.unit_cells(spark, sf).where(place != 0)
    copies = F.explode(F.sequence(F.lit(1), F.when(place == 1, 2).otherwise(1)))
    return rollup_long(cells.withColumn("copy", copies), ["Year"], "unit_age", NARROW, ["lines", "events"])


@query
def counts_stratum_year(spark, sf):
    return _incidence(spark, sf).cases_by_stratum_year()


@query
def cells_merged(spark, sf):
    """Yearly lines stored in two batches and merged; small discounts are unknown."""
    keys, measures = ["l_returnflag", "Year", "unit_age"], ["discounted", "orders"]
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", F.year("l_shipdate").alias("Year"), F.col("l_quantity").cast("int").alias("unit_age"),
        F.when(F.col("l_extendedprice") > 2000, F.col("l_linenumber")).alias("discounted"),
        F.col("l_orderkey").alias("orders"))
    path = stage_folder(spark, "cells")
    store_batch(rows.where("orders % 2 = 0"), path, "even", keys, measures)
    store_batch(rows.where("orders % 2 <> 0"), path, "odd", keys, measures)
    states = stored_cells(spark, path, keys, measures)
    strict, lenient = cell_values(states, keys, measures), cell_values(states, keys, ["discounted"], strict=False)
    return strict.join(lenient.withColumnRenamed("discounted", "known"), keys)


def _young(spark, sf, keys) -> DataFrame:
    """Events at single ages of the youngest band, zero cells dropped."""
    cells = star.type_cells(spark, sf).where(F.col("unit_age") <= 10)
    return counts(cells, keys, measure="events", drop_zero=True)


@query
def nonzero_cells(spark, sf):
    return _young(spark, sf, ["Year", "unit_age", "p_type"])


@query
def preview_top30(spark, sf):
    keys = ["Year", "unit_age", "p_type"]
    return _young(spark, sf, keys).orderBy(*keys).limit(30)


# trend text --------------------------------------------------------------------------------


def _trend(spark, sf) -> DataFrame:
    return star.trend_by_type(star.type_cells(spark, sf))


def _overlay(spark, sf) -> StratumOverlay:
    cells = star.staged_type_cells(spark, sf)
    return StratumOverlay(
        star.trend_by_type(cells), star.type_aapc(spark, sf), star.ENDPOINTS,
        star.ANCHORS, star.MODELED, star.TWO_WORDS,
    )


def _plain(df: DataFrame) -> DataFrame:
    """Headers of the trend tables without blanks."""
    return clean_names(df)


@query
def trend_points(spark, sf):
    return _plain(trends.trend_points(_trend(spark, sf), star.ENDPOINTS))


def _tidy(spark, sf) -> DataFrame:
    return trends.tidy_by_stratum(_trend(spark, sf), star.ENDPOINTS, star.TWO_WORDS)


@query
def trend_tidy(spark, sf):
    return _plain(_tidy(spark, sf))


def _tidy_age(spark, sf) -> DataFrame:
    trend = star.trend_by_age(star.unit_cells(spark, sf), " -", star.MODELED_AGE)
    return trends.tidy_by_age(trend, star.ENDPOINTS, " -")


def _tidy_deaths(spark, sf) -> DataFrame:
    trend = star.trend_by_age(star.unit_cells(spark, sf), " /", star.MODELED_DEATHS)
    return trends.tidy_by_age(trend, star.ENDPOINTS, " /", flag="Joinpoint ")


@query
def trend_tidy_age(spark, sf):
    return _plain(_tidy_age(spark, sf))


@query
def trend_tidy_mortality(spark, sf):
    return _plain(_tidy_deaths(spark, sf))


@query
def trend_markers(spark, sf):
    return _plain(_overlay(spark, sf).markers)


@query
def trend_markers_age(spark, sf):
    marked = trends.change_points(_tidy_age(spark, sf), "Joinpoint", "observed", "Joinpoint")
    return _plain(marked)


@query
def aapc_label(spark, sf):
    parts = star.part_aapc(spark, sf)
    return parts.select("p_partkey", trends.aapc_label("AAPC").alias("label"))


@query
def round_exact(spark, sf):
    """Two decimals of true ties (eighths), of ties only in print, and of sevenths."""
    parts = table(spark, sf, "part").select(
        "p_partkey",
        ((F.col("p_partkey") - 1000) / 8.0).alias("eighths"),
        ((F.col("p_partkey") * 10 + 5) / 1000.0).alias("fifths"),
        (F.col("p_retailprice") / 7.0).alias("price"),
    )
    numbers = [(round_half_even(c, 2) + 0.0).alias(c) for c in ("eighths", "fifths", "price")]
    return parts.select("p_partkey", *numbers)


@query
def aapc_label_padded(spark, sf):
    labelled = trends.with_padded_aapc_label(star.part_aapc(spark, sf))
    return labelled.select("p_partkey", "label")


@query
def aapc_label_short(spark, sf):
    parts = star.part_aapc(spark, sf)
    return parts.select("p_partkey", trends.aapc_label_short("AAPC").alias("label"))


@query
def trend_with_label(spark, sf):
    return _plain(trends.label_rows(_overlay(spark, sf).labelled, star.LAST_YEAR, shift=-0.5))


@query
def trend_with_label_age(spark, sf):
    """Padded labels by age, the label rows moved half a year left."""
    cells = star.staged_unit_cells(spark, sf)
    trend = star.trend_by_age(cells, " -", star.MODELED_AGE)
    tidy = trends.tidy_by_age(trend, star.ENDPOINTS, " -")
    labels = trends.with_padded_aapc_label(star.age_aapc(cells, " -")).select(
        mend_en_dash(before("Cohort", " -")).alias("Age"), "label"
    )
    labelled = trends.attach_labels(tidy, labels, ["Age"])
    return _plain(trends.label_rows(labelled, star.LAST_YEAR, shift=-0.5))


@query
def trend_with_label_mortality(spark, sf):
    cells = star.staged_unit_cells(spark, sf)
    trend = star.trend_by_age(cells, " /", star.MODELED_DEATHS)
    tidy = trends.tidy_by_age(trend, star.ENDPOINTS, " /", flag="Joinpoint ")
    labels = star.age_aapc(cells, " /").select(
        mend_en_dash(before("Cohort", " /")).alias("Age"),
        trends.aapc_label_short("AAPC").alias("label"),
    )
    return _plain(trends.attach_labels(tidy, labels, ["Age"]))


@query
def label_anchor(spark, sf):
    return _plain(_overlay(spark, sf).anchors)


@query
def chart_series(spark, sf):
    names = {
        SETTINGS.variants.corrected: "Observed corrected rate",
        SETTINGS.variants.uncorrected: "Observed uncorrected rate",
    }
    asr = _incidence(spark, sf).trend_series
    return trends.chart_series(asr, names, ["Total", "A", "B"])


@query
def chart_shares(spark, sf):
    return share_series(_incidence(spark, sf).shares, SETTINGS.targets)


@query
def chart_age_rates(spark, sf):
    return age_rate_series(_incidence(spark, sf).rates, SETTINGS.variants)


@query
def chart_mortality(spark, sf):
    panels = [NO_STRATA.standardised_label, *WIDE]
    return observed_by_age(_mortality(spark, sf).age_series(), NO_STRATA.variants.corrected, panels)


# export ------------------------------------------------------------------------------------


@query
def export_indexed(spark, sf):
    asr = _incidence(spark, sf).trend_series
    return with_row_index(asr, ["corrected", "Subtype", "Year"])


@query
def export_lines(spark, sf):
    """The text lines of an export of all parts, some without a type or a price."""
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 7 != 0, F.concat(F.col("p_type"), F.lit(' "'), F.col("p_brand"), F.lit('"'))).alias("type"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("price"),
        (F.col("p_size") > 25).alias("large"),
    )
    numbered = with_row_index(parts, [F.col("type").desc_nulls_last(), "p_partkey"])
    return numbered.select("row", csv_line(numbered, "row", parts.columns).alias("line"))
