"""Population sheets and unit populations to exposed bands."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.functions.dates import serial_to_year
from stratarates.operators.bands import period_fractions, rollup_long, rollup_wide
from stratarates.operators.rates import exposed_population
from stratarates.plans.settings import (
    OPEN_AGE_HEADER,
    POPULATION_FRAGMENT,
    POPULATION_HEADER,
    RateSettings,
)
from stratarates.sources.headers import rename_by_patterns, select_containing
from stratarates.sources.sheets import cast_all_strings, drop_metadata_rows


def population_wide(
    sheet: DataFrame,
    fragment: str = POPULATION_FRAGMENT,
    patterns: Sequence[tuple[str, str]] = POPULATION_HEADER,
    open_header: Mapping[str, str] = OPEN_AGE_HEADER,
) -> DataFrame:
    """Clean a wide population sheet: (Year, Age0, Age1, …).

    The first column holds date serials below the metadata rows; every other
    column is one sex and single age, all of it text.
    """
    first = sheet.columns[0]
    named = sheet.withColumnRenamed(first, "Year")
    rows = drop_metadata_rows(select_containing(named, [fragment], ["Year"]), "Year")
    numbers = cast_all_strings(rows).withColumn("Year", serial_to_year("Year"))
    return rename_by_patterns(numbers, patterns).withColumnsRenamed(dict(open_header))


def band_columns(df: DataFrame, units: Mapping[str, Sequence[int]]) -> dict[str, list[str]]:
    """Column names ``Age<unit>`` (``Age<unit>+`` for the open one) of each band."""
    by_unit = {
        int(m.group(1)): c for c in df.columns if (m := re.fullmatch(r"Age(\d+)\+?", c))
    }
    return {band: [by_unit[u] for u in members] for band, members in units.items()}


def population_bands(sheet: DataFrame, settings: RateSettings) -> DataFrame:
    """(Year, Age, pop) in narrow bands from a wide sheet: row-wise sums and an
    unpivot, no shuffle."""
    wide = population_wide(sheet)
    wide = wide.where(F.col("Year").between(*settings.years))
    return rollup_wide(wide, ["Year"], band_columns(wide, settings.units), "pop")


def population_bands_long(units: DataFrame, settings: RateSettings) -> DataFrame:
    """The same from long rows (Year, unit_age, pop)."""
    rows = units.where(F.col("Year").between(*settings.years))
    return rollup_long(rows, ["Year"], "unit_age", settings.units, ["pop"])


def exposed_bands(
    narrow: DataFrame, fractions: DataFrame, settings: RateSettings
) -> DataFrame:
    """(Year, Age, pop, withouthyst) in wide bands from narrow-band populations
    and the fraction sheet."""
    yearly = period_fractions(
        fractions, settings.periods, settings.years, settings.fraction_recode
    )
    exposed = exposed_population(narrow, yearly)
    return rollup_long(exposed, ["Year"], "Age", settings.bands, ["pop", "withouthyst"])
