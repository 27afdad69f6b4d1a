"""What distinguishes one analysis from another: maps, periods, years, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from stratarates.functions.text import EN_DASH
from stratarates.operators.bands import Members, unit_members
from stratarates.operators.classify import BLANK, TOTAL
from stratarates.operators.rates import INCIDENCE_VARIANTS, MORTALITY_VARIANTS, Variants
from stratarates.operators.trends import AnchorRules


@dataclass(frozen=True)
class RateSettings:
    """Parameters of a rate analysis."""

    units: Members  # narrow band -> single units
    bands: Members  # wide band -> narrow bands
    excluded_bands: Sequence[str]  # left out of all rates
    periods: Mapping[str, tuple[int, int]]  # fraction column -> years it applies to
    fraction_recode: Mapping[str, str]
    years: tuple[int, int]
    ref_year: int
    variants: Variants
    standardised_label: str = f"Age{EN_DASH}standardised"
    extract_years: Sequence[int] = ()
    # strata, where there are any
    strata: Mapping[str, Sequence[str]] | None = None
    targets: Sequence[str] = ()
    unspecified: str | None = None  # cancer_type whose counts are reallocated
    pooled: Sequence[str] = ()
    late_after: int | None = None
    early_bands: Sequence[str] = ()
    early_label: str = "<55"
    late_label: str = "55+"
    total: str = TOTAL
    blank: str = BLANK


def pair_bands(
    units: Members, open_band: str | None = None, young: Sequence[str] = ()
) -> Members:
    """Pairs of neighbouring narrow bands, named by their outer limits; the
    youngest bands and the open one stay as they are."""
    narrow = [b for b in units if b != open_band and b not in young]
    bands = {b: (b,) for b in young}
    for first, second in zip(narrow[::2], narrow[1::2]):
        low, high = first.split(EN_DASH)[0], second.split(EN_DASH)[1]
        bands[f"{low}{EN_DASH}{high}"] = (first, second)
    if open_band is not None:
        bands[open_band] = (open_band,)
    return bands


# First ages of the narrow bands (0–14, 15–24, then five years
# wide up to 85+) over single ages 0 to 100, where 100 stands for "100 and over".
YOUNG_BANDS = ("0–14", "15–24")
AGE_UNITS = unit_members([0, 15, *range(25, 86, 5)], last_unit=100, open_end=True)
AGE_BANDS = pair_bands(AGE_UNITS, "85+", YOUNG_BANDS)

# Header clean-up of the population sheet, regex -> replacement.
POPULATION_HEADER = (
    (r"Estimated Resident Population ;  Female  *", "Age"),
    (r" ;", ""),
    (r"; *", ""),
)
POPULATION_FRAGMENT = "Female"
OPEN_AGE_HEADER = {"Age100 and over": "Age100+"}

# Columns of the exposure-fraction sheet and the years they cover.
FRACTION_PERIODS = {
    "Applied to the period 2001-2004": (2001, 2004),
    "Applied to the period 2005-2010": (2005, 2010),
    "Applied to the period 2011-2015": (2011, 2015),
    "Applied to the period 2016-2022": (2016, 2022),
}
FRACTION_RECODE = {"90+": "85+"}

# Histology codes of each stratum.
HISTOLOGY_STRATA = {
    "Endometrioid": (
        "U1.01.02.01.01", "U1.01.02.01.02", "U1.01.02.01.03", "U1.01.02.01.04",
        "U1.01.02.02.02",
        "U1.01.02.05.01", "U1.01.02.05.02", "U1.01.02.05.03", "U1.01.02.05.04",
        "U1.01.02.05.05",
        "U1.01.02.06.02", "U1.01.02.06.03", "U1.01.02.06.04",
        "U1.01.03",
    ),
    "Serous": ("U1.01.02.02.01", "U1.01.02.02.03", "U1.01.02.04", "U1.01.06.10"),
    "Clear cell": ("U1.01.02.03",),
    "Carcinosarcoma": ("U1.01.04.01", "U1.01.04.02", "U1.01.04.03", "U1.01.04.04"),
    "Sarcoma": (
        "U1.02.01.01",
        "U1.02.02.01", "U1.02.02.02",
        "U1.02.03.01",
        "U1.02.04.01", "U1.02.04.02", "U1.02.04.03", "U1.02.04.04",
        "U1.02.05.01", "U1.02.05.02", "U1.02.05.03", "U1.02.05.04", "U1.02.05.05",
        "U1.02.06.01", "U1.02.06.02", "U1.02.06.03",
        "U1.02.07",
        "U1.02.08.01", "U1.02.08.02", "U1.02.08.03",
        "U1.02.08.05.01", "U1.02.08.05.02", "U1.02.08.05.03", "U1.02.08.05.04",
        "U1.02.09.01",
        "U1.02.10.01",
        "U1.03",
    ),
    "Other": (
        "U1.01.01.01", "U1.01.01.02", "U1.01.01.03", "U1.01.01.04", "U1.01.01.05",
        "U1.01.01.06",
        "U1.01.02.06.05", "U1.01.02.06.06", "U1.01.02.06.07",
        "U1.01.05.01", "U1.01.05.02.01", "U1.01.05.02.02", "U1.01.05.02.03",
        "U1.01.05.03",
        "U1.01.06.01", "U1.01.06.02", "U1.01.06.03", "U1.01.06.04", "U1.01.06.05",
        "U1.01.06.06", "U1.01.06.07", "U1.01.06.08", "U1.01.06.09", "U1.01.06.11",
        "U1.02.01.02",
        "U1.02.08.04", "U1.02.08.05.05",
        "U1.04.01", "U1.04.02", "U1.04.03",
        "U1.05",
        "U1.06",
    ),
}

# Rows kept of the published count sheets.
INCIDENCE_ROWS = {"sex": "Females", "age_grouping": "10-year age groups"}
INCIDENCE_SUMMARY_AGES = (
    "All ages (crude rate)",
    "All ages (age-standardised rate - 2024 Australian population)",
    "All ages (age-standardised rate - 2001 Australian Standard Population)",
)
MORTALITY_ROWS = {"cancer_group_site": "Uterine cancer", "sex": "Females", "data_type": "Actual"}
MORTALITY_EXCLUDED_AGES = ("00-04", "05-09", "10-14", "15-19", "20-24", "All ages combined")

INCIDENCE = RateSettings(
    units=AGE_UNITS,
    bands=AGE_BANDS,
    excluded_bands=YOUNG_BANDS,
    periods=FRACTION_PERIODS,
    fraction_recode=FRACTION_RECODE,
    years=(2001, 2020),
    ref_year=2001,
    variants=INCIDENCE_VARIANTS,
    extract_years=(2001, 2010, 2020),
    strata=HISTOLOGY_STRATA,
    targets=("Endometrioid", "Serous", "Clear cell"),
    unspecified="Adenocarcinoma, NOS",
    pooled=("Serous", "Carcinosarcoma"),
    late_after=2005,
    early_bands=("25–34", "35–44", "45–54"),
)

MORTALITY = RateSettings(
    units=AGE_UNITS,
    bands=AGE_BANDS,
    excluded_bands=YOUNG_BANDS,
    periods=FRACTION_PERIODS,
    fraction_recode=FRACTION_RECODE,
    years=(2001, 2022),
    ref_year=2001,
    variants=MORTALITY_VARIANTS,
    extract_years=(2001, 2010, 2020),
)

# Mortality counts are published in five-year bands with 85–89 and 90+.
MORTALITY_COUNT_BANDS = {
    **{b: m for b, m in AGE_BANDS.items() if b not in (*YOUNG_BANDS, "85+")},
    "85+": ("85–89", "90+"),
}

# Names of modeled and observed series, and label places.
OBSERVED_NAMES = {
    "corrected for hyst": "Observed hysterectomy-corrected rate",
    "not corrected for hyst": "Observed hysterectomy-uncorrected rate",
}
LARGE_PANELS = ("Total", "Endometrioid")
SMALL_PANELS = ("Serous", "Clear cell", "Sarcoma", "Carcinosarcoma", "Other")
AGE_PANELS = (
    "Age–standardised", "25–34", "35–44", "45–54", "55–64", "65–74", "75–84", "85+",
)
SUBTYPE_ANCHORS = AnchorRules(
    corrected_shift=((("Endometrioid",), 3.0), (("Total",), 1.0), (None, 0.3)),
    uncorrected_shift=((LARGE_PANELS, -1.0), (None, -0.3)),
    anchor_shift=(
        (LARGE_PANELS, 0.0),
        (("Serous",), -0.3),
        (("Clear cell", "Sarcoma", "Carcinosarcoma", "Other"), 0.0),
    ),
    uncorrected_gap=((LARGE_PANELS, 8.0), (None, 0.6)),
)
