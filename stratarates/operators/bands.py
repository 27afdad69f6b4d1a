"""Roll-up of units (single ages, narrow bands) into bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratarates.functions.text import EN_DASH
from stratarates.operators.reshape import lengthen_groups
from stratarates.sources.headers import quoted, sql_literal

Members = Mapping[str, Sequence]


def band_label(low: int, high: int | None, digits: int = 1) -> str:
    if high is None:
        return f"{low:0{digits}d}+"
    return f"{low:0{digits}d}{EN_DASH}{high:0{digits}d}"


def unit_members(edges: Sequence[int], last_unit: int, open_end: bool, digits: int = 1) -> Members:
    """Bands of whole units.  ``edges`` are the first units of the bands; the
    last band runs to ``last_unit`` and is labelled ``<first>+`` if open."""
    members = {}
    for at, low in enumerate(edges):
        last = at == len(edges) - 1
        high = last_unit if last else edges[at + 1] - 1
        label = band_label(low, None if last and open_end else high, digits)
        members[label] = tuple(range(low, high + 1))
    return members


def rollup_long(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    members: Members,
    measures: Sequence[str],
    names_to: str = "Age",
) -> DataFrame:
    """Sum unit rows into bands: one row per (keys, band), one shuffle on keys.

    Every band appears for every key value.  A band is the sum of exactly one
    value per member: with a lost, NULL or doubled member it is NULL, never a
    partial sum.  Beside each sum stand the band's number of rows and a bitmap of
    the members seen with a value (:func:`member_bits`), so a lost member and
    a doubled one cannot make up for each other.  All of it is combined map-side:
    the shuffle carries one row per key value and task whatever the number of
    input rows.
    """
    rows = df.withColumn("_band", band_of(unit, {str(n): u for n, u in enumerate(members.values())}).cast("int"))
    rows = rows.withColumn("_place", place_in_band(unit, members))
    aggregates, checks, groups = [], {}, {}
    for at, (label, units) in enumerate(members.items()):
        aggregates.append(F.count(F.when(F.col("_band") == at, 1)).alias(f"_{at}_rows"))
        groups[label] = {}
        for measure in measures:
            value = F.when(F.col("_band") == at, F.col(quoted(measure)))
            name = f"_{at}_{measure}"
            seen = member_bits(value, F.col("_place"), len(units))
            words = [f"{name}_{w}" for w in range(len(seen))]
            aggregates += [F.sum(value).alias(name), *(bits.alias(word) for bits, word in zip(seen, words))]
            full = F.col(f"_{at}_rows") == len(units)
            for word, bits in zip(words, full_bits(len(units))):
                full &= F.col(quoted(word)) == bits
            checks[name] = F.when(full, F.col(quoted(name))).alias(name)
            groups[label][measure] = name
    wide = rows.groupBy(*keys).agg(*aggregates).select(*[F.col(quoted(k)) for k in keys], *checks.values())
    return lengthen_groups(wide, keys, groups, names_to)


#: members per bitmap word; a LONG's sign bit stays unused
WORD_BITS = 63


def member_bits(value: Column, place: Column, n_members: int) -> list[Column]:
    """Aggregates that tell which of ``n_members`` members (by ``place``, from 0) had a
    non-NULL ``value``: one LONG per 63 members, merged with ``bit_or``."""
    words = []
    for low in range(0, n_members, WORD_BITS):
        inside = value.isNotNull() & place.between(low, low + WORD_BITS - 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place - low)
        words.append(F.bit_or(F.when(inside, bit)))
    return words


def full_bits(n_members: int) -> list[int]:
    return [2 ** min(WORD_BITS, n_members - low) - 1 for low in range(0, n_members, WORD_BITS)]


def place_in_band(unit: str, members: Members) -> Column:
    """A unit's place among the members of its band, from 0, NULL outside all bands."""
    branches = []
    for units in members.values():
        units = list(units)
        if all(isinstance(u, int) for u in units) and units == list(range(units[0], units[-1] + 1)):
            inside = f"{quoted(unit)} BETWEEN {units[0]} AND {units[-1]}"
            branches.append(f"WHEN {inside} THEN CAST({quoted(unit)} - {units[0]} AS INT)")
        else:
            branches += [f"WHEN {quoted(unit)} = {sql_literal(u)} THEN {n}" for n, u in enumerate(units)]
    return F.expr(f"CASE {' '.join(branches)} END")


def rollup_wide(
    df: DataFrame,
    ids: Sequence[str],
    members: Mapping[str, Sequence[str]],
    values_to: str,
    names_to: str = "Age",
) -> DataFrame:
    """The same for a wide table: ``members`` maps a band to its column names.

    Row-wise ``+`` already gives NULL on a missing member, so this needs no
    shuffle at all.
    """
    sums = {
        label: reduce(add, [df[quoted(c)] for c in columns]).alias(f"_{at}")
        for at, (label, columns) in enumerate(members.items())
    }
    wide = df.select(*[df[quoted(c)] for c in ids], *sums.values())
    groups = {label: {values_to: f"_{at}"} for at, label in enumerate(sums)}
    return lengthen_groups(wide, ids, groups, names_to)


def band_of(unit: str, members: Members) -> Column:
    """Band label of a unit column as one CASE expression, NULL outside all
    bands.  For line level use: no join, no shuffle."""
    branches = []
    for label, units in members.items():
        units = list(units)
        whole_numbers = all(isinstance(u, int) for u in units)
        if whole_numbers and units == list(range(units[0], units[-1] + 1)):
            inside = f"BETWEEN {units[0]} AND {units[-1]}"
        else:
            inside = f"IN ({', '.join(map(sql_literal, units))})"
        branches.append(f"WHEN {quoted(unit)} {inside} THEN {sql_literal(label)}")
    return F.expr(f"CASE {' '.join(branches)} END")


def cross_years(df: DataFrame, first: int, last: int, name: str = "Year") -> DataFrame:
    """Every row once per year; a generator, so no cross join is planned."""
    return df.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias(name))


def period_fractions(
    df: DataFrame,
    periods: Mapping[str, tuple[int, int]],
    years: tuple[int, int],
    recode: Mapping[str, str] | None = None,
    age: str = "Age",
) -> DataFrame:
    """(Year, Age, fraction) from one row per band and one column per period.

    Each period column is expanded to its own years only, so nothing is crossed
    and filtered again.  A year in no period keeps its band with a NULL fraction.
    """
    label = F.col(age)
    for old, new in (recode or {}).items():
        label = F.when(F.col(age) == old, F.lit(new)).otherwise(label)
    pairs = []
    for year in range(years[0], years[1] + 1):
        column = next((p for p, (lo, hi) in periods.items() if lo <= year <= hi), None)
        fraction = "CAST(NULL AS DOUBLE)" if column is None else quoted(column)
        pairs.append(f"named_struct('Year', {year}, 'fraction', {fraction})")
    yearly = F.expr(f"inline(array({', '.join(pairs)}))")
    return df.select(label.alias("Age"), yearly).select("Year", "Age", "fraction")
