"""DuckDB SQL for every query, written independently of the Spark operators:
bands come from integer arithmetic, shares and standards from plain joins."""

from __future__ import annotations

import re

from catalogue import star

D = "–"


def band(unit: str, width: int) -> str:
    low = f"(({unit} - 1) // {width} * {width} + 1)"
    high = f"({low} + {width - 1})"
    two = "lpad(CAST({} AS VARCHAR), 2, '0')"
    return f"({two.format(low)} || '{D}' || {two.format(high)})"


def values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in row) + ")"
        for row in rows
    )


def _fraction_rows() -> str:
    rows = [
        (first, last, row[0], row[1 + at])
        for row in star.FRACTIONS
        for at, (first, last) in enumerate(star.PERIODS.values())
    ]
    return values(rows)


CTES = {
    "lines": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus,
               CAST(year(l_shipdate) AS INTEGER) AS "Year",
               CAST(l_quantity AS INTEGER) AS unit_age,
               l_returnflag = 'R' AS is_event
        FROM lineitem""",
    "typed": """
        SELECT lines.*, p_type FROM lines JOIN part ON l_partkey = p_partkey""",
    "type_cells": """
        SELECT p_type, "Year", unit_age, count(*) AS lines,
               count(*) FILTER (WHERE is_event) AS events
        FROM typed GROUP BY ALL""",
    "unit_cells": """
        SELECT "Year", unit_age, count(*) AS lines,
               count(*) FILTER (WHERE is_event) AS events
        FROM lines GROUP BY ALL""",
    "by_type": f"""
        SELECT p_type, "Year", {band('unit_age', 10)} AS "Age",
               CAST(sum(events) AS BIGINT) AS "Count"
        FROM type_cells GROUP BY ALL""",
    "cell_all": """
        SELECT "Year", "Age", CAST(sum("Count") AS BIGINT) AS all_cases
        FROM by_type GROUP BY ALL""",
    "fact": f"""
        SELECT p_type AS cancer_type, "Year", "Age", "Count", all_cases, p_type AS i_d
        FROM by_type JOIN cell_all USING ("Year", "Age")
        UNION ALL
        SELECT '{star.ALL_TYPES}', "Year", "Age", all_cases, all_cases, NULL FROM cell_all""",
    "classified": """
        SELECT *, CASE WHEN i_d IS NULL THEN 'Total'
                       WHEN i_d = 'ECONOMY' THEN 'A' WHEN i_d = 'LARGE' THEN 'B'
                       WHEN i_d = 'MEDIUM' THEN 'C' WHEN i_d = 'SMALL' THEN 'D'
                       WHEN i_d = 'PROMO' THEN 'Other' ELSE ' ' END AS "Subtype"
        FROM fact""",
    "shares": """
        SELECT "Year", "Subtype",
               CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY "Year") AS DOUBLE) AS proportion
        FROM (SELECT "Year", "Subtype", CAST(sum("Count") AS BIGINT) AS n FROM classified
              WHERE "Subtype" IN ('A', 'B', 'C') GROUP BY ALL)""",
    "raw_parts": """
        SELECT "Year", "Age", s."Subtype", "Count" AS n, proportion,
               CAST("Count" AS DOUBLE) * proportion AS raw
        FROM classified JOIN shares s USING ("Year") WHERE cancer_type = 'STANDARD'""",
    "ranked_parts": """
        SELECT *, n - sum(floor(raw)) OVER (PARTITION BY "Year", "Age") AS remainder,
               row_number() OVER (PARTITION BY "Year", "Age"
                                  ORDER BY raw - floor(raw) DESC, "Subtype") AS place
        FROM raw_parts""",
    "realloc": """
        SELECT "Year", "Age", "Subtype", n, proportion, raw, remainder,
               place <= remainder AS add_one,
               CAST(floor(raw) + CASE WHEN place <= remainder THEN 1 ELSE 0 END AS BIGINT)
                   AS "Count"
        FROM ranked_parts""",
    "cleaned": """
        SELECT "Subtype", cancer_type, "Year", "Age", "Count", all_cases, i_d
        FROM classified WHERE "Subtype" <> ' '
        UNION ALL
        SELECT "Subtype", 'STANDARD', "Year", "Age", "Count", NULL, NULL FROM realloc""",
    "narrow_pop": f"""
        SELECT "Year", {band('unit_age', 5)} AS "Age",
               CASE WHEN count(*) = 5 THEN CAST(sum(lines) AS BIGINT) END AS pop
        FROM unit_cells GROUP BY ALL""",
    "periods": f"""
        SELECT * FROM (VALUES {_fraction_rows()}) t(first_year, last_year, label, fraction)""",
    "fractions": f"""
        SELECT CAST(y AS INTEGER) AS "Year",
               CASE WHEN label = '46+' THEN '46{D}50' ELSE label END AS "Age",
               CAST(fraction AS DOUBLE) AS fraction
        FROM periods JOIN range({star.FIRST_YEAR}, {star.LAST_YEAR + 1}) r(y)
             ON y BETWEEN first_year AND last_year""",
    "exposed_narrow": """
        SELECT "Year", "Age", pop, pop * fraction AS withouthyst
        FROM narrow_pop JOIN fractions USING ("Year", "Age")""",
    "exposed": f"""
        SELECT "Year", {band('CAST(left("Age", 2) AS INTEGER)', 10)} AS "Age",
               CASE WHEN count(pop) = 2 THEN CAST(sum(pop) AS BIGINT) END AS pop,
               CASE WHEN count(withouthyst) = 2 THEN sum(withouthyst) END AS withouthyst
        FROM exposed_narrow GROUP BY ALL""",
    "std": f"""
        SELECT "Age", pop AS standardpop, withouthyst AS withouthyststandardpop
        FROM exposed WHERE "Year" = {star.FIRST_YEAR}""",
    "event_cells": f"""
        SELECT "Year", {band('unit_age', 10)} AS "Age", CAST(sum(events) AS BIGINT) AS "Count"
        FROM unit_cells WHERE unit_age > 10 GROUP BY ALL""",
}


def rate_cte(cells: str, keys: str, how: str = "") -> str:
    """Cell rates over ``cells`` (keys, Count)."""
    return f"""
        SELECT {keys}, "Count", withouthyst + "Count" AS atrisk, pop,
               withouthyststandardpop + "Count" AS atriskstandardpop, standardpop,
               "Count" / nullif(withouthyst + "Count", 0) AS agespecificrate,
               CAST("Count" AS DOUBLE) / nullif(pop, 0) AS agespecificrate_nc
        FROM {cells} {how} JOIN exposed USING ("Year", "Age") {how} JOIN std USING ("Age")"""


def cells_cte(source: str, keys: str, where: str = "TRUE") -> str:
    return f"""
        SELECT {keys}, CAST(sum("Count") AS BIGINT) AS "Count" FROM {source}
        WHERE "Age" <> '01{D}10' AND {where} GROUP BY ALL"""


def totals_cte(rates: str, where: str = "TRUE") -> str:
    return f"""
        SELECT CAST(sum(pop) AS DOUBLE) AS totalpop, sum(atrisk) AS totalatrisk
        FROM {rates} WHERE "Year" = {star.FIRST_YEAR} AND {where}"""


def asr_cte(rates: str, totals: str, keys: str, corrected: str, uncorrected: str) -> str:
    parts = """CAST(sum("Count") AS BIGINT) AS "Count", sum(atrisk) AS atrisk,
               CAST(sum(pop) AS BIGINT) AS pop, sum(atriskstandardpop) AS atriskstandardpop,
               CAST(sum(standardpop) AS BIGINT) AS standardpop"""
    return f"""
        SELECT {keys}, '{corrected}' AS corrected, {parts},
               sum(agespecificrate * atriskstandardpop)
                   / (SELECT totalatrisk FROM {totals}) * 1e5 AS ageadjustedrate
        FROM {rates} GROUP BY {keys}
        UNION ALL
        SELECT {keys}, '{uncorrected}' AS corrected, {parts},
               sum(agespecificrate_nc * standardpop)
                   / (SELECT totalpop FROM {totals}) * 1e5 AS ageadjustedrate
        FROM {rates} GROUP BY {keys}"""


STRATUM = '"Subtype", "Year", "Age"'
HYST = ("corrected for hyst", "not corrected for hyst")
CTES |= {
    "cells": cells_cte("cleaned", STRATUM),
    "rates": rate_cte("cells", STRATUM),
    "totals": totals_cte("rates", "\"Subtype\" = 'Total'"),
    "asr": asr_cte("rates", "totals", '"Subtype", "Year"', *HYST),
    "plain_cells": cells_cte("classified", STRATUM, "\"Subtype\" <> ' '"),
    "plain_rates": rate_cte("plain_cells", STRATUM),
    "plain_totals": totals_cte("plain_rates", "\"Subtype\" = 'Total'"),
    "plain_asr": asr_cte("plain_rates", "plain_totals", '"Subtype", "Year"', *HYST),
    "pooled_cells": cells_cte("cleaned", '"Year", "Age"', "\"Subtype\" IN ('B', 'D')"),
    "pooled_rates": rate_cte("pooled_cells", '"Year", "Age"'),
    "pooled_asr": asr_cte("pooled_rates", "totals", '"Year"', *HYST),
    "group_cells": cells_cte("cleaned", STRATUM, "\"Subtype\" IN ('A', 'B', 'C', 'Total')"),
    "group_base": rate_cte("group_cells", STRATUM, "LEFT"),
    "group_rates": f"""
        SELECT *, CASE WHEN "Age" IN ('11{D}20', '21{D}30') THEN '<31' ELSE '31+' END AS age_group
        FROM group_base""",
    "group_totals": totals_cte("group_rates", "\"Subtype\" = 'Total'"),
    "group_asr": asr_cte(
        "group_rates", "group_totals", '"Subtype", "Year", age_group', *HYST
    ),
    "death_rates": rate_cte("event_cells", '"Year", "Age"'),
    "death_totals": totals_cte("death_rates"),
    "death_asr": asr_cte("death_rates", "death_totals", '"Year"', "rate", "rate_nc"),
    "death_series": f"""
        SELECT "Age", 'rate' AS corrected, "Year", agespecificrate * 1e5 AS rate
        FROM death_rates
        UNION ALL
        SELECT "Age", 'rate_nc', "Year", agespecificrate_nc * 1e5 FROM death_rates
        UNION ALL
        SELECT 'Age{D}standardised', corrected, "Year", ageadjustedrate FROM death_asr""",
    "weighted_levels": f"""
        SELECT p_type, CASE p_type WHEN 'ECONOMY' THEN 'A' WHEN 'LARGE' THEN 'B' WHEN 'MEDIUM' THEN 'C'
                                   WHEN 'SMALL' THEN 'D' WHEN 'PROMO' THEN 'Other' ELSE ' ' END AS "Subtype",
               "Year", {band('unit_age', 10)} AS "Age", l_linenumber * CAST(0.25 AS DOUBLE) AS w
        FROM typed WHERE is_event
        UNION ALL
        SELECT NULL, 'Total', "Year", {band('unit_age', 10)}, l_linenumber * CAST(0.25 AS DOUBLE)
        FROM typed WHERE is_event""",
    "adult": f"""
        SELECT * FROM cleaned WHERE "Age" <> '01{D}10'""",
}

# trend sheets
NAME = "CASE WHEN p_type = 'PROMO' THEN 'PROMO parts' ELSE p_type END"


def change_point_cte(source: str) -> str:
    return f"""
        SELECT "Cohort", "Year", modeled,
               CASE WHEN row_number() OVER (PARTITION BY "Cohort"
                                            ORDER BY modeled DESC, "Year") = 1
                    THEN CAST("Year" AS DOUBLE) END AS point
        FROM {source}"""


def thousandths(n: str) -> str:
    return (
        f"(CASE WHEN ({n}) < 0 THEN '-' ELSE '' END || CAST(abs({n}) // 1000 AS VARCHAR)"
        f" || '.' || lpad(CAST(abs({n}) % 1000 AS VARCHAR), 3, '0'))"
    )


def rounded_two(x: str) -> str:
    """Two decimals from the digits of the number's exact expansion."""
    text = f"format('{{:.80f}}', abs({x}))"
    behind = f"split_part({text}, '.', 2)"
    kept = f"CAST(split_part({text}, '.', 1) || substr({behind}, 1, 2) AS BIGINT)"
    rest, half = f"substr({behind}, 3)", f"'5{'0' * 77}'"
    up = f"CASE WHEN {rest} > {half} OR ({rest} = {half} AND {kept} % 2 = 1) THEN 1 ELSE 0 END"
    return f"(({kept} + {up}) / 100.0::DOUBLE * sign({x}) + 0.0::DOUBLE)"


CTES |= {
    "type_year": """
        SELECT p_type, "Year", sum(events) AS events, sum(lines) AS lines,
               sum(sum(lines)) OVER (PARTITION BY "Year") AS everyone
        FROM type_cells GROUP BY p_type, "Year\"""",
    "type_rates": f"""
        SELECT {NAME} || ' / corrected rate' AS "Cohort", "Year",
               CAST(events AS DOUBLE) * 1e5 / CAST(lines AS DOUBLE) AS modeled
        FROM type_year
        UNION ALL
        SELECT {NAME} || ' / not corrected rate', "Year",
               CAST(events AS DOUBLE) * 1e5 / CAST(everyone AS DOUBLE) FROM type_year""",
    "trend": change_point_cte("type_rates"),
    "tidy": """
        SELECT "Year", point, modeled,
               CASE WHEN split_part("Cohort", ' ', 1) = 'PROMO' THEN 'PROMO parts'
                    ELSE split_part("Cohort", ' ', 1) END AS stratum,
               CASE WHEN contains("Cohort", '/ corrected')
                    THEN 'Modeled hysterectomy-corrected trend'
                    WHEN contains("Cohort", '/ not')
                    THEN 'Modeled hysterectomy-uncorrected trend' END AS variant
        FROM trend WHERE "Year" IN (1995, 2001) OR point IS NOT NULL""",
    "age_rates": f"""
        SELECT {band('unit_age', 10)} AS "Cohort", "Year",
               CAST(sum(events) AS DOUBLE) * 1e5 / CAST(sum(lines) AS DOUBLE) AS modeled
        FROM unit_cells GROUP BY ALL""",
    "age_trend": change_point_cte("age_rates"),
    "age_points": """
        SELECT * FROM age_trend WHERE "Year" IN (1995, 2001) OR point IS NOT NULL""",
    "part_numbers": f"""
        SELECT p_partkey, p_size > 25 AND p_size <> 50 AS star,
               CASE WHEN p_size <> 50
                    THEN CAST({thousandths('p_partkey % 7000 - 3500')} AS DOUBLE) END AS number
        FROM part""",
    "part_texts": f"""
        SELECT *, printf('%.2f', {rounded_two('number')}) AS fixed FROM part_numbers""",
    "type_sums": """
        SELECT p_type, CAST(sum(p_size) AS BIGINT) AS size, count(*) % 2 = 0 AS star
        FROM part GROUP BY p_type""",
    "type_numbers": f"""
        SELECT {NAME} AS stratum, 'Modeled hysterectomy-corrected trend' AS variant, star,
               CAST({thousandths('size % 7000 - 3500')} AS DOUBLE) AS number FROM type_sums
        UNION ALL
        SELECT {NAME}, 'Modeled hysterectomy-uncorrected trend', star,
               CAST({thousandths('size * 7 % 7000 - 3500')} AS DOUBLE) FROM type_sums""",
    "age_texts": f"""
        SELECT band, star, printf('%.2f', {rounded_two('number')}) AS fixed
        FROM (SELECT {band('unit_age', 10)} AS band, sum(events) % 2 = 0 AS star,
                     CAST({thousandths('CAST(sum(lines) AS BIGINT) % 7000 - 3500')} AS DOUBLE)
                         AS number
              FROM unit_cells GROUP BY ALL)""",
    "labels_long": f"""
        SELECT stratum, variant,
               CASE WHEN number < 0 AND {rounded_two('number')} < 0 THEN 'APC=' ELSE 'APC= ' END
               || printf('%.2f', {rounded_two('number')})
               || CASE WHEN star THEN '*' ELSE ' ' END AS label
        FROM type_numbers""",
    "labelled": """
        SELECT * FROM tidy JOIN labels_long USING (stratum, variant)""",
    "shifted": """
        SELECT *, modeled + CASE
                   WHEN variant = 'Modeled hysterectomy-corrected trend' THEN
                       CASE stratum WHEN 'LARGE' THEN 3.0::DOUBLE WHEN 'ECONOMY' THEN 1.0::DOUBLE
                                    ELSE 0.3::DOUBLE END
                   ELSE CASE WHEN stratum IN ('ECONOMY', 'LARGE') THEN -1.0::DOUBLE
                             ELSE -0.3::DOUBLE END END AS moved
        FROM labelled WHERE "Year" = 2001""",
    "anchored": """
        SELECT *, CASE WHEN variant = 'Modeled hysterectomy-corrected trend' THEN
                   CASE WHEN stratum IN ('LARGE', 'ECONOMY', 'SMALL', 'PROMO parts') THEN moved
                        WHEN stratum = 'MEDIUM' THEN moved - 0.3::DOUBLE END END AS own
        FROM shifted""",
}


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it needs, in definition order."""
    def mentioned(text: str) -> set[str]:
        return {n for n in CTES if re.search(rf"(?:FROM|JOIN)\s+{n}\b", text)}

    needed, todo = set(), mentioned(sql)
    while todo:
        needed |= todo
        todo = set().union(*(mentioned(CTES[n]) for n in todo)) - needed
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql


def r(*columns: str) -> str:
    """Six-decimal columns; ``a=b`` renames."""
    return ", ".join(f'round({c}, 6) AS "{c}"' for c in columns)


ASR_PARTS = (
    '"Count", round(atrisk, 6) AS atrisk, pop, '
    "round(atriskstandardpop, 6) AS atriskstandardpop, standardpop, "
    "round(ageadjustedrate, 6) AS ageadjustedrate"
)
SERIES = (
    'corrected, "Subtype", "Year", "Count", round(atrisk, 6) AS atrisk, '
    "round(ageadjustedrate, 6) AS ageadjustedrate"
)


def sheet_columns(sex: str, units=star.UNITS, text: bool = True) -> str:
    column = "lines" if sex == "Female" else "lines - events"
    out = []
    for u in units:
        cell = f"max(CASE WHEN unit_age = {u} THEN {column} END)"
        out.append(
            f'CAST({cell} AS VARCHAR) AS "{star.age_header(sex, u)}"'
            if text
            else f'CAST({cell} AS DOUBLE) AS "Age{u}"'
        )
    return ", ".join(out)


SERIAL = "CAST(date_diff('day', DATE '1899-12-30', make_date(\"Year\", 6, 1)) AS VARCHAR)"
WIDE = list(star.WIDE)
EVENT_BANDS = f"""
    (SELECT "Year", {band('unit_age', 10)} AS "Age", CAST(sum(events) AS BIGINT) AS "Count"
     FROM unit_cells GROUP BY ALL)"""
WIDE_POP = f"""
    (SELECT "Year", {band('unit_age', 10)} AS "Age",
            CASE WHEN count(*) = 10 THEN CAST(sum(lines) AS BIGINT) END AS pop
     FROM unit_cells GROUP BY ALL)"""
YOUNG = """
    SELECT "Year", unit_age, p_type, CAST(sum(events) AS BIGINT) AS "Count"
    FROM type_cells WHERE unit_age <= 10 GROUP BY ALL HAVING sum(events) <> 0"""
# observed columns of the tidy trend tables
POINTS = (
    '"Year" AS "year", point AS joinpoint_location, '
    "round(modeled, 6) AS modeled_ageadjustedrate"
)

_SQL = {
    "scan_filtered": """
        SELECT l_orderkey, l_linenumber, p_type, "Year", unit_age FROM typed
        WHERE p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') AND is_event
          AND l_linestatus = 'F' AND "Year" BETWEEN 1996 AND 2001""",
    "drop_meta_rows": f"""
        SELECT {SERIAL} AS "Serial", {sheet_columns("Male")}, {sheet_columns("Female")}
        FROM unit_cells GROUP BY "Year\"""",
    "select_contains": f"""
        SELECT {SERIAL} AS "Serial",
               {sheet_columns("Female", [u for u in star.UNITS if str(u)[0] not in "45"])}
        FROM unit_cells GROUP BY "Year\"""",
    "regex_rename": f"""
        SELECT "Year", {sheet_columns("Female", text=False)} FROM unit_cells GROUP BY "Year\"""",
    "clean_names": """
        SELECT p_type AS i_d, "Year", unit_age AS "Age", CAST(events AS BIGINT) AS "Count"
        FROM type_cells""",
    "cast_all_strings": """
        SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS customer, CAST(NULL AS DOUBLE) AS status,
               CASE CAST(o_custkey % 8 AS INTEGER)
                    WHEN 3 THEN CAST(o_orderkey % 1000 AS DOUBLE) * 1000
                    WHEN 6 THEN CAST(o_orderkey % 1000 AS DOUBLE) + 0.5
                    WHEN 0 THEN CAST(o_orderkey % 1000 AS DOUBLE)
                    WHEN 4 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS mixed,
               CAST(year(o_orderdate) AS INTEGER) AS "Year" FROM orders""",
    "serial_to_year": """
        SELECT o_orderkey,
               CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS INTEGER)
                   AS serial,
               CAST(year(o_orderdate) AS INTEGER) AS "Year" FROM orders""",
    "year_range": """
        SELECT "Year", count(*) AS lines, count(*) FILTER (WHERE is_event) AS events
        FROM lines WHERE "Year" BETWEEN 1996 AND 2000 GROUP BY "Year\"""",
    "sheet_with_preamble": """
        SELECT unit_age AS age, CASE WHEN is_event THEN 'R, returned' END AS flag, count(*) AS lines,
               CAST(sum(l_orderkey) AS BIGINT) AS orders, CAST(sum(l_linenumber) AS BIGINT) AS numbers
        FROM lines GROUP BY ALL""",
    "year_range_laid_out": """
        SELECT CAST(year(l_shipdate) AS INTEGER) AS "Year", CAST(month(l_shipdate) AS INTEGER) AS "Month",
               count(*) AS lines, CAST(sum(l_orderkey) AS BIGINT) AS orders
        FROM lineitem WHERE l_shipdate >= DATE '1998-11-15' AND l_shipdate < DATE '1999-02-15' GROUP BY ALL""",
    "exclude_bands": f"""
        SELECT CASE WHEN unit_age <= 40 THEN {band('unit_age', 10)} END AS "Age",
               count(*) AS lines
        FROM lines WHERE unit_age > 10 GROUP BY ALL""",
    "classify_codes": """
        SELECT "Subtype", count(*) AS cells, CAST(sum("Count") AS BIGINT) AS "Count"
        FROM classified GROUP BY "Subtype\"""",
    "recode_label": f"""
        SELECT CASE WHEN unit_age > 40 THEN 'age4+'
                    ELSE 'age' || CAST((unit_age - 1) // 10 AS VARCHAR) END AS code,
               CASE WHEN unit_age <= 40 THEN {band('unit_age', 10)} END AS "Age",
               count(*) AS lines
        FROM lines GROUP BY ALL""",
    "label_clean": f"""
        SELECT {band('unit_age', 10)} AS from_hyphen, {band('unit_age', 10)} AS from_broken,
               count(*) AS lines
        FROM lines GROUP BY ALL""",
    "custom_order": """
        SELECT CAST(CASE "Subtype" WHEN 'Total' THEN 1 WHEN 'C' THEN 2 WHEN 'B' THEN 3
                        WHEN 'A' THEN 4 WHEN 'D' THEN 5 WHEN 'Other' THEN 6 ELSE 0 END
                    AS INTEGER) AS "rank",
               "Subtype", CAST(sum("Count") AS BIGINT) AS "Count"
        FROM classified GROUP BY "Subtype" ORDER BY 1""",
    "join_two_key": f"""
        SELECT "Year", "Age", "Count", pop FROM event_cells JOIN {WIDE_POP} p
        USING ("Year", "Age")""",
    "left_join_pop": f"""
        SELECT "Year", "Age", "Count", CASE WHEN "Age" <> '41{D}50' THEN pop END AS pop
        FROM event_cells LEFT JOIN {WIDE_POP} p USING ("Year", "Age")""",
    "cross_years": f"""
        SELECT "Age", lines, CAST(y AS INTEGER) AS "Year"
        FROM (SELECT {band('unit_age', 10)} AS "Age", count(*) AS lines FROM lines GROUP BY ALL)
             CROSS JOIN range(1995, 2002) r(y)""",
    "period_fraction": """
        SELECT "Year", "Age", pop, round(fraction, 6) AS fraction
        FROM narrow_pop JOIN fractions USING ("Year", "Age")""",
    "orphan_keys": """
        SELECT "Year", "Age", pop FROM narrow_pop
        WHERE NOT EXISTS (SELECT 1 FROM periods
                          WHERE label = "Age" AND "Year" BETWEEN first_year AND last_year)""",
    "ref_year_standard": f"SELECT \"Age\", standardpop, {r('withouthyststandardpop')} FROM std",
    "pivot_single": 'SELECT "Year", '
    + ", ".join(f"""max(CASE WHEN "Age" = '{b}' THEN "Count" END) AS "Age{b}\"""" for b in WIDE)
    + f' FROM {EVENT_BANDS} GROUP BY "Year"',
    "pivot_two_measures": 'SELECT "Year", '
    + ", ".join(f"""max(CASE WHEN "Age" = '{b}' THEN pop END) AS "pop_{b}\"""" for b in WIDE)
    + ", "
    + ", ".join(
        f"""round(max(CASE WHEN "Age" = '{b}' THEN withouthyst END), 6) AS "withouthyst_{b}\""""
        for b in WIDE
    )
    + ' FROM exposed GROUP BY "Year"',
    "unpivot_single": """
        SELECT "Year", 'Age' || CAST(unit_age AS VARCHAR) AS "Age", CAST(lines AS DOUBLE) AS pop
        FROM unit_cells""",
    "unpivot_multi": f"SELECT \"Year\", \"Age\", pop, {r('withouthyst')} FROM exposed",
    "variants_long": f"""
        SELECT "Year", "Age", corrected, {r('rate')} FROM death_series
        WHERE "Age" <> 'Age{D}standardised'""",
    "band_rollup": 'SELECT "Year", "Age", pop FROM narrow_pop',
    "reband_counts": f"""
        SELECT "Year", "Age", "Count" FROM {EVENT_BANDS} WHERE "Age" <> '01{D}10'""",
    "reband_exposure": f"SELECT \"Year\", \"Age\", pop, {r('withouthyst')} FROM exposed",
    "population_bands": 'SELECT "Year", "Age", CAST(pop AS DOUBLE) AS pop FROM narrow_pop',
    "share_of_year": f"SELECT \"Year\", \"Subtype\", {r('proportion')} FROM shares",
    "reallocate_lr": """
        SELECT "Year", "Age", "Subtype", "Count", n, round(proportion, 6) AS proportion,
               round(raw, 6) AS raw, CAST(remainder AS DOUBLE) AS remainder, add_one
        FROM realloc""",
    "append_reallocated": """
        SELECT "Subtype", cancer_type, "Year", "Age", "Count",
               all_cases AS "ALLUterineCancers", i_d FROM cleaned""",
    "fill_forward": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS "Year", o_orderstatus,
               round(last_value(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END
                                IGNORE NULLS)
                     OVER (PARTITION BY year(o_orderdate), o_orderstatus ORDER BY o_orderkey
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS price
        FROM orders""",
    "unspecified_share": """
        SELECT "Year", CAST(sum(n) AS BIGINT) AS "Count",
               CAST(sum(all_cases) AS BIGINT) AS "ALLUterineCancers",
               round(CAST(sum(n) AS DOUBLE) / sum(all_cases) * 100, 6) AS prop
        FROM (SELECT "Year", "Age", sum("Count") AS n FROM realloc GROUP BY ALL)
             JOIN cell_all USING ("Year", "Age") GROUP BY "Year\"""",
    "exposed_population": f"""
        SELECT "Year", "Age", pop, {r('withouthyst')} FROM exposed_narrow""",
    "ref_totals": f"SELECT {r('totalpop', 'totalatrisk')} FROM totals",
    "age_specific_rates": f"""
        SELECT {STRATUM}, "Count", pop, standardpop,
               {r('atrisk', 'atriskstandardpop', 'agespecificrate', 'agespecificrate_nc')}
        FROM rates""",
    "asr_no_stratum": f'SELECT "Year", corrected, {ASR_PARTS} FROM death_asr',
    "asr_by_stratum": f'SELECT "Subtype", "Year", corrected, {ASR_PARTS} FROM plain_asr',
    "pooled_asr": f"SELECT corrected, \"Year\", {r('ageadjustedrate')} FROM pooled_asr",
    "two_group_asr": f"""
        SELECT corrected, "Subtype", age_group, "Year", "Count",
               {r('atrisk', 'ageadjustedrate')}
        FROM group_asr WHERE corrected = 'corrected for hyst'""",
    "sensitivity_after": f'SELECT {SERIES} FROM asr WHERE "Year" > 1997',
    "append_standardised": f"""
        SELECT "Age", "Year", "Count", round(atrisk, 6) AS atrisk,
               round(agespecificrate * 1e5, 6) AS agespecificrate
        FROM rates WHERE "Subtype" = 'Total'
        UNION ALL
        SELECT 'Age{D}standardised', "Year", 0, 0, round(ageadjustedrate, 6)
        FROM asr WHERE "Subtype" = 'Total' AND corrected = 'corrected for hyst'""",
    "append_standardised_variants": f"""
        SELECT "Age", corrected, "Year", {r('rate')} FROM death_series""",
    "extract_years": f"""
        SELECT "Subtype", "Age", "Year", "Count", {r('atrisk')} FROM rates
        WHERE "Subtype" IN ('A', 'B', 'C', 'Total') AND "Year" IN (1995, 1998, 2001)""",
    "extract_years_asr": f"""
        SELECT {SERIES} FROM asr
        WHERE "Subtype" IN ('A', 'B', 'C', 'Total') AND "Year" IN (1995, 1998, 2001)
          AND corrected = 'corrected for hyst'""",
    "rate_slice": f"""
        SELECT "Age", corrected, "Year", {r('rate')} FROM death_series WHERE "Year" = 1995""",
    "incidence_rates": f'SELECT "Subtype", "Year", corrected, {ASR_PARTS} FROM asr',
    "incidence_from_sheet": f'SELECT "Subtype", "Year", corrected, {r("ageadjustedrate")} FROM asr',
    "mortality_rates": f"SELECT \"Age\", corrected, \"Year\", {r('rate')} FROM death_series",
    "counts_by_keys": """
        SELECT cancer_type, i_d, CAST(sum("Count") AS BIGINT) AS "Count" FROM adult
        GROUP BY ALL""",
    "counts_total": 'SELECT CAST(sum("Count") AS BIGINT) AS "Count" FROM event_cells',
    "counts_after_year": """
        SELECT "Subtype", CAST(sum("Count") AS BIGINT) AS "Count" FROM adult
        WHERE "Year" > 1997 GROUP BY ALL""",
    "counts_by_band": """
        SELECT "Age", CAST(sum("Count") AS BIGINT) AS "Count" FROM cleaned
        WHERE "Subtype" <> 'Total' GROUP BY ALL""",
    "counts_single_year": """
        SELECT "Subtype", CAST(sum("Count") AS BIGINT) AS "Count" FROM adult
        WHERE "Year" = 2001 GROUP BY ALL""",
    "young_cases": f"""
        SELECT "Year", "Age", cancer_type, CAST(sum("Count") AS BIGINT) AS "Count" FROM cleaned
        WHERE "Age" = '11{D}20' AND "Subtype" <> 'Total' GROUP BY ALL HAVING sum("Count") <> 0""",
    "counts_weighted": """
        SELECT "Subtype", "Year", "Age", sum(w) AS "Count" FROM weighted_levels
        WHERE "Subtype" <> ' ' GROUP BY ALL""",
    "reallocate_weighted": """
        SELECT "Year", "Age", "Subtype",
               floor(raw) + CASE WHEN place <= remainder THEN 1 ELSE 0 END AS "Count",
               n, round(proportion, 6) AS proportion, round(raw, 6) AS raw, round(remainder, 6) AS remainder,
               place <= remainder AS add_one
        FROM (SELECT *, n - sum(floor(raw)) OVER (PARTITION BY "Year", "Age") AS remainder,
                     row_number() OVER (PARTITION BY "Year", "Age"
                                        ORDER BY raw - floor(raw) DESC, "Subtype") AS place
              FROM (SELECT u."Year", "Age", "Subtype", n, proportion, n * proportion AS raw
                    FROM (SELECT "Year", "Age", sum(w) AS n FROM weighted_levels
                          WHERE p_type = 'STANDARD' GROUP BY ALL) u
                    JOIN (SELECT "Year", "Subtype", s / sum(s) OVER (PARTITION BY "Year") AS proportion
                          FROM (SELECT "Year", "Subtype", sum(w) AS s FROM weighted_levels
                                WHERE "Subtype" IN ('A', 'B', 'C') GROUP BY ALL)) p
                    ON u."Year" = p."Year"))""",
    "reallocate_parts": """
        SELECT "Year", unit_age, l_partkey,
               CAST(floor(raw) + CASE WHEN place <= n - floors THEN 1 ELSE 0 END AS BIGINT) AS "Count"
        FROM (SELECT *, sum(floor(raw)) OVER (PARTITION BY "Year", unit_age) AS floors,
                     row_number() OVER (PARTITION BY "Year", unit_age ORDER BY raw - floor(raw) DESC, l_partkey) AS place
              FROM (SELECT u."Year", unit_age, l_partkey, n, n * proportion AS raw
                    FROM (SELECT "Year", unit_age, sum(lines) AS n FROM type_cells
                          WHERE p_type = 'STANDARD' AND unit_age <= 10 GROUP BY ALL) u
                    JOIN (SELECT "Year", l_partkey, CAST(s AS DOUBLE) / sum(s) OVER (PARTITION BY "Year") AS proportion
                          FROM (SELECT "Year", l_partkey, count(*) AS s FROM lines GROUP BY ALL)) p
                    ON u."Year" = p."Year"))""",
    "rollup_sparse": f"""
        SELECT l_suppkey, "Year", b.band AS "Age", CASE WHEN count(c.n) = 5 THEN CAST(sum(c.n) AS BIGINT) END AS pop
        FROM (SELECT DISTINCT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS "Year" FROM lineitem) k
        CROSS JOIN (SELECT DISTINCT {band('CAST(u AS INTEGER)', 5)} AS band FROM range(1, 51) t(u)) b
        LEFT JOIN (SELECT l_suppkey AS s, CAST(year(l_shipdate) AS INTEGER) AS y,
                          CAST(l_quantity AS INTEGER) AS a, count(*) AS n
                   FROM lineitem GROUP BY ALL) c
               ON c.s = l_suppkey AND c.y = "Year" AND {band('c.a', 5)} = b.band
        GROUP BY ALL""",
    "rollup_lost_doubled": f"""
        SELECT "Year", b.band AS "Age",
               CASE WHEN count(a) = 5 AND count(DISTINCT a) = 5 THEN CAST(sum(lines) AS BIGINT) END AS lines,
               CASE WHEN count(a) = 5 AND count(DISTINCT a) = 5 THEN CAST(sum(events) AS BIGINT) END AS events
        FROM (SELECT DISTINCT "Year" FROM unit_cells)
        CROSS JOIN (SELECT DISTINCT {band('CAST(u AS INTEGER)', 5)} AS band FROM range(1, 51) t(u)) b
        LEFT JOIN (SELECT "Year" AS y, unit_age AS a, lines, events
                   FROM unit_cells, range(1, CASE (unit_age + "Year") % 11 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END)) c
               ON c.y = "Year" AND {band('c.a', 5)} = b.band
        GROUP BY ALL""",
    "counts_stratum_year": """
        SELECT "Subtype", "Year", CAST(sum("Count") AS BIGINT) AS "Count" FROM rates
        GROUP BY ALL""",
    "cells_merged": """
        SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS "Year", CAST(l_quantity AS INTEGER) AS unit_age,
               CASE WHEN bool_and(l_extendedprice > 2000) THEN CAST(sum(l_linenumber) AS BIGINT) END AS discounted,
               CAST(sum(l_orderkey) AS BIGINT) AS orders,
               CAST(coalesce(sum(l_linenumber) FILTER (WHERE l_extendedprice > 2000), 0) AS BIGINT) AS known
        FROM lineitem GROUP BY ALL""",
    "nonzero_cells": YOUNG,
    "preview_top30": YOUNG + ' ORDER BY "Year", unit_age, p_type LIMIT 30',
    "trend_points": f"""
        SELECT "Cohort" AS cohort, {POINTS} FROM trend
        WHERE "Year" IN (1995, 2001) OR point IS NOT NULL""",
    "trend_tidy": f"""
        SELECT {POINTS}, stratum AS subtype, variant AS corrected,
               'Modeled trend' AS observed, stratum || ' ' || variant AS "group"
        FROM tidy""",
    "trend_tidy_age": """
        SELECT "Year" AS "year", round(modeled, 6) AS modeled_agespecificrate,
               "Cohort" AS age, 'Modeled Trend' AS observed, point AS joinpoint
        FROM age_points""",
    "trend_tidy_mortality": """
        SELECT "Year" AS "year", round(modeled, 6) AS modeled_rate, "Cohort" AS age,
               'Modeled Trend' AS observed,
               CASE WHEN point IS NOT NULL THEN 'Joinpoint ' END AS joinpoint
        FROM age_points""",
    "trend_markers": f"""
        SELECT {POINTS}, stratum AS subtype, 'Joinpoints' AS corrected,
               'Modeled trend' AS observed, stratum || ' ' || variant AS "group"
        FROM tidy WHERE point IS NOT NULL""",
    "trend_markers_age": """
        SELECT "Year" AS "year", round(modeled, 6) AS modeled_agespecificrate,
               "Cohort" AS age, 'Joinpoint' AS observed, point AS joinpoint
        FROM age_points WHERE point IS NOT NULL""",
    "round_exact": f"""
        SELECT p_partkey, {rounded_two('eighths')} AS eighths, {rounded_two('fifths')} AS fifths,
               {rounded_two('price')} AS price
        FROM (SELECT p_partkey, (p_partkey - 1000) / 8.0::DOUBLE AS eighths,
                     (p_partkey * 10 + 5) / 1000.0::DOUBLE AS fifths, p_retailprice / 7.0::DOUBLE AS price FROM part)""",
    "aapc_label": """
        SELECT p_partkey,
               CASE WHEN starts_with(fixed, '-') THEN 'APC=' ELSE 'APC= ' END || fixed
               || CASE WHEN star THEN '*' ELSE ' ' END AS label FROM part_texts""",
    "aapc_label_padded": """
        SELECT p_partkey,
               lpad(fixed, CAST((SELECT max(length(fixed)) FROM part_texts) AS INTEGER), ' ')
               || ' ' || CASE WHEN star THEN '*' ELSE '' END AS label FROM part_texts""",
    "aapc_label_short": r"""
        SELECT p_partkey,
               regexp_replace(regexp_replace(fixed, '(\.\d*?)0+$', '\1'), '\.$', '')
               || ' ' || CASE WHEN star THEN '*' ELSE ' ' END AS label FROM part_texts""",
    "trend_with_label": f"""
        SELECT CAST(1 AS DOUBLE) * "Year" - 0.5::DOUBLE AS "year", point AS joinpoint_location,
               round(modeled, 6) AS modeled_ageadjustedrate, stratum AS subtype,
               variant AS corrected, 'Modeled trend' AS observed,
               stratum || ' ' || variant AS "group", label
        FROM labelled WHERE "Year" = 2001""",
    "trend_with_label_age": """
        SELECT band AS age, CAST("Year" AS DOUBLE) - 0.5::DOUBLE AS "year",
               round(modeled, 6) AS modeled_agespecificrate, 'Modeled Trend' AS observed,
               point AS joinpoint,
               lpad(fixed, CAST((SELECT max(length(fixed)) FROM age_texts) AS INTEGER), ' ')
               || ' ' || CASE WHEN star THEN '*' ELSE '' END AS label
        FROM age_points JOIN age_texts ON band = "Cohort" WHERE "Year" = 2001""",
    "trend_with_label_mortality": r"""
        SELECT band AS age, "Year" AS "year", round(modeled, 6) AS modeled_rate,
               'Modeled Trend' AS observed,
               CASE WHEN point IS NOT NULL THEN 'Joinpoint ' END AS joinpoint,
               regexp_replace(regexp_replace(fixed, '(\.\d*?)0+$', '\1'), '\.$', '')
               || ' ' || CASE WHEN star THEN '*' ELSE ' ' END AS label
        FROM age_points JOIN age_texts ON "Cohort" = band""",
    "label_anchor": """
        SELECT "Year" AS "year", point AS joinpoint_location,
               round(moved, 6) AS modeled_ageadjustedrate, stratum AS subtype,
               variant AS corrected, 'Modeled trend' AS observed,
               stratum || ' ' || variant AS "group", label,
               round(CASE WHEN variant = 'Modeled hysterectomy-corrected trend' THEN own
                          WHEN stratum IN ('ECONOMY', 'LARGE') THEN first_own - 8
                          ELSE first_own - 0.6::DOUBLE END, 6) AS yaxis
        FROM (SELECT *, max(own) OVER (PARTITION BY stratum) AS first_own FROM anchored)""",
    "chart_shares": """
        SELECT "Year", "Subtype", round(proportion * 100, 6) AS proportion,
               CAST(CASE "Subtype" WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS INTEGER) AS panel FROM shares""",
    "chart_age_rates": """
        SELECT "Subtype", "Year", "Age", 'corrected for hyst' AS corrected,
               round(agespecificrate * 1e5, 6) AS rate FROM rates
        UNION ALL
        SELECT "Subtype", "Year", "Age", 'not corrected for hyst', round(agespecificrate_nc * 1e5, 6) FROM rates""",
    "chart_mortality": f"""
        SELECT "Age", corrected, "Year", {r('rate')}, 'Observed Rate' AS observed,
               CAST(CASE WHEN "Age" = 'Age{D}standardised' THEN 1
                         ELSE CAST(left("Age", 2) AS INTEGER) // 10 + 2 END AS INTEGER) AS panel
        FROM death_series WHERE corrected = 'rate'""",
    "chart_series": """
        SELECT CASE corrected WHEN 'corrected for hyst' THEN 'Observed corrected rate'
                              ELSE 'Observed uncorrected rate' END AS corrected,
               "Subtype", "Year", "Count", round(atrisk, 6) AS atrisk,
               round(ageadjustedrate, 6) AS ageadjustedrate, 'Observed Rate' AS observed,
               CAST(CASE "Subtype" WHEN 'Total' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS INTEGER)
                   AS panel
        FROM asr WHERE "Subtype" IN ('Total', 'A', 'B')""",
    "export_lines": """
        SELECT "row", '"' || "row" || '",' || p_partkey || ','
               || coalesce('"' || replace(type, '"', '""') || '"', 'NA') || ','
               || coalesce(format('{:.15g}', price), 'NA') || ',' || CASE WHEN large THEN 'TRUE' ELSE 'FALSE' END AS line
        FROM (SELECT *, row_number() OVER (ORDER BY type DESC NULLS LAST, p_partkey) AS "row"
              FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_type || ' "' || p_brand || '"' END AS type,
                           CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS price, p_size > 25 AS large FROM part))""",
    "export_indexed": f"""
        SELECT row_number() OVER (ORDER BY corrected, "Subtype", "Year") AS "row", {SERIES}
        FROM asr""",
}

ORACLES = {name: with_ctes(sql) for name, sql in _SQL.items()}
