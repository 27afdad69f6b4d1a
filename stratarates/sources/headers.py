"""Column-name operations.  All of them touch metadata only: no data moves."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

# Symbols that are spelled out instead of dropped.
SPELLED_OUT = {"%": "_percent_", "#": "_number_"}


def snake_name(name: str) -> str:
    """``"Age group (years)"`` -> ``age_group_years``, ``"I.D"`` -> ``i_d``."""
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    text = text.replace("'", "").replace('"', "")
    for symbol, word in SPELLED_OUT.items():
        text = text.replace(symbol, word)
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case every header; repeated names get ``_2``, ``_3``, …, skipping
    numbers that another header already bears."""
    snake = [snake_name(column) for column in df.columns]
    taken: set[str] = set()
    names = []
    for name in snake:
        free, n = name, 1
        while free in taken or (n > 1 and free in snake):
            n += 1
            free = f"{name}_{n}"
        taken.add(free)
        names.append(free)
    return df.toDF(*names)


def rename_by_patterns(df: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Apply ``(regex, replacement)`` pairs, in order, to every header."""
    names = list(df.columns)
    for pattern, replacement in patterns:
        names = [re.sub(pattern, replacement, n) for n in names]
    return df.toDF(*names)


def columns_containing(df: DataFrame, fragments: Iterable[str]) -> list[str]:
    """Headers holding any fragment; literal and case-insensitive."""
    wanted = [f.lower() for f in fragments]
    return [c for c in df.columns if any(f in c.lower() for f in wanted)]


def quoted(name: str) -> str:
    """A header as an identifier, for names holding dots, blanks or symbols."""
    return "`" + name.replace("`", "``") + "`"


def select_containing(
    df: DataFrame, fragments: Iterable[str], keep: Sequence[str] = ()
) -> DataFrame:
    """The ``keep`` columns, then every column holding a fragment."""
    found = [c for c in columns_containing(df, fragments) if c not in keep]
    return df.select(*[df[quoted(c)] for c in [*keep, *found]])


def drop_containing(
    df: DataFrame, fragments: Iterable[str], keep: Sequence[str] = ()
) -> DataFrame:
    """All columns but those holding a fragment (``keep`` wins)."""
    lost = set(columns_containing(df, fragments)) - set(keep)
    return df.select(*[df[quoted(c)] for c in df.columns if c not in lost])


def sql_literal(value: str | int | float) -> str:
    """A Python value as a SQL literal, for generated expressions."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)
