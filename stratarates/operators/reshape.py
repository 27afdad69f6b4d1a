"""Long <-> wide.  The value list of every pivot is explicit, so no extra job
looks for distinct values and the plan has a fixed width."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.sources.headers import quoted, sql_literal


def widen(
    df: DataFrame,
    keys: Sequence[str],
    names_from: str,
    names: Sequence,
    values_from: str | Sequence[str],
    prefix: str = "",
) -> DataFrame:
    """One column per name (and measure); an absent cell is NULL.

    One measure gives ``<prefix><name>``; several give ``<measure>_<name>``.
    (keys, name) must identify a row; ``max`` only picks that row's value.
    """
    several = not isinstance(values_from, str)
    measures = list(values_from) if several else [values_from]
    wide = (
        df.groupBy(*keys)
        .pivot(names_from, list(names))
        .agg(*[F.max(F.col(quoted(m))).alias(m) for m in measures])
    )
    columns = [wide[quoted(k)] for k in keys]
    for m in measures:
        for n in names:
            source = f"{n}_{m}" if several and len(measures) > 1 else str(n)
            target = f"{m}_{n}" if several else f"{prefix}{n}"
            columns.append(wide[quoted(source)].alias(target))
    return wide.select(*columns)


def lengthen(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], names_to: str, values_to: str
) -> DataFrame:
    """One row per (ids, column); NULL cells are kept."""
    return df.unpivot(
        [df[quoted(c)] for c in ids], [df[quoted(c)] for c in columns], names_to, values_to
    )


def lengthen_groups(
    df: DataFrame,
    ids: Sequence[str],
    groups: Mapping[str, Mapping[str, str]],
    names_to: str,
) -> DataFrame:
    """Several measures at once: ``groups`` maps each new row's name to
    ``{measure: source column}``.  NULL cells are kept."""
    rows = ", ".join(
        f"named_struct({sql_literal(names_to)}, {sql_literal(name)}, "
        + ", ".join(f"{sql_literal(m)}, {quoted(c)}" for m, c in cells.items())
        + ")"
        for name, cells in groups.items()
    )
    return df.select(*[F.col(quoted(c)) for c in ids], F.expr(f"inline(array({rows}))"))


def lengthen_by_pattern(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], pattern: str, names_to: str
) -> DataFrame:
    """Like :func:`lengthen_groups`, with (measure, name) read off each header
    by a two-group regular expression such as ``(.*)_(.*)``."""
    groups: dict[str, dict[str, str]] = {}
    for column in columns:
        found = re.fullmatch(pattern, column)
        if found is None:
            raise ValueError(f"column {column!r} does not match {pattern!r}")
        measure, name = found.groups()
        groups.setdefault(name, {})[measure] = column
    return lengthen_groups(df, ids, groups, names_to)
