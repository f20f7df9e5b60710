"""Display text built as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ownergraph.functions.normalize import empty_to_null


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_na(c) -> Column:
    """Value, or 'N/A' when empty."""
    return F.coalesce(empty_to_null(c), F.lit("N/A"))


def address(city, country) -> Column:
    """E18: 'city, country' with '' for a missing part."""
    return F.concat(
        F.coalesce(empty_to_null(city), F.lit("")),
        F.lit(", "),
        F.coalesce(empty_to_null(country), F.lit("")),
    )


def parent_line(lei, name, status, jurisdiction, isins=None) -> Column:
    """E19: 'lei | name | status | jurisdiction-or-N/A [| ISINs: ...]'."""
    parts = [_c(lei), F.coalesce(_c(name), F.lit("")), F.coalesce(_c(status), F.lit("")), or_na(jurisdiction)]
    if isins is not None:
        parts.append(F.when(_c(isins) != "", F.concat(F.lit("ISINs: "), _c(isins))))
    return F.concat_ws(" | ", *parts)


def node_label(lei, name, jurisdiction, status, isins=None) -> Column:
    """E20: 'lei [name] [(jurisdiction, status)] [ISINs: ...]' - each part
    only when present."""
    details = empty_to_null(F.concat_ws(", ", empty_to_null(jurisdiction), empty_to_null(status)))
    parts = [_c(lei), empty_to_null(name), F.concat(F.lit("("), details, F.lit(")"))]
    if isins is not None:
        parts.append(F.when(_c(isins) != "", F.concat(F.lit("ISINs: "), _c(isins))))
    return F.concat_ws(" ", *parts)
