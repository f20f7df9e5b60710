"""Column expressions for LEI input cleaning and result normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ownergraph.schema import ENTITY_COLUMNS, LEI_LENGTH, REQUIRED_ENTITY_COLUMNS

# (?U) makes \s Unicode aware, so no-break and em spaces are removed too,
# like Python's str.strip(); Python also counts the separators U+001C-U+001F
# as whitespace, Java's \s does not, so they are listed explicitly.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_lei(c) -> Column:
    """Strip surrounding whitespace and upper-case."""
    return F.upper(F.regexp_replace(_col(c), _EDGE_SPACE, ""))


def is_valid_lei(c) -> Column:
    """A LEI must be exactly 20 characters long (NULL is not valid)."""
    return F.coalesce(F.length(_col(c)) == LEI_LENGTH, F.lit(False))


def empty_to_null(c) -> Column:
    """'' and NULL both become NULL."""
    return F.nullif(_col(c), F.lit(""))


def null_to_empty(c) -> Column:
    """'' and NULL both become ''."""
    return F.coalesce(_col(c), F.lit(""))


def entity_projection(prefix: str | None = None, lei_alias: str = "lei") -> list[Column]:
    """E3 + E4: the 10 entity columns with empty-value normalisation.

    Required fields (name, status, registration status) become '' when
    empty; the other six become NULL.
    """
    out = []
    for name in ENTITY_COLUMNS:
        src = F.col(f"{prefix}.{name}") if prefix else F.col(name)
        if name == "lei":
            out.append(src.alias(lei_alias))
        elif name in REQUIRED_ENTITY_COLUMNS:
            out.append(null_to_empty(src).alias(name))
        else:
            out.append(empty_to_null(src).alias(name))
    return out


def related_projection(
    request_col: Column,
    related_col: Column,
    name_col: Column,
    type_col: Column,
    status_col: Column,
    direction: str,
    stored_name: bool = False,
) -> list[Column]:
    """E5 + E16: one related-entity row (name NULL when empty, status '').
    ``stored_name`` adds the name as stored, the key of the display order."""
    return [
        request_col.alias("lei"),
        related_col.alias("related_lei"),
        empty_to_null(name_col).alias("legal_name"),
        type_col.alias("relationship_type"),
        null_to_empty(status_col).alias("relationship_status"),
        F.lit(direction).alias("direction"),
        *([name_col.alias("stored_name")] if stored_name else []),
    ]
