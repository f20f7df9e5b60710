"""Security identifiers (ISINs) from stored API responses.

The input is a table of stored responses ``(lei, payload)`` - one JSON text
per LEI, NULL when the request failed. The ISIN list of a LEI comes from one
row, so it is parsed with higher-order functions inside that row: no shuffle,
no grouping, and the list can never outgrow the payload it came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Only the path data[].attributes.isin is read from the response.
PAYLOAD_SCHEMA = "data array<struct<attributes:struct<isin:string>>>"


def isin_array(payload_col: str = "payload"):
    """S1/S3 as an expression: ISINs in response order, missing and empty
    ones dropped. NULL or malformed payloads give NULL."""
    parsed = F.from_json(F.col(payload_col), PAYLOAD_SCHEMA)
    isins = F.transform(parsed["data"], lambda item: item["attributes"]["isin"])
    return F.filter(isins, lambda s: s.isNotNull() & (s != ""))


def isin_map(payloads: DataFrame, lei_col: str = "lei", payload_col: str = "payload") -> DataFrame:
    """``(lei, isins array<string>)``; LEIs without ISINs are absent."""
    out = payloads.select(F.col(lei_col).alias("lei"), isin_array(payload_col).alias("isins"))
    return out.where(F.size("isins") > 0)


def parse_isins(payloads: DataFrame, lei_col: str = "lei", payload_col: str = "payload") -> DataFrame:
    """S1 long form: ``(lei, pos, isin)`` with 0-based position among the
    kept ISINs."""
    arr = payloads.select(F.col(lei_col).alias("lei"), isin_array(payload_col).alias("isins"))
    return arr.select("lei", F.posexplode("isins").alias("pos", "isin"))


def attach_isins(
    df: DataFrame, isins: DataFrame, lei_col: str = "lei", out_col: str = "isins"
) -> DataFrame:
    """Add ``out_col`` = ISINs joined by ', ' ('' when none)."""
    m = isins.select(F.col("lei").alias("__isin_lei"), F.col("isins").alias("__isin_list"))
    joined = df.join(m, df[lei_col] == m["__isin_lei"], "left")
    text = F.coalesce(F.array_join("__isin_list", ", "), F.lit(""))
    return joined.withColumn(out_col, text).drop("__isin_lei", "__isin_list")
