"""The adapter: deterministic views that turn the driver's TPC-H-style tables
(``customer``, ``supplier``, ``nation``) into the legal-entity model.

The SQL is portable: the same text runs in Spark SQL (``{name}`` placeholders
bound to DataFrames) and in DuckDB (placeholders replaced by view names), so
the oracle prefix and the Spark inputs can never drift apart. Literal braces
are doubled because both sides go through ``str.format`` rules.

Rules (k = c_custkey, base = k - k % 100, j = k % 100, g = (k div 100) % 5):
each block of 100 customers is one corporate family; g <> 4 is a 4-ary tree,
g = 4 chains of 20; g <= 2 adds second parents (diamonds); g = 3 closes a
cycle through base + 99; k % 300 = 0 in g <= 2 points at a parent missing
from the entity table; suppliers are "managed by" customer 15 * s_suppkey.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

FX_KEYS = """
SELECT c_custkey AS k, c_custkey - c_custkey % 100 AS base, c_custkey % 100 AS j,
       CAST(floor(c_custkey / 100.0) AS BIGINT) % 5 AS g,
       'CUST' || lpad(CAST(c_custkey AS STRING), 16, '0') AS lei,
       CASE WHEN c_custkey % 29 = 0 THEN CAST(NULL AS STRING)
            WHEN c_custkey % 13 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS st
FROM {customer}
"""

LEI_RECORDS = """
SELECT 'CUST' || lpad(CAST(c_custkey AS STRING), 16, '0') AS lei,
       c_name AS legal_name,
       CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS entity_status,
       CASE WHEN c_custkey % 5 = 0 THEN 'LAPSED' ELSE 'ISSUED' END AS registration_status,
       c_mktsegment AS entity_category,
       n_name AS legal_jurisdiction,
       CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'City ' || CAST(c_custkey % 50 AS STRING) END AS legal_address_city,
       n_name AS legal_address_country,
       CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS STRING) ELSE 'HQ ' || CAST(c_custkey % 40 AS STRING) END AS hq_address_city,
       n_name AS hq_address_country
FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT 'SUPP' || lpad(CAST(s_suppkey AS STRING), 16, '0'),
       CASE WHEN s_suppkey % 20 = 7 THEN CAST(NULL AS STRING) ELSE s_name END,
       'ACTIVE', 'ISSUED', 'FUND', n_name, CAST(NULL AS STRING), n_name, CAST(NULL AS STRING), n_name
FROM {supplier} LEFT JOIN {nation} ON s_nationkey = n_nationkey
"""

RELATIONSHIPS = """
SELECT lei AS start_node_id,
       'CUST' || lpad(CAST(base + CAST(floor((j - 1) / 4.0) AS BIGINT) AS STRING), 16, '0') AS end_node_id,
       'IS_DIRECTLY_CONSOLIDATED_BY' AS relationship_type, st AS relationship_status
FROM {fx_keys} WHERE j >= 1 AND g <> 4
UNION ALL
SELECT lei, 'CUST' || lpad(CAST(k - 1 AS STRING), 16, '0'), 'IS_DIRECTLY_CONSOLIDATED_BY', st
FROM {fx_keys} WHERE g = 4 AND j % 20 <> 0
UNION ALL
SELECT lei, 'CUST' || lpad(CAST(base + CAST(floor((j - 1) / 3.0) AS BIGINT) AS STRING), 16, '0'), 'IS_DIRECTLY_CONSOLIDATED_BY', 'ACTIVE'
FROM {fx_keys} WHERE g <= 2 AND j % 9 = 5 AND j >= 14
UNION ALL
SELECT lei, 'CUST' || lpad(CAST(base + 99 AS STRING), 16, '0'), 'IS_DIRECTLY_CONSOLIDATED_BY', 'ACTIVE'
FROM {fx_keys} WHERE g = 3 AND j = 0
UNION ALL
SELECT lei, 'CUST' || lpad(CAST(base AS STRING), 16, '0'), 'IS_ULTIMATELY_CONSOLIDATED_BY', st
FROM {fx_keys} WHERE j >= 1 AND k % 17 <> 0
UNION ALL
SELECT lei, 'GHOST' || lpad(CAST(k AS STRING), 15, '0'), 'IS_DIRECTLY_CONSOLIDATED_BY', 'ACTIVE'
FROM {fx_keys} WHERE g <= 2 AND j = 0 AND k % 300 = 0
UNION ALL
SELECT 'SUPP' || lpad(CAST(s_suppkey AS STRING), 16, '0'), 'CUST' || lpad(CAST(s_suppkey * 15 AS STRING), 16, '0'), 'IS_MANAGED_BY', 'ACTIVE'
FROM {supplier}
"""

REPORTING_EXCEPTIONS = """
SELECT lei, 'ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT' AS exception_category,
       CASE g WHEN 0 THEN 'NON_PUBLIC' WHEN 1 THEN 'LEGAL_OBSTACLES' WHEN 2 THEN 'NATURAL_PERSONS' ELSE 'NO_KNOWN_PERSON' END AS exception_reason_1,
       CASE WHEN g = 0 THEN '' ELSE 'REF-' || CAST(k AS STRING) END AS exception_reference_1
FROM {fx_keys} WHERE j = 0
UNION ALL
SELECT lei, 'DIRECT_ACCOUNTING_CONSOLIDATION_PARENT', 'NON_PUBLIC', CAST(NULL AS STRING)
FROM {fx_keys} WHERE k % 25 = 0
"""

ISIN_PAYLOADS = """
SELECT lei,
       CASE WHEN k % 31 = 0 THEN CAST(NULL AS STRING)
            WHEN k % 3 = 0 THEN '{{"data":[{{"type":"isins","attributes":{{"lei":"' || lei || '","isin":"XS' || lpad(CAST(k AS STRING), 10, '0') || '"}}}},{{"type":"isins","attributes":{{"lei":"' || lei || '","isin":"US' || lpad(CAST(k AS STRING), 10, '0') || '"}}}}]}}'
            WHEN k % 3 = 1 THEN '{{"data":[]}}'
            ELSE '{{"data":[{{"type":"isins","attributes":{{"lei":"' || lei || '","isin":"DE' || lpad(CAST(k AS STRING), 10, '0') || '"}}}},{{"type":"isins","attributes":{{"lei":"' || lei || '","isin":""}}}},{{"type":"isins"}}]}}' END AS payload
FROM {fx_keys}
"""

# Dirty lookup list over every customer: padded lower case, one character too
# many, plus one unknown and one short code.
LEI_REQUESTS = """
SELECT CASE WHEN k % 20 = 0 THEN '  ' || lower(lei) || ' '
            WHEN k % 20 = 7 THEN lei || 'X'
            ELSE lei END AS lei_input
FROM {fx_keys}
UNION ALL SELECT 'NONEXISTENT000000001'
UNION ALL SELECT 'SHORT'
"""

# Build order: each view may use the ones before it.
VIEWS: list[tuple[str, str]] = [
    ("fx_keys", FX_KEYS),
    ("lei_records", LEI_RECORDS),
    ("relationships", RELATIONSHIPS),
    ("reporting_exceptions", REPORTING_EXCEPTIONS),
    ("isin_payloads", ISIN_PAYLOADS),
    ("lei_requests", LEI_REQUESTS),
]
BASE_TABLES = ("customer", "supplier", "nation", "orders")


def oracle_prefix(recursive: bool = False) -> str:
    """``WITH`` clause defining every adapter view for a DuckDB query."""
    names = {name: name for name, _ in VIEWS}
    names.update({t: t for t in BASE_TABLES})
    parts = [f"{name} AS ({sql.format(**names).strip()})" for name, sql in VIEWS]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts)


_CACHE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def adapter_tables(spark: SparkSession, sf_dir: str, cache: bool = True) -> dict[str, DataFrame]:
    """Spark DataFrames for every adapter view (plus the base tables).

    With ``cache`` the derived views are persisted (memory, spilling to disk);
    a lost block is recomputed from its lineage, so this is safe when
    executors are lost.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if cache and key in _CACHE:
        return _CACHE[key]
    frames: dict[str, DataFrame] = {t: base_table(spark, sf_dir, t) for t in BASE_TABLES}
    for name, sql in VIEWS:
        df = spark.sql(sql, **{k: v for k, v in frames.items() if "{" + k + "}" in sql})
        if cache and name != "fx_keys":
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        frames[name] = df
    if cache:
        _CACHE[key] = frames
    return frames


def store_adapter_tables(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write the adapter views of ``sf_dir`` as Parquet below ``folder``; later
    queries over ``sf_dir`` in this session scan those files."""
    frames = adapter_tables(spark, sf_dir, cache=False)
    stored = {t: frames[t] for t in BASE_TABLES}
    for name, _ in VIEWS:
        frames[name].write.parquet(f"{folder}/{name}")
        stored[name] = spark.read.parquet(f"{folder}/{name}")
    _CACHE[(spark.sparkContext.applicationId, sf_dir)] = stored
