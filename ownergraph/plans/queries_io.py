"""Registered queries: loads, bookkeeping, key checks, ISINs (I, Q, S rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ownergraph.operators import lookup, quality, relations, search
from ownergraph.operators.edges import active_edges, union_all
from ownergraph.plans.adapter import base_table
from ownergraph.plans.catalogue import ACTIVE_SQL, ISIN_LIST_SQL, D, entity_cols_sql, oracle, register, tables
from ownergraph.schema import (
    COLUMN_MAPS,
    DIRECT_PARENT,
    EXCEPTION_COLUMNS,
    KIND_ENTITIES,
    KIND_EXCEPTIONS,
    KIND_RELATIONSHIPS,
    LEVEL1_COLUMNS,
    RELATIONSHIP_COLUMNS,
)
from ownergraph.session import scratch_path
from ownergraph.sources import csv_ingest, isin, loader, metadata, name_index, snapshots, store

# ---------------------------------------------------------------------------
# CSV round trip of the adapter tables through the loaders
# ---------------------------------------------------------------------------

# Names of entities whose LEI ends in 0 get a line break and doubled quotes, names
# of those that end in 5 letters beyond ASCII and a replacement character that
# was really written: multi-line fields, the quote escape and the encoding.
NAME_TAIL_SPARK = '\n"quoted, part"'
NAME_TAIL_SQL = "chr(10) || '\"quoted, part\"'"
WIDE_TAIL = " \u0141\u00f3d\u017a \ufffd"


def _dirty_entities(entities):
    lei, name = F.col("lei"), F.col("legal_name")
    dirty = F.when(lei.endswith("0"), F.concat(name, F.lit(NAME_TAIL_SPARK))).when(
        lei.endswith("5"), F.concat(name, F.lit(WIDE_TAIL))
    )
    return entities.withColumn("legal_name", dirty.otherwise(name))


def _write_dirty_csv(df, kind, path):
    """The CSV files of ``df`` plus rows that are too short and too long, one of
    each for every row of the mapped columns' first file: none may be loaded."""
    csv_ingest.write_csv_with_headers(df, kind, path)
    headers = list(COLUMN_MAPS[kind])
    key = F.regexp_replace(F.coalesce(F.col(df.columns[0]), F.lit("")), '[",\\s]', "")
    short = F.concat(key, F.lit(",short"))
    long = F.concat(key, F.lit(",x" * len(headers)))
    lines = df.where(F.col(df.columns[0]).endswith("1")).select(F.explode(F.array(short, long)).alias("value"))
    head = df.sparkSession.createDataFrame([(",".join(f'"{h}"' for h in headers),)], "value string")
    # One file: its header line first.
    (
        head.withColumn("__o", F.lit(0)).unionByName(lines.withColumn("__o", F.lit(1)))
        .coalesce(1).sortWithinPartitions("__o").select("value").write.mode("append").text(path)
    )


def _roundtrip(spark, df, kind, tag, multi_line=True, split=False):
    path = scratch_path(spark, tag)
    _write_dirty_csv(df, kind, path)
    return csv_ingest.read_dataset_csv(spark, path, kind, multi_line=multi_line, split=split)


def _text_cols_sql(column_map, present, overrides=None):
    overrides = overrides or {}
    out = []
    for name in column_map.values():
        if name in overrides:
            out.append(f"nullif({overrides[name]}, '') AS {name}")
        elif name in present:
            out.append(f"nullif({name}, '') AS {name}")
        else:
            out.append(f"CAST(NULL AS VARCHAR) AS {name}")
    return ", ".join(out)


ENTITY_PRESENT = {
    "lei", "legal_name", "entity_status", "registration_status", "entity_category",
    "legal_jurisdiction", "legal_address_city", "legal_address_country", "hq_address_city",
    "hq_address_country",
}
EDGE_PRESENT = {"start_node_id", "end_node_id", "relationship_type", "relationship_status"}
EXC_PRESENT = set(EXCEPTION_COLUMNS.values())

LOAD_ENTITIES_SQL = oracle(
    "SELECT "
    + _text_cols_sql(
        LEVEL1_COLUMNS,
        ENTITY_PRESENT,
        {
            "legal_name": f"CASE WHEN lei LIKE '%0' THEN legal_name || {NAME_TAIL_SQL} "
            f"WHEN lei LIKE '%5' THEN legal_name || '{WIDE_TAIL}' ELSE legal_name END"
        },
    )
    + " FROM lei_records"
)


@register("load_entities", LOAD_ENTITIES_SQL)
def q_load_entities(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _roundtrip(spark, _dirty_entities(t["lei_records"]), KIND_ENTITIES, "load-entities", split=True)


@register(
    "load_relationships",
    oracle("SELECT " + _text_cols_sql(RELATIONSHIP_COLUMNS, EDGE_PRESENT) + " FROM relationships"),
)
def q_load_relationships(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _roundtrip(spark, t["relationships"], KIND_RELATIONSHIPS, "load-relationships", multi_line=False)


@register(
    "load_exceptions",
    oracle("SELECT " + _text_cols_sql(EXCEPTION_COLUMNS, EXC_PRESENT) + " FROM reporting_exceptions"),
)
def q_load_exceptions(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _roundtrip(spark, t["reporting_exceptions"], KIND_EXCEPTIONS, "load-exceptions")


@register(
    "dataset_counts",
    oracle(
        "SELECT 'lei2' AS dataset_type, CAST(count(*) AS INTEGER) AS record_count FROM lei_records "
        "UNION ALL SELECT 'rr', CAST(count(*) AS INTEGER) FROM relationships "
        "UNION ALL SELECT 'repex', CAST(count(*) AS INTEGER) FROM reporting_exceptions"
    ),
)
def q_dataset_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    frames = []
    for kind, name, df in (
        (KIND_ENTITIES, "lei_records", _dirty_entities(t["lei_records"])),
        (KIND_RELATIONSHIPS, "relationships", t["relationships"]),
        (KIND_EXCEPTIONS, "reporting_exceptions", t["reporting_exceptions"]),
    ):
        csv_path = scratch_path(spark, f"csv-{name}")
        out_path = scratch_path(spark, f"table-{name}")
        _write_dirty_csv(df, kind, csv_path)
        csv_ingest.load_dataset(spark, kind, csv_path, out_path)
        frames.append(csv_ingest.table_count(store.read_table(spark, out_path, kind), kind))
    return union_all(frames)


# ---------------------------------------------------------------------------
# Metadata upsert and status display
# ---------------------------------------------------------------------------

META_CURRENT_SQL = (
    "meta_current AS ("
    "SELECT 'lei2' AS dataset_type, '2031-02-17' AS publish_date, "
    "CAST('2031-02-18 03:05:41' AS TIMESTAMP) AS loaded_at, CAST(count(*) AS INTEGER) AS record_count "
    "FROM lei_records UNION ALL "
    "SELECT 'rr', '2031-02-14', CAST('2031-02-17 07:33:15' AS TIMESTAMP), CAST(count(*) AS INTEGER) "
    "FROM relationships)"
)
META_UPDATES_SQL = (
    "meta_updates AS ("
    "SELECT 'rr' AS dataset_type, '2031-02-17' AS publish_date, "
    "CAST('2031-02-18 03:07:22' AS TIMESTAMP) AS loaded_at, CAST(count(*) AS INTEGER) AS record_count "
    "FROM relationships UNION ALL "
    "SELECT 'repex', 'unknown', CAST('2031-02-18 03:08:50' AS TIMESTAMP), CAST(count(*) AS INTEGER) "
    "FROM reporting_exceptions)"
)
META_MERGED_SQL = (
    "meta AS (SELECT * FROM meta_current WHERE dataset_type NOT IN (SELECT dataset_type FROM meta_updates) "
    "UNION ALL SELECT * FROM meta_updates)"
)


def _metadata_frames(spark, sf_dir):
    t = tables(spark, sf_dir)
    e, r, x = t["lei_records"], t["relationships"], t["reporting_exceptions"]

    def row(df, kind, date, stamp):
        loads = csv_ingest.table_count(df, kind).withColumn(
            "publish_date", F.lit(date).cast("string")
        )
        return metadata.metadata_rows(loads, F.lit(stamp).cast("timestamp"))

    current = row(e, "lei2", "2031-02-17", "2031-02-18 03:05:41").unionByName(
        row(r, "rr", "2031-02-14", "2031-02-17 07:33:15")
    )
    updates = row(r, "rr", "2031-02-17", "2031-02-18 03:07:22")
    updates = updates.unionByName(row(x, "repex", None, "2031-02-18 03:08:50"))
    return current, updates


@register(
    "metadata_upsert",
    oracle(
        "SELECT dataset_type, publish_date, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at, "
        "record_count FROM meta",
        META_CURRENT_SQL,
        META_UPDATES_SQL,
        META_MERGED_SQL,
    ),
)
def q_metadata_upsert(spark, sf_dir):
    current, updates = _metadata_frames(spark, sf_dir)
    merged = metadata.upsert_metadata(current, updates)
    return merged.select(
        "dataset_type",
        "publish_date",
        F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"),
        "record_count",
    )


@register(
    "status_report",
    oracle(
        "SELECT dataset_type, CASE dataset_type WHEN 'lei2' THEN 'Level 1 - LEI Records' "
        "WHEN 'rr' THEN 'Level 2 - Relationships' WHEN 'repex' THEN 'Level 2 - Reporting Exceptions' "
        "ELSE dataset_type END AS dataset, publish_date, "
        "strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at, format('{:,}', record_count) AS records "
        "FROM meta",
        META_CURRENT_SQL,
        META_UPDATES_SQL,
        META_MERGED_SQL,
    ),
)
def q_status_report(spark, sf_dir):
    current, updates = _metadata_frames(spark, sf_dir)
    return metadata.status_report(metadata.upsert_metadata(current, updates))


# ---------------------------------------------------------------------------
# Snapshot files named after the order dates
# ---------------------------------------------------------------------------


PUBLISHER = "registrar"


def _snapshot_files(spark, sf_dir):
    orders = base_table(spark, sf_dir, "orders")
    kind = (
        F.when(F.col("o_orderkey") % 4 == 0, "lei2")
        .when(F.col("o_orderkey") % 4 == 1, "rr")
        .when(F.col("o_orderkey") % 4 == 2, "repex")
        .otherwise("notes")
    )
    path = F.concat(
        F.lit("/data/"),
        F.date_format("o_orderdate", "yyyyMMdd"),
        F.lit("-0615-registrar-goldencopy-"),
        kind,
        F.lit("-golden-copy.csv"),
    )
    return orders.select(path.alias("path"))


SNAPSHOT_FILES_SQL = (
    "files AS (SELECT '/data/' || strftime(o_orderdate, '%Y%m%d') || '-0615-registrar-goldencopy-' || "
    "CASE o_orderkey % 4 WHEN 0 THEN 'lei2' WHEN 1 THEN 'rr' WHEN 2 THEN 'repex' ELSE 'notes' END "
    "|| '-golden-copy.csv' AS path FROM orders)"
)
LATEST_SQL = (
    "latest AS (SELECT k.kind AS dataset_type, max(f.path) AS path FROM "
    "(SELECT 'lei2' AS kind UNION ALL SELECT 'rr' UNION ALL SELECT 'repex') k "
    "JOIN files f ON regexp_extract(f.path, '[^/]*$') LIKE '%-registrar-goldencopy-' || k.kind || '-%' "
    "GROUP BY k.kind)"
)


@register("latest_snapshot", oracle("SELECT dataset_type, path FROM latest", SNAPSHOT_FILES_SQL, LATEST_SQL))
def q_latest_snapshot(spark, sf_dir):
    return snapshots.latest_snapshots(_snapshot_files(spark, sf_dir), PUBLISHER)


def _remote_dates(spark, sf_dir):
    orders = base_table(spark, sf_dir, "orders")
    kind = (
        F.when(F.col("o_orderkey") % 3 == 0, "lei2")
        .when(F.col("o_orderkey") % 3 == 1, "rr")
        .otherwise("repex")
    )
    latest = orders.groupBy(kind.alias("dataset_type")).agg(F.max("o_orderdate").alias("d"))
    # One kind has been published again since the last download.
    newer = F.when(F.col("dataset_type") == "rr", 1).otherwise(0)
    return latest.select("dataset_type", F.date_format(F.date_add("d", newer), "yyyy-MM-dd").alias("publish_date"))


@register(
    "stale_datasets",
    oracle(
        "SELECT r.dataset_type, r.publish_date AS remote_date, l.local_date, s.path, "
        "NOT (l.local_date IS NOT NULL AND l.local_date = r.publish_date AND s.path IS NOT NULL) "
        "AS needs_download "
        "FROM remote r LEFT JOIN local_dates l ON l.dataset_type = r.dataset_type "
        "LEFT JOIN latest s ON s.dataset_type = r.dataset_type",
        SNAPSHOT_FILES_SQL,
        LATEST_SQL,
        "remote AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'lei2' WHEN 1 THEN 'rr' ELSE 'repex' END "
        "AS dataset_type, strftime(CAST(max(o_orderdate) AS DATE) + CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END, "
        "'%Y-%m-%d') AS publish_date FROM orders GROUP BY o_orderkey % 3)",
        "local_dates AS (SELECT dataset_type, substr(regexp_extract(path, '[^/]*$'), 1, 4) || '-' || "
        "substr(regexp_extract(path, '[^/]*$'), 5, 2) || '-' || substr(regexp_extract(path, '[^/]*$'), 7, 2) "
        "AS local_date FROM latest)",
    ),
)
def q_stale_datasets(spark, sf_dir):
    latest = snapshots.latest_snapshots(_snapshot_files(spark, sf_dir), PUBLISHER)
    name = F.element_at(F.split("path", "/"), -1)
    local = latest.select(
        "dataset_type",
        F.concat_ws("-", F.substring(name, 1, 4), F.substring(name, 5, 2), F.substring(name, 7, 2)).alias(
            "local_date"
        ),
    )
    return snapshots.stale_datasets(_remote_dates(spark, sf_dir), local, latest)


# ---------------------------------------------------------------------------
# Q1: declared keys
# ---------------------------------------------------------------------------

# Dirty copies: relationships of children ending in 00 or 50 twice, and one
# edge with a missing parent per child ending in 25.
DIRTY_RELS_SQL = (
    "dirty_rels AS (SELECT start_node_id, end_node_id, relationship_type FROM relationships "
    "UNION ALL SELECT start_node_id, end_node_id, relationship_type FROM relationships "
    "WHERE start_node_id LIKE '%00' OR start_node_id LIKE '%50' "
    "UNION ALL SELECT start_node_id, CAST(NULL AS VARCHAR), relationship_type FROM relationships "
    "WHERE start_node_id LIKE '%25')"
)


@register(
    "key_violations",
    oracle(
        "SELECT start_node_id, end_node_id, relationship_type, CAST(count(*) AS BIGINT) AS row_count, "
        "(start_node_id IS NULL OR end_node_id IS NULL OR relationship_type IS NULL) AS has_null_key "
        "FROM dirty_rels GROUP BY ALL "
        "HAVING count(*) > 1 OR start_node_id IS NULL OR end_node_id IS NULL OR relationship_type IS NULL",
        DIRTY_RELS_SQL,
    ),
)
def q_key_violations(spark, sf_dir):
    r = tables(spark, sf_dir)["relationships"].select(
        "start_node_id", "end_node_id", "relationship_type"
    )
    start = F.col("start_node_id")
    dirty = r.unionByName(r.where(start.endswith("00") | start.endswith("50"))).unionByName(
        r.where(start.endswith("25")).withColumn("end_node_id", F.lit(None).cast("string"))
    )
    return quality.key_violations(dirty, quality.TABLE_KEYS["relationships"])


@register(
    "key_violations_entities",
    oracle(
        "SELECT lei, CAST(count(*) AS BIGINT) AS row_count, (lei IS NULL) AS has_null_key "
        "FROM lei_records GROUP BY lei HAVING count(*) > 1 OR lei IS NULL"
    ),
)
def q_key_violations_entities(spark, sf_dir):
    return quality.key_violations(tables(spark, sf_dir)["lei_records"], quality.TABLE_KEYS["lei_records"])


@register(
    "key_violations_exceptions",
    oracle(
        "SELECT lei, exception_category, CAST(count(*) AS BIGINT) AS row_count, "
        "(lei IS NULL OR exception_category IS NULL) AS has_null_key FROM ("
        "SELECT lei, exception_category FROM reporting_exceptions UNION ALL "
        "SELECT lei, exception_category FROM reporting_exceptions WHERE exception_reason_1 = 'NON_PUBLIC' UNION ALL "
        "SELECT lei, CAST(NULL AS VARCHAR) FROM reporting_exceptions WHERE exception_reason_1 = 'LEGAL_OBSTACLES') d "
        "GROUP BY ALL HAVING count(*) > 1 OR lei IS NULL OR exception_category IS NULL"
    ),
)
def q_key_violations_exceptions(spark, sf_dir):
    x = tables(spark, sf_dir)["reporting_exceptions"]
    keys = x.select("lei", "exception_category")
    reason = F.col("exception_reason_1")
    dirty = keys.unionByName(x.where(reason == "NON_PUBLIC").select("lei", "exception_category")).unionByName(
        x.where(reason == "LEGAL_OBSTACLES").select("lei", F.lit(None).cast("string").alias("exception_category"))
    )
    return quality.key_violations(dirty, quality.TABLE_KEYS["reporting_exceptions"])


# ---------------------------------------------------------------------------
# Load everything, stored bookkeeping, clustered copies
# ---------------------------------------------------------------------------


_LOADED: dict[tuple[str, str], tuple[str, str]] = {}


def _load_everything(spark, sf_dir):
    """CSV files of the three adapter tables, loaded by ``load_all``: (store, metadata
    folder). Loaded once per session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        t = tables(spark, sf_dir)
        base = scratch_path(spark, "load-all")
        files = {}
        for kind, df in (
            (KIND_ENTITIES, _dirty_entities(t["lei_records"])),
            (KIND_RELATIONSHIPS, t["relationships"]),
            (KIND_EXCEPTIONS, t["reporting_exceptions"]),
        ):
            files[kind] = [f"{base}/csv/{kind}"]
            _write_dirty_csv(df, kind, files[kind][0])
        dates = {KIND_ENTITIES: "2031-02-17", KIND_RELATIONSHIPS: "2031-02-17"}
        loader.load_all(spark, files, f"{base}/tables", dates, f"{base}/metadata")
        _LOADED[key] = f"{base}/tables", f"{base}/metadata"
    return _LOADED[key]


@register(
    "load_all_counts",
    oracle(
        "SELECT 'lei2' AS name, count(*) AS n FROM lei_records UNION ALL SELECT 'rr', count(*) FROM relationships "
        "UNION ALL SELECT 'rr_by_child', count(*) FROM relationships "
        "UNION ALL SELECT 'rr_by_parent', count(*) FROM relationships "
        "UNION ALL SELECT 'repex', count(*) FROM reporting_exceptions"
    ),
)
def q_load_all_counts(spark, sf_dir):
    base, _ = _load_everything(spark, sf_dir)
    names = [KIND_ENTITIES, KIND_RELATIONSHIPS, csv_ingest.BY_CHILD, csv_ingest.BY_PARENT, KIND_EXCEPTIONS]
    return union_all(
        [store.read_table(spark, base, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    )


@register(
    "load_rejects",
    oracle(
        "SELECT kind, 'fields' AS reason, 2 * count(*) AS n FROM ("
        "SELECT 'lei2' AS kind, lei AS k FROM lei_records UNION ALL SELECT 'rr', start_node_id FROM relationships "
        "UNION ALL SELECT 'repex', lei FROM reporting_exceptions) x WHERE k LIKE '%1' GROUP BY kind"
    ),
)
def q_load_rejects(spark, sf_dir):
    """Rows of the CSV files that were not loaded, by kind and reason."""
    base, _ = _load_everything(spark, sf_dir)
    kinds = [KIND_ENTITIES, KIND_RELATIONSHIPS, KIND_EXCEPTIONS]
    rejects = union_all(
        [store.read_table(spark, base, k + csv_ingest.REJECTS).select(F.lit(k).alias("kind"), "reason") for k in kinds]
    )
    return rejects.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@register(
    "load_replaced",
    oracle(
        "SELECT 'rr' AS name, count(*) AS n FROM relationships UNION ALL "
        "SELECT 'repex', count(*) FROM reporting_exceptions UNION ALL "
        "SELECT 'repex after', count(*) FROM reporting_exceptions WHERE exception_category LIKE 'DIRECT%'"
    ),
)
def q_load_replaced(spark, sf_dir):
    """A store before and after one table is replaced: the others stay, and a load
    that fails on the way (a file without the columns) changes nothing."""
    t = tables(spark, sf_dir)
    base = scratch_path(spark, "replaced")
    frames = {KIND_RELATIONSHIPS: t["relationships"], KIND_EXCEPTIONS: t["reporting_exceptions"]}
    for kind, df in frames.items():
        _write_dirty_csv(df, kind, f"{base}/csv/{kind}")
    loader.load_all(spark, {k: f"{base}/csv/{k}" for k in frames}, f"{base}/tables")
    before = store.read_table(spark, f"{base}/tables", KIND_EXCEPTIONS)
    try:
        # The exceptions load, the edges' file has other columns.
        loader.load_all(
            spark, {KIND_EXCEPTIONS: f"{base}/csv/{KIND_EXCEPTIONS}", KIND_RELATIONSHIPS: f"{base}/csv/{KIND_EXCEPTIONS}"}, f"{base}/tables"
        )
    except csv_ingest.MissingColumnsError:
        pass
    direct = t["reporting_exceptions"].where(F.col("exception_category").startswith("DIRECT"))
    _write_dirty_csv(direct, KIND_EXCEPTIONS, f"{base}/csv/direct")
    csv_ingest.load_dataset(spark, KIND_EXCEPTIONS, f"{base}/csv/direct", f"{base}/tables")
    parts = [
        ("rr", store.read_table(spark, f"{base}/tables", csv_ingest.BY_PARENT)),
        ("repex", before),
        ("repex after", store.read_table(spark, f"{base}/tables", KIND_EXCEPTIONS)),
    ]
    return union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts])


@register(
    "metadata_first_load",
    oracle(
        "SELECT 'lei2' AS dataset_type, 'unknown' AS publish_date, CAST(count(*) AS INTEGER) AS record_count, "
        "CAST(0 AS BIGINT) AS rows_before, true AS stamped_now FROM lei_records"
    ),
)
def q_metadata_first_load(spark, sf_dir):
    """No load records before the first load, then one with the time of
    the load."""
    path = scratch_path(spark, "metadata-first")
    none = metadata.read_metadata(spark, path).agg(F.count(F.lit(1)).alias("rows_before"))
    counted = csv_ingest.table_count(tables(spark, sf_dir)["lei_records"], KIND_ENTITIES)
    metadata.write_metadata(metadata.metadata_rows(counted.withColumn("publish_date", F.lit(None).cast("string"))), path)
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("loaded_at")
    now = metadata.status(metadata.read_metadata(spark, path)).select(
        "dataset_type", "publish_date", "record_count", age.between(0, 3600).alias("stamped_now")
    )
    return now.join(F.broadcast(none)).select("dataset_type", "publish_date", "record_count", "rows_before", "stamped_now")


@register(
    "metadata_stored",
    oracle(
        "SELECT dataset_type, publish_date, record_count FROM ("
        "SELECT 'lei2' AS dataset_type, '2031-02-17' AS publish_date, CAST(count(*) AS INTEGER) AS record_count "
        "FROM lei_records UNION ALL "
        "SELECT 'rr', '2031-02-20', CAST(count(*) AS INTEGER) FROM relationships UNION ALL "
        "SELECT 'repex', 'unknown', CAST(count(*) AS INTEGER) FROM reporting_exceptions) m"
    ),
)
def q_metadata_stored(spark, sf_dir):
    """Written by a load, upserted by a later load of one kind, read back."""
    base, first = _load_everything(spark, sf_dir)
    path = scratch_path(spark, "metadata-stored")
    metadata.write_metadata(metadata.read_metadata(spark, first), path)
    again = csv_ingest.table_count(store.read_table(spark, base, KIND_RELATIONSHIPS), KIND_RELATIONSHIPS)
    metadata.write_metadata(metadata.metadata_rows(again.withColumn("publish_date", F.lit("2031-02-20"))), path)
    return metadata.status(metadata.read_metadata(spark, path)).select("dataset_type", "publish_date", "record_count")


@register(
    "lookup_by_layout",
    oracle(
        "SELECT end_node_id AS lei, count(*) AS n_children, "
        f"count(*) FILTER (WHERE relationship_type = {D}) AS n_direct, min(start_node_id) AS first_child "
        f"FROM relationships WHERE {ACTIVE_SQL} AND end_node_id IS NOT NULL GROUP BY end_node_id"
    ),
)
def q_lookup_by_layout(spark, sf_dir):
    """Children of a request list, every parent of the registry by an active edge of
    any type, looked up in the edge copy laid out by parent."""
    base, _ = _load_everything(spark, sf_dir)
    edges = store.read_table(spark, base, csv_ingest.BY_PARENT)
    requests = active_edges(edges).select(F.col("end_node_id").alias("lei")).distinct()
    kids = relations.children(store.read_table(spark, base, KIND_ENTITIES), edges, requests)
    return kids.groupBy("lei").agg(
        F.count(F.lit(1)).alias("n_children"),
        F.count(F.when(F.col("relationship_type") == DIRECT_PARENT, 1)).alias("n_direct"),
        F.min("related_lei").alias("first_child"),
    )


# ---------------------------------------------------------------------------
# L3 / L3b over the stored index of the names
# ---------------------------------------------------------------------------

STORED_LIMIT = 10
# Texts beside those made from the nations: short and single pieces, wildcards only,
# several pieces, the tails that the loaded names have, a text that no name has.
STORED_TEXTS = ["Su", "r", "", "_" * 20, "ER#%1", "0_1", "quoted, PART", "\u0142\u00d3d", "no such name", "supp%#0%7"]
STORED_NAMES_SQL = (
    "stored_names AS (SELECT * REPLACE (CASE "
    f"WHEN lei LIKE '%0' THEN legal_name || {NAME_TAIL_SQL} WHEN lei LIKE '%5' THEN legal_name || '{WIDE_TAIL}' "
    "ELSE nullif(legal_name, '') END AS legal_name) FROM lei_records)"
)


@register(
    "name_gram_counts",
    oracle(
        "SELECT gram, count(DISTINCT lei) AS names FROM (SELECT lei, unnest(list_transform("
        "range(1, greatest(length(legal_name), 1) + 1), "
        "lambda i: substring(lower(legal_name) || chr(3) || chr(3), CAST(i AS BIGINT), 3))) AS gram "
        "FROM stored_names WHERE legal_name IS NOT NULL) g GROUP BY gram",
        STORED_NAMES_SQL,
    ),
)
def q_name_gram_counts(spark, sf_dir):
    """The dictionary of the stored index, counted again from its postings."""
    index = name_index.open_index(spark, _load_everything(spark, sf_dir)[0])
    counted = index.postings.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    return counted.join(index.counts.select("gram", "names"), ["gram", "names"])


@register(
    "search_by_name_stored",
    oracle(
        f"SELECT query, CAST(rank AS INTEGER) AS rank, {entity_cols_sql('x')} FROM ("
        "SELECT s.query, e.*, row_number() OVER (PARTITION BY s.query ORDER BY e.legal_name, e.lei) AS rank "
        "FROM searches s JOIN stored_names e ON e.legal_name ILIKE '%' || s.query || '%') x "
        f"WHERE rank <= {STORED_LIMIT}",
        STORED_NAMES_SQL,
        "searches AS (SELECT 'r#0000' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS query FROM nation "
        + " ".join(f"UNION ALL SELECT '{x}'" for x in STORED_TEXTS)
        + ")",
    ),
)
def q_search_by_name_stored(spark, sf_dir):
    base, _ = _load_everything(spark, sf_dir)
    number = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    texts = base_table(spark, sf_dir, "nation").select(F.concat(F.lit("r#0000"), number).alias("query"))
    texts = texts.unionByName(spark.createDataFrame([(x,) for x in STORED_TEXTS], "query string"))
    entities = store.read_table(spark, base, KIND_ENTITIES)
    return search.search_by_name_stored(entities, name_index.open_index(spark, base), texts, STORED_LIMIT)


# ---------------------------------------------------------------------------
# S1 - S4
# ---------------------------------------------------------------------------

@register(
    "isin_parse",
    oracle(
        "SELECT lei, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS isin "
        "FROM isin_lists",
        ISIN_LIST_SQL,
    ),
)
def q_isin_parse(spark, sf_dir):
    return isin.parse_isins(tables(spark, sf_dir)["isin_payloads"])


@register(
    "isin_map",
    oracle("SELECT lei, array_to_string(l, ', ') AS isins FROM isin_lists WHERE len(l) > 0", ISIN_LIST_SQL),
)
def q_isin_map(spark, sf_dir):
    m = isin.isin_map(tables(spark, sf_dir)["isin_payloads"])
    return m.select("lei", F.array_join("isins", ", ").alias("isins"))


SEARCH_ISIN_TEXT = "mer#00000"


@register(
    "search_with_isins",
    oracle(
        f"SELECT s.*, coalesce(array_to_string(i.l, ', '), '') AS isins FROM "
        f"(SELECT {entity_cols_sql('e')} FROM lei_records e WHERE e.legal_name ILIKE '%{SEARCH_ISIN_TEXT}%' "
        "ORDER BY e.legal_name, e.lei LIMIT 100) s "
        "LEFT JOIN (SELECT * FROM isin_lists WHERE len(l) > 0) i ON i.lei = s.lei",
        ISIN_LIST_SQL,
    ),
)
def q_search_with_isins(spark, sf_dir):
    t = tables(spark, sf_dir)
    hits = lookup.search_by_name(t["lei_records"], SEARCH_ISIN_TEXT, 100)
    return isin.attach_isins(hits, isin.isin_map(t["isin_payloads"]))
