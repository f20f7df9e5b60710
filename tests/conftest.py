"""Shared fixtures: one local session and small hand-written registries."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ownergraph.schema import DIRECT_PARENT, ENTITY_COLUMNS, ULTIMATE_PARENT  # noqa: E402
from ownergraph.session import build_session  # noqa: E402

PARENT = "MIDWOOD0000000000071"
CHILD_A = "AMBERMILL00000000052"
CHILD_B = "BRISKCANAL0000000053"
ULTIMATE = "SKARVENSHIP000000090"
GRANDCHILD = "TEALORCHARD000000034"
SHARED = "QUARRYLOOM0000000017"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="ownergraph-test-ckpt-")
    session = build_session(
        "local[4]",
        app_name="ownergraph-tests",
        shuffle_partitions=4,
        extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"},
    )
    yield session
    session.stop()


def entity(lei, name, city, country, status="ACTIVE", reg="ISSUED", category="GENERAL"):
    return (lei, name, status, reg, category, country, city, country, city, country)


def make_entities(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ENTITY_COLUMNS))


def make_rels(spark, rows):
    return spark.createDataFrame(
        rows,
        "start_node_id string, end_node_id string, relationship_type string, relationship_status string",
    )


def make_exceptions(spark, rows):
    return spark.createDataFrame(
        rows,
        "lei string, exception_category string, exception_reason_1 string, exception_reference_1 string",
    )


def requests_of(spark, *leis):
    return spark.createDataFrame([(x,) for x in leis], "lei string")


BASE_ENTITIES = [
    entity(PARENT, "Middlewood Trading AB", "New York", "US"),
    entity(CHILD_A, "Amber Mills Ltda", "Chicago", "US"),
    entity(CHILD_B, "Brisk Canals BV", "London", "GB"),
    entity(ULTIMATE, "Skarven Shipping ASA", "London", "GB"),
]
BASE_EDGES = [
    (CHILD_A, PARENT, DIRECT_PARENT, "ACTIVE"),
    (CHILD_B, PARENT, DIRECT_PARENT, "ACTIVE"),
    (CHILD_A, ULTIMATE, ULTIMATE_PARENT, "ACTIVE"),
    (PARENT, ULTIMATE, DIRECT_PARENT, "ACTIVE"),
]
BASE_EXCEPTIONS = [(ULTIMATE, "ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT", "NO_KNOWN_PERSON", "")]
DEEP_ENTITIES = BASE_ENTITIES + [entity(GRANDCHILD, "Teal Orchards OY", "Berlin", "DE")]
DEEP_EDGES = BASE_EDGES + [
    (GRANDCHILD, CHILD_A, DIRECT_PARENT, "ACTIVE"),
    (GRANDCHILD, ULTIMATE, ULTIMATE_PARENT, "ACTIVE"),
]
DIAMOND_ENTITIES = DEEP_ENTITIES + [entity(SHARED, "Quarry & Loom KK", "Geneva", "CH")]
DIAMOND_EDGES = DEEP_EDGES + [
    (SHARED, CHILD_A, DIRECT_PARENT, "ACTIVE"),
    (SHARED, CHILD_B, DIRECT_PARENT, "ACTIVE"),
]


@pytest.fixture(scope="session")
def base(spark):
    return (
        make_entities(spark, BASE_ENTITIES),
        make_rels(spark, BASE_EDGES),
        make_exceptions(spark, BASE_EXCEPTIONS),
    )


@pytest.fixture(scope="session")
def deep(spark):
    return make_entities(spark, DEEP_ENTITIES), make_rels(spark, DEEP_EDGES)


@pytest.fixture(scope="session")
def diamond(spark):
    return make_entities(spark, DIAMOND_ENTITIES), make_rels(spark, DIAMOND_EDGES)


def rows(df, *cols):
    """Rows as sorted tuples of the given columns (all columns if none)."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, "" if x is None else x) for x in t))
