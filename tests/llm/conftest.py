"""Fixtures of the training-data operators: small tables with the odd cases."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from ownergraph.llm.common import prepare  # noqa: E402
from ownergraph.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def llm_spark():
    session = build_session(
        "local[4]",
        app_name="ownergraph-llm-tests",
        shuffle_partitions=4,
        extra={"spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="ownergraph-llm-ckpt-"), "spark.driver.memory": "4g"},
    )
    prepare(session)
    return session


# doc_id, text, lang, source, n_chars, and columns whose names clash with
# those that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, n string, line_no string, fp int, row string, s int, __row string, __p string, __hits string, __removed string, __lines string, hits int, found int, parts int, whole string"


def odd_rows():
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(9000))
    near = " ".join(f"w{i}" for i in range(400))
    texts = {
        0: None,
        1: "",
        2: "   \n\t ",
        3: long,
        4: long,
        5: near,
        6: near + " more",
        7: "one two three\nfour five six seven eight nine ten eleven\n\none two three",
        8: "four five six seven eight nine ten eleven\nsomething else entirely",
        9: "café naïve 日本語 <|endoftext|> it's 'S —, x",
        10: "!!! ??? 123",
    }
    rows = [(k, v, "en" if k % 2 else "de", None, None) for k, v in texts.items()]
    rows += [(5, near, None, "again", 1), (5, near, None, "again", 1), (None, near, None, None, None), (None, "no id here", "en", None, None)]
    return [(*r, 1, "a", "b", 2, "c", 3, "r", "p", "h", "x", "l", 4, 5, 6, "w") for r in rows]


@pytest.fixture(scope="session")
def odd_docs(llm_spark):
    path = tempfile.mkdtemp(prefix="ownergraph-odd-") + "/documents.parquet"
    llm_spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return llm_spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(llm_spark):
    return llm_spark.createDataFrame([], SCHEMA)
