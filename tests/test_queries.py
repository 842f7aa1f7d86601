import pytest
from compare import connect, mismatch

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
QUERIES = {name: run for name, run in registry.queries().items() if name in registry.QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


#: An approximate search has no SQL; its recall is tested here and in test_lists.
WITHOUT_SQL = {"topk_probed"}


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


def test_recall_of_the_probed_lists(spark, duck):
    found = {(r.question_id, r.chunk_id) for r in QUERIES["topk_probed"](spark, SF_DIR).collect()}
    rows = duck.sql(SQL["topk_in_lists"]).fetchall()
    near = {(q, chunk) for q, _, chunk, _, _ in rows}
    assert len(found) == len(near) and len(found & near) >= 0.9 * len(near)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query_equals_sql(spark, duck, name):
    assert mismatch(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None
