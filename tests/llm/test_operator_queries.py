import pytest
from compare import both

import __spark_entry__ as entry
from mergeloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    ours, theirs = both(spark, queries.QUERIES[name], queries.ORACLE[name], FOLDER)
    assert ours == theirs


def test_one_query_for_each_operator():
    names = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
