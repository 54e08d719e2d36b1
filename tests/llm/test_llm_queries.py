import os

import pytest

from tests.oracle import SF_DIR, compare
from tidegraph.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables aren't here")


def test_all_problems_are_there():
    assert {n.split("_")[0] for n in Q.QUERIES} == {"p2", "p3", "p4", "p5", "p8", "p9", "p10"}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    compare(spark, Q.QUERIES[name], Q.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_runs(spark, name):
    Q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
