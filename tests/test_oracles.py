import os

import pytest

import __spark_entry__ as entry
from tests.oracle import SF_DIR, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables aren't here")
CORE = [m for m in entry._modules() if not m.__name__.startswith(entry.EXTRA)]
NAMES = [(m.__name__, name) for m in CORE for name in m.ORACLE]


@pytest.mark.parametrize(("module", "name"), NAMES)
def test_query_equals_sql(spark, module, name):
    m = next(m for m in CORE if m.__name__ == module)
    compare(spark, m.QUERIES[name], m.ORACLE[name])


ROWS_ONLY = [(m, name) for m in CORE for name in m.QUERIES if name not in m.ORACLE]


@pytest.mark.parametrize(("m", "name"), ROWS_ONLY, ids=[n for _, n in ROWS_ONLY])
def test_query_runs(spark, m, name):
    m.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "file_id"
