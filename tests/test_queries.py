"""Every core query runs, and equals its SQL where it has one."""

import pytest

from quillmine.plans import catalogue
from tools import compare


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, name):
    said = compare.compare(spark, small, name)
    assert "DIFFER" not in said and "TYPES" not in said, said


def test_sql_names():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
