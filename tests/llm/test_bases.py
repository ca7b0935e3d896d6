"""The base columns of the operators that learn, against SQL."""

import pytest

from sparrel.llm import bases

from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(bases.QUERIES))
def test_base_columns_equal_sql(spark, name):
    assert oracle.differences(bases.QUERIES[name](spark, SF), oracle.connect(SF), bases.SQL[name]) == ""
