from __future__ import annotations

import os

import pytest

from shelfsight.llm.queries import QUERIES, TWINS
from twins import connect, differences

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", list(TWINS))
def test_twin(spark, name):
    assert differences(spark, connect(SMALL), QUERIES[name], TWINS[name], SMALL) == []
