"""Text queries on empty and on odd tables."""

import pytest

from tallyforge.llm import queries
from tests import edges

R = queries.R


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return {"empty": edges.empty(tmp_path_factory.mktemp("empty")), "odd": edges.odd(tmp_path_factory.mktemp("odd"))}


@pytest.mark.parametrize("name", list(R.queries))
@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_edges(spark, folders, name, kind):
    df = R.queries[name](spark, folders[kind])
    rows = df.count()
    assert rows >= 0 if kind == "odd" or "shares" in name else rows == 0
    if name.endswith("_found"):
        assert rows == df.distinct().count()
