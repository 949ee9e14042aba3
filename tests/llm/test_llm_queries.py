"""The queries of the text problems: against SQL where there is some, else for columns."""

import pytest

from tallyforge.llm import queries
from tests.oracle import DATA, check

R = queries.R
COLUMNS = {
    "p1_found": {"src", "row_id", "kind", "value"}, "p2_found": {"correction_id", "field", "en_pos", "ru_pos"},
    "p6_found": {"item_id", "doc_id"}, "p8_found": {"doc_id", "seg_no", "lang"}, "p5_found": {"issue_number", "reason"},
}


@pytest.mark.parametrize("name", list(R.sql))
def test_same_as_sql(spark, name):
    check(spark, R, name)


@pytest.mark.parametrize("name", [n for n in R.queries if n not in R.sql])
def test_runs(spark, name):
    df = R.queries[name](spark, DATA)
    assert COLUMNS.get(name, set(df.columns)) == set(df.columns)
    rows = df.count()
    if name.endswith("_found"):
        assert rows == df.distinct().count()
