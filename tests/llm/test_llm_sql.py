from __future__ import annotations

import pytest
from compare import connect, differences

from linkharbor.llm import queries as q


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, small, name):
    df = q.QUERIES[name](spark, small)
    if name in q.SQL:
        assert differences(df, con, q.SQL[name]) == ""
    else:
        assert df.columns and df.count() > 0


def test_found_columns(spark, small):
    want = {
        "p3_found": [("record_id", "bigint"), ("field_name", "string")], "p4_found": [("table_name", "string"), ("first_key", "bigint"), ("copy_key", "bigint")],
        "p5_found": [("id", "string"), ("accessible_record_id", "bigint"), ("filesize_record_id", "bigint"), ("couldretry_record_id", "bigint")], "p9_found": [("doc_id", "bigint")],
    }
    for name, cols in want.items():
        assert q.QUERIES[name](spark, small).dtypes == cols
