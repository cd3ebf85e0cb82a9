import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from strandlog import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def kind(t):
    """Integers of any width and decimals without a fraction are one kind; all other types differ."""
    if pa.types.is_integer(t) or pa.types.is_decimal(t) and t.scale == 0:
        return "integer"
    if pa.types.is_floating(t):
        return "float"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return "list", kind(t.value_type)
    if pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_string_view(t):
        return "string"
    return "timestamp" if pa.types.is_timestamp(t) else str(t)


def plain(x):
    if isinstance(x, Decimal):
        return int(x) if x == x.to_integral_value() else x
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    return [plain(y) for y in x] if isinstance(x, list) else x


def values(table):
    """Rows with their types: a nullable integer stays an integer."""
    return sorted(repr(tuple(plain(r[c]) for c in sorted(r))) for r in table.to_pylist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query_equals_sql(spark, name):
    got = own.queries()[name](spark, DATA).toArrow()
    assert len(got.column_names) == len(set(got.column_names))
    if name in own.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        want = con.execute(own.oracle_sql()[name]).to_arrow_table()
        assert sorted((f.name, kind(f.type)) for f in got.schema) == sorted((f.name, kind(f.type)) for f in want.schema)
        assert values(got) == values(want)


def test_keys():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
